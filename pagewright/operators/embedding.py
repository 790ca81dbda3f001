"""Text vectors.

The embedder is pluggable: anything mapping a column of texts to
``array<float>``.  The default hashes words into a fixed number of slots, so it
needs no model file and gives the same vector everywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64
#: Words whose slots are remembered, and texts taken out of a batch at once, at most.
REMEMBERED, TEXTS = 65_536, 256


class _Slots(dict):
    """Slots of words, worked out once for as many words as are remembered."""

    def __init__(self, dimensions: int) -> None:
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        # What stands between two blanks is no word: it counts behind the vector.
        slot = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:4], 16) % self.dimensions if word else self.dimensions
        self[word] = slot
        return slot


def hashing_embedder(dimensions: int = DIMENSIONS):
    """Unit vectors of word counts; a word's slot is the first 16 bits of its MD5."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        slots = _Slots(dimensions)
        vectors = np.zeros((len(texts), dimensions), np.float32)
        for begin in range(0, len(texts), TEXTS):
            for row, text in enumerate(texts.slice(begin, TEXTS).to_pylist(), begin):
                if not text:
                    continue
                words = text.lower().replace("\n", " ").split(" ")
                found = np.fromiter(map(slots.__getitem__, words), np.intp, len(words))
                counts = np.bincount(found, minlength=dimensions + 1)[:dimensions]
                norm = np.sqrt((counts**2).sum())
                vectors[row] = counts / norm if norm else counts
        ends = np.arange(len(texts) + 1, dtype=np.int32) * dimensions
        return pa.ListArray.from_arrays(
            pa.array(ends), pa.array(vectors.ravel()), mask=texts.is_null() if texts.null_count else None
        )

    return embed


def embed(col: Column, dimensions: int = DIMENSIONS) -> Column:
    return hashing_embedder(dimensions)(col)
