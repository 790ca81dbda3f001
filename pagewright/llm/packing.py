"""Token ids in a file of fixed-width bit-packed blocks.

A file is a Parquet table written by Spark, one row for each block of whole
documents in ascending identifier order.  A block stores the ids of its
documents one after another, each in the fewest bits that hold every id of the
vocabulary, most significant bit first, and padded to whole bytes at its end:

==========  =====================================================================
part        number of the range of identifiers the block belongs to
block       number of the block within its part
width       bits of an id
n_ids       ids in the block
first       ids of the part before the block
doc_ids     identifiers of its documents (a null identifier comes last)
ends        for each document the number of ids in the block up to its end
payload     the packed ids
==========  =====================================================================

Id number i of a block begins at bit i * width, so any range of ids is read
without what stands before it.  A block closes at the first document end past
``BLOCK_IDS`` ids; a longer document has a block of its own.

Null texts count as empty: their only id is the end id.  Documents with equal
identifiers keep an order by their texts' hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.frames import known, pieces_of, stored

BLOCK_IDS = 65_536
#: Documents by which the table is cut into ranges of identifiers.
PART_DOCUMENTS = 5_000
#: Words whose ids a worker remembers.
REMEMBERED = 800_000

BLOCKS = (
    "part int, block int, width int, n_ids long, first long, doc_ids array<long>, ends array<long>, payload binary"
)


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, most significant bit first."""
    if width == 16:  # whole bytes need no bits moved
        return ids.astype(">u2").tobytes()
    bits = (ids[:, None] >> np.arange(width - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a payload, reading only their bytes."""
    begin = first * width
    end = begin + count * width
    raw = np.frombuffer(payload, np.uint8)[begin // 8 : -(-end // 8)]
    if width == 16:
        return raw.view(">u2").astype(np.uint32)
    bits = np.unpackbits(raw)[begin % 8 : begin % 8 + count * width].reshape(count, width)
    return bits.astype(np.uint32) @ (1 << np.arange(width - 1, -1, -1)).astype(np.uint32)


#: A blank before a character that is not white space always begins a new
#: pre-token of the byte-level tokenizer, so the pieces between such blanks
#: encode alone.  Texts with any other blank are encoded whole.
_ODD_BLANK = r" ([\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]|$)"


class WordTokenizer:
    """The tokenizer applied to the pieces between blanks, each new piece once.

    Pieces are found and numbered a batch at a time; only distinct ones meet
    Python.  New ones are encoded in long strings and told apart by the bytes
    that each id stands for.  Past ``remembered`` pieces, all are forgotten.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.remembered = remembered
        # The vocabulary spells each byte as one character, but for added tokens.
        self.spans = np.zeros(self.size, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.spans[number] = len(token)
        for number, added in self.tokenizer.get_added_tokens_decoder().items():
            self.spans[number] = len(added.content.encode())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = [np.zeros(0, np.uint32)]
        self.sizes = [np.zeros(0, np.int64)]

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a blank and each word, one after another, and their numbers."""
        joined = self._each([" " + " ".join(words)])[0]
        reached = np.cumsum(self.spans[joined])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(reached, ends) + 1
        if not np.array_equal(reached[cuts - 1], ends):
            each = self._each([" " + w for w in words])
            return np.concatenate(each), np.array([len(e) for e in each], np.int64)
        return joined, np.diff(cuts, prepend=0)

    def _learn(self, words: list[str]) -> np.ndarray:
        """The numbers of the words in the pool, new ones added."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        for begin in range(0, len(new), 2_000):
            these = new[begin : begin + 2_000]
            named = [words[i] for i in these]
            numbers = np.arange(len(self.known), len(self.known) + len(these))
            self.known.update(zip(named, numbers.tolist()))
            ids, sizes = self._apart(named)
            self.pool.append(ids)
            self.sizes.append(sizes)
            at[these] = numbers
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        odd = pc.match_substring_regex(texts, _ODD_BLANK)
        if pc.any(odd).as_py():
            whole = self._each(texts.filter(odd).to_pylist())
            plain, plain_sizes = self.encode(texts.filter(pc.invert(odd)))
            parts = iter(np.split(plain, np.cumsum(plain_sizes)[:-1]) if len(plain_sizes) else [])
            mixed = [next(parts) if not o else None for o in odd.to_pylist()]
            rest = iter(whole)
            mixed = [m if m is not None else next(rest) for m in mixed]
            return np.concatenate(mixed), np.array([len(m) for m in mixed], np.int64)
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > self.remembered:
            self._forget()
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        numbered = lists.flatten().dictionary_encode()
        at = self._learn(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()]
        # First words have no blank before them.
        first = self._each(lists.flatten().take(pa.array(ends[:-1])).to_pylist())
        pool, sizes = np.concatenate([*self.pool, *first]), np.concatenate(self.sizes)
        self.pool, self.sizes = [pool[: len(pool) - sum(map(len, first))]], [sizes]
        sizes = np.concatenate([sizes, [len(f) for f in first]])
        starts = np.cumsum(sizes) - sizes
        at[ends[:-1]] = np.arange(len(self.known), len(self.known) + len(first))
        taken = sizes[at]
        reached = np.cumsum(taken)
        places = np.repeat(starts[at] - (reached - taken), taken) + np.arange(reached[-1])
        return pool[places], np.diff(reached[ends[1:] - 1], prepend=0)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def encode_blocks(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    text: str = "text",
    ident: str = "doc_id",
    block_ids: int = BLOCK_IDS,
    part_documents: int = PART_DOCUMENTS,
) -> DataFrame:
    """The blocks of all documents, in the columns of the file format.

    ``vocabulary`` is the path of a byte-level tokenizer file on every machine.
    """
    rows = docs.select(F.col(ident).cast("long").alias("id"), known(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = pieces_of(docs.count(), part_documents)
    order = [F.col("id").asc_nulls_last(), F.col("tie")]
    ranged = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order, "text")
        .select("id", "text", F.spark_partition_id().alias("part"))
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        width = width_of(max(tokenizer.size, end_id + 1))
        number, first, ids, ends, held, part = 0, 0, [], [], [], None

        def block():
            joined = np.concatenate(held)
            row = [[part], [number], [width], [len(joined)], [first], [ids], [ends], [pack(joined, width)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, _ARROW.types)], schema=_ARROW
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                piece = batch.slice(at, 2_048)
                part = piece.column("part")[0].as_py()
                found, sizes = tokenizer.encode(piece.column("text"))
                reached = np.cumsum(sizes)
                whole = np.insert(found, reached, end_id)  # the end id follows each document
                firsts = (reached - sizes + np.arange(len(sizes))).tolist()
                lasts = (reached + 1 + np.arange(len(sizes))).tolist()
                for name, a, b in zip(piece.column("id").to_pylist(), firsts, lasts):
                    held.append(whole[a:b])
                    ids.append(name)
                    ends.append((ends[-1] if ends else 0) + b - a)
                    if ends[-1] >= block_ids:
                        yield block()
                        number, first, ids, ends, held = number + 1, first + ends[-1], [], [], []
        if ids:
            yield block()

    return ranged.mapInArrow(blocks, BLOCKS)


_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("width", pa.int32()),
        ("n_ids", pa.int64()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def write_blocks(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """The file of ``docs``, written and opened again; in the shared folder if no path is given."""
    blocks = encode_blocks(docs, vocabulary, end_id, **options)
    if path is None:
        return stored(blocks, "token-blocks")
    blocks.write.parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def with_starts(blocks: DataFrame) -> DataFrame:
    """Blocks with ``start``: the ids in all blocks before.

    A block knows its place in its part; one row for each part is added up and
    stored, so that its size is known before any payload would move.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        blocks.groupBy("part")
        .agg(F.sum("n_ids").alias("part_ids"))
        .select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    )
    return blocks.join(stored(parts, "parts"), "part").withColumn("start", F.col("part_start") + F.col("first"))


def documents_in(blocks: DataFrame) -> DataFrame:
    """A row for each document of a file: doc_id, start, n_tokens and its ids, read from the blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = 0
                for at in range(0, len(row["ends"]), 512):
                    names, starts, sizes, ids = [], [], [], []
                    for name, end in zip(row["doc_ids"][at : at + 512], row["ends"][at : at + 512]):
                        names.append(name)
                        starts.append(row["start"] + first)
                        sizes.append(end - first)
                        ids.append(unpack(row["payload"], row["width"], first, end - first))
                        first = end
                    yield _rows(names, starts, sizes, [pa.array(np.concatenate(ids).astype(np.int32))])

    return with_starts(blocks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids array<int>")


def _rows(names, starts, sizes, ids):
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    columns = [
        pa.array(names, pa.int64()),
        pa.array(starts, pa.int64()),
        pa.array(sizes, pa.int64()),
        pa.ListArray.from_arrays(offsets, ids[0]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])


def checksums(blocks: DataFrame) -> DataFrame:
    """For each document of a file: doc_id, start, n_tokens and the CRC-32 of its unpacked ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], 0, row["n_ids"]).astype("<u4")
                ends = np.array(row["ends"], np.int64)
                firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(firsts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["start"] + firsts, pa.int64()),
                        pa.array(ends - firsts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return with_starts(blocks).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
