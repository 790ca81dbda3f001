"""Word hashes and bags of word shingles for batches of texts, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of a shingle's hash.
HASH_BITS = 48


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values, one for each value."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def runs_of(sizes: np.ndarray) -> np.ndarray:
    """The number of its run for each place of runs of ``sizes``."""
    return np.repeat(np.arange(len(sizes)), sizes)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each lower-case word of each text, and the words of each text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat = lists.flatten()
    numbered = flat.dictionary_encode()
    named = numbered.dictionary.to_pylist()
    sizes = np.array([len(w) for w in named], np.int64)
    points = np.frombuffer("".join(named).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    offset = np.arange(len(points)) - np.repeat(starts, sizes)
    each = mixed((points + np.uint64(1)) * _A + offset.astype(np.uint64) * _B)
    hashes = np.zeros(len(named), np.uint64)
    full = sizes > 0
    if full.any():
        hashes[full] = np.add.reduceat(each, starts[full])
    hashes = mixed(hashes + sizes.astype(np.uint64))
    at = numbered.indices.to_numpy()
    owner = runs_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    there = full[at]  # white space at an end makes an empty word
    return hashes[at[there]], np.bincount(owner[there], minlength=len(texts))


def fingerprints(words: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    starts = np.cumsum(per_text) - per_text
    place = (np.arange(len(words)) - np.repeat(starts, per_text)).astype(np.uint64)
    result = []
    for salt in (_A, _C):
        each = mixed(words * salt + mixed(place + salt))
        sums = np.zeros(len(per_text), np.uint64)
        full = per_text > 0
        if full.any():
            sums[full] = np.add.reduceat(each, starts[full])
        result.append(mixed(sums + per_text.astype(np.uint64)).view(np.int64))
    return result[0], result[1]


def bags(words: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, ordered by text and hash.

    A text with fewer words than ``size``, but some, has one shingle: all of them.
    At most 65,536 texts.
    """
    owner = runs_of(per_text)
    texts, hashes = [], []
    if len(words) >= size:
        rolling = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolling = rolling * _A + words[k : k + len(rolling)]
        inside = owner[: len(rolling)] == owner[size - 1 :]
        texts.append(owner[: len(rolling)][inside])
        hashes.append(mixed(rolling[inside]))
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        starts = (np.cumsum(per_text) - per_text)[short]
        rolling = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = per_text[short] > k
            rolling[more] = rolling[more] * _A + words[starts[more] + k]
        texts.append(short)
        hashes.append(mixed(rolling + per_text[short].astype(np.uint64)))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint64(HASH_BITS)
    keys = np.concatenate(texts).astype(np.uint64) << shift
    keys |= np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (
        (keys >> shift).astype(np.int64),
        (keys & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64),
        counts,
    )


def bag_min_hashes(
    texts: np.ndarray, shingles: np.ndarray, counts: np.ndarray, n_texts: int, slots: int
) -> np.ndarray:
    """BagMinHash signatures: for each text and slot the first time a point falls there.

    Weights are cut into the levels 0, 1, 2-3, 4-7, ...  Every shingle has a Poisson
    process over each of these intervals, with a rate as large as the interval, the
    same in every text.  Its points come in the order of time; each has a slot and
    a level within the interval, and counts only below the shingle's weight.  A
    process ends where it passes the latest time that still stands in a slot.  Two
    texts agree in a slot with their weighted Jaccard similarity as probability.
    """
    first = np.full(n_texts * slots, np.inf)
    top = np.full(n_texts, np.inf)
    lows, widths = [0], [1]
    while len(counts) and lows[-1] + widths[-1] < counts.max():
        lows.append(lows[-1] + widths[-1])
        widths.append(lows[-1])
    for k, (low, width) in enumerate(zip(lows, widths)):
        those = counts > low if k else slice(None)
        text, weight = texts[those], counts[those]
        state = mixed(shingles[those].astype(np.uint64) * _A + np.uint64(k + 1))
        time = np.zeros(len(text))
        while len(text):
            state = mixed(state + _A)
            time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
            going = time < top[text]
            text, weight, state, time = text[going], weight[going], state[going], time[going]
            drawn = mixed(state ^ _C)
            at = text * slots + ((drawn >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            if width == 1:
                np.minimum.at(first, at, time)
            else:
                level = low + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
                counted = level < weight
                np.minimum.at(first, at[counted], time[counted])
            seen = np.flatnonzero(np.bincount(text, minlength=n_texts))
            top[seen] = first.reshape(n_texts, slots)[seen].max(axis=1)
    return first.reshape(n_texts, slots)
