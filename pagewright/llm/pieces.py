"""N-best segmentation into SentencePiece pieces, and decoding.

The lattice of a text has an edge for every piece of the vocabulary that occurs
in it and, where no piece is a single character, an edge that spells that
character in bytes.  A segmentation's score is the sum of its pieces' scores.

For each place the forward pass finds the score of the best way there from the
begin (Viterbi).  The N best segmentations then come from a best-first search
from the end: a partial path from a place to the end is ranked by its own score
plus the forward score of its place.  That is exactly what the best completion
will have, so paths complete in the order of their scores.  Equal scores
complete in the order in which they were found, shorter last pieces first.

No piece has a blank after another character, so the lattice of a text falls
apart at the blanks.  Each distinct word is searched once per worker; short
words are searched many at a time in numpy, long ones one by one with a heap,
which drops what N others are strictly better than.  The N best of the text are
the N best choices among the words with the smallest losses, of which N-1 are
enough.  So the forward pass keeps the two best scores of every place, which
gives a word's best segmentation and what its second one loses, and a word is
searched for N only if it is among those N-1 of some text.  A worker remembers words and their
segmentations as numbers in a few arrays, up to a number of bytes, and then
keeps those that it has met repeatedly.

Null texts count as empty and have one segmentation, without pieces.  A literal
U+2581 decodes as a blank, as in the library.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.frames import ROW, boxed, known, schema_of, unboxed

N_BEST = 4
BLANK = "▁"
#: Words longer than this are searched one by one; words searched together; bytes of words remembered.
SHORT, TOGETHER, REMEMBERED = 24, 1_024, 96 << 20
#: What a remembered word takes besides its characters and ids.
_WORD_BYTES = 300
#: How much worse than the worst piece a character in bytes is.
BYTES_PENALTY = 10.0
_SPELLED = -2  # a character in bytes, in place of a piece's id
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ODD = f"^ |  | $|^$|{BLANK}"


class Pieces:
    """The pieces of a model file and their scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores = np.full(size, -np.inf)
        self.bytes_of = [b""] * size
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.scores[i] = model.get_score(i)
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        named = self.scores[np.isfinite(self.scores) & (self.scores > -1e9)]
        self.spelled = float(named.min() if len(named) else 0.0) - BYTES_PENALTY
        self.longest = max(map(len, self.ids), default=1)
        self.singles = {p for p in self.ids if len(p) == 1}
        # Hashes of the pieces by length, for lookups of many substrings at once.
        self.tables = []
        for n in range(1, self.longest + 1):
            some = [(p, i) for p, i in self.ids.items() if len(p) == n]
            hashes = np.zeros(len(some), np.uint64)
            if some:
                points = np.frombuffer("".join(p for p, _ in some).encode("utf-32-le"), np.uint32).reshape(-1, n)
                for k in range(n):
                    hashes = hashes * _MULTIPLIER + (points[:, k].astype(np.uint64) + np.uint64(1))
            order = np.argsort(hashes)
            there = np.zeros(1 << 20, bool)
            there[hashes * _MULTIPLIER >> np.uint64(44)] = True
            self.tables.append((hashes[order], np.array([i for _, i in some], np.int32)[order], there))

    def lookup(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        keys, ids, there = self.tables[length - 1]
        found = np.full(hashes.shape, -1, np.int32)
        if not len(keys):
            return found
        maybe = np.nonzero(there[hashes * _MULTIPLIER >> np.uint64(44)])
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found[maybe] = np.where(keys[at] == wanted, ids[at], -1)
        return found

    def spell(self, text: str, path: list[int]) -> list[int]:
        """The ids of a path over ``text``, characters in bytes spelt out."""
        if _SPELLED not in path:
            return path
        result, at = [], 0
        for i in path:
            if i == _SPELLED:
                result += [self.byte_ids[b] for b in text[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                result.append(i)
                at += len(self.bytes_of[i].decode())
        return result

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank put before every text is taken off."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def n_best_of(pieces: Pieces, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of ``text`` (blanks as U+2581) with their scores, by heap."""
    size = len(text)
    lengths, ids, ends = array("i"), array("i"), array("q", [0])
    forward = array("d", [0.0])
    for end in range(1, size + 1):
        best = -np.inf
        for length in range(1, min(pieces.longest, end) + 1):
            i = pieces.ids.get(text[end - length : end])
            if i is None and length > 1:
                continue
            lengths.append(length)
            ids.append(_SPELLED if i is None else i)
            best = max(best, forward[end - length] + (pieces.spelled if i is None else pieces.scores[i]))
        forward.append(best)
        ends.append(len(ids))
    agenda, turn, found, room = [(-forward[size], 0, size, 0.0, None)], 0, [], 16 * n
    while agenda and len(found) < n:
        rank, _, place, own, path = heapq.heappop(agenda)
        if place == 0:
            whole = []
            while path is not None:
                whole.append(path[0])
                path = path[1]
            found.append((-rank, pieces.spell(text, whole)))
            continue
        for e in range(ends[place - 1], ends[place]):
            begin, i = place - lengths[e], ids[e]
            score = pieces.spelled if i == _SPELLED else pieces.scores[i]
            turn += 1
            heapq.heappush(agenda, (-(forward[begin] + own + score), turn, begin, own + score, (i, path)))
        if len(agenda) > room:
            # Each entry has a completion of its own with just its rank.
            worst = heapq.nsmallest(n, agenda)[-1][0]
            agenda = [entry for entry in agenda if entry[0] <= worst]
            heapq.heapify(agenda)
            room = max(16 * n, 2 * len(agenda))
    return found


def n_best_together(
    pieces: Pieces, words: list[str], n: int, paths: int
) -> tuple[np.ndarray, list[list[list[int]]]]:
    """``n_best_of`` of many short, non-empty words.

    Gives the scores, -inf where there is no further one, and the ids of the first ``paths``.
    """
    totals, found = _search_together(pieces, words, n, paths)
    result: list[list[list[int]]] = [[] for _ in words]
    for ids, sizes in found:
        parts = iter(np.split(ids, np.cumsum(sizes[sizes >= 0])[:-1]) if (sizes >= 0).any() else [])
        for w in np.flatnonzero(sizes >= 0):
            result[w].append(next(parts).tolist())
    return totals, result


def _lattice(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The characters of words (plus 1) and their lengths, and the ids and scores of the edges by
    word, end and length - 1; -1 and -inf where there is none."""
    count, size = len(words), max(map(len, words))
    lengths = np.array([len(w) for w in words])
    points = np.zeros((count, size), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    points[np.arange(size)[None, :] < lengths[:, None]] = flat.astype(np.uint64) + np.uint64(1)
    widest = min(pieces.longest, size)
    edge = np.full((count, size + 1, widest), -1, np.int32)  # word, end, length - 1
    hashes = np.zeros((count, size), np.uint64)
    for k in range(1, widest + 1):
        hashes = hashes[:, : size - k + 1] * _MULTIPLIER + points[:, k - 1 :]
        edge[:, k:, k - 1] = pieces.lookup(hashes, k)
    edge[:, 1:, 0][edge[:, 1:, 0] < 0] = _SPELLED
    edge[np.arange(size + 1)[None, :] > lengths[:, None]] = -1
    score_of = np.concatenate([pieces.scores, [pieces.spelled, -np.inf]])  # at -2 and -1
    return points, lengths, edge, score_of[edge]


def _two_best_together(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The forward pass with the two best scores of every place: the scores of many short words' two
    best segmentations, and the ids of the best, which is where a search from the end comes first."""
    points, lengths, edge, worth = _lattice(pieces, words)
    count, size = points.shape
    first, second = np.full((count, size + 1), -np.inf), np.full((count, size + 1), -np.inf)
    first[:, 0] = 0
    back = np.zeros((count, size + 1), np.int64)
    rows = np.arange(count)
    for end in range(1, size + 1):
        k = min(edge.shape[2], end)
        reach = first[:, end - k : end][:, ::-1] + worth[:, end, :k]
        last = reach.argmax(axis=1)  # of equal ones the shortest last piece
        first[:, end], back[:, end] = reach[rows, last], last
        # The second best way here has another last piece, or is second best where the best one came from.
        reach[rows, last] = second[rows, end - 1 - last] + worth[rows, end, last]
        second[:, end] = reach.max(axis=1)
    at, steps, places = lengths.copy(), [], []
    while at.any():
        last = back[rows, at]
        steps.append(np.where(at > 0, edge[rows, at, last], -1))
        at = np.maximum(at - last - 1, 0)
        places.append(at)
    matrix, begins = np.stack(steps[::-1], axis=1), np.stack(places[::-1], axis=1)
    row, column = np.nonzero(matrix != -1)
    flat, spelled = matrix[row, column], matrix[row, column] == _SPELLED
    if spelled.any():
        character = (points[row[spelled], begins[row, column][spelled]] - np.uint64(1)).astype(np.int64)
        flat, row = _spelt(pieces, flat, row, spelled, character)
    totals = np.stack([first[rows, lengths], second[rows, lengths]], axis=1)
    return totals, [(flat.astype(np.int32), np.bincount(row, minlength=count))]


def _search_together(
    pieces: Pieces, words: list[str], n: int, paths: int
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """All searches one step at a time: the scores and, for each of the first ``paths`` places, the
    words' ids one after another and how many each has, -1 where it has no such segmentation.
    """
    points, lengths, edge, worth = _lattice(pieces, words)
    count, size = points.shape
    widest = edge.shape[2]
    forward = np.full((count, size + 1), -np.inf)
    forward[:, 0] = 0
    for end in range(1, size + 1):
        k = min(widest, end)
        begins = forward[:, end - k : end][:, ::-1]  # shorter pieces first
        forward[:, end] = (begins + worth[:, end, :k]).max(axis=1)

    room = 64
    rank = np.full((count, room), -np.inf)
    own = np.zeros((count, room))
    place = np.zeros((count, room), np.int16)
    piece = np.full((count, room), -1, np.int32)
    parent = np.full((count, room), -1, np.int32)
    rows = np.arange(count)
    rank[:, 0], place[:, 0] = forward[rows, lengths], lengths
    used = np.ones(count, np.int64)
    ends = np.full((count, n), -1, np.int64)
    totals = np.full((count, n), -np.inf)
    done = np.zeros(count, np.int64)
    active = rows
    while len(active):
        width = int(used[active].max())
        best = rank[active, :width].argmax(axis=1)
        value = rank[active, best]
        live = value > -np.inf
        active, best, value = active[live], best[live], value[live]
        rank[active, best] = -np.inf
        at = place[active, best].astype(np.int64)
        whole = at == 0
        finished = active[whole]
        ends[finished, done[finished]] = best[whole]
        totals[finished, done[finished]] = value[whole]
        done[finished] += 1
        grow, at, best = active[~whole], at[~whole], best[~whole]
        if len(grow) and used[grow].max() + widest >= rank.shape[1]:
            wider = lambda a, fill: np.concatenate([a, np.full((count, room), fill, a.dtype)], axis=1)
            rank, own, place = wider(rank, -np.inf), wider(own, 0), wider(place, 0)
            piece, parent = wider(piece, -1), wider(parent, -1)
        before = own[grow, best]
        choices = edge[grow, at]
        which, k = np.nonzero(choices != -1)  # word after word, shorter pieces first
        w, e = grow[which], choices[which, k]
        fan = np.bincount(which, minlength=len(grow))
        slot = used[w] + np.arange(len(w)) - np.repeat(np.cumsum(fan) - fan, fan)
        total = before[which] + worth[w, at[which], k]
        to = at[which] - k - 1
        own[w, slot], piece[w, slot], parent[w, slot] = total, e, best[which]
        place[w, slot], rank[w, slot] = to, forward[w, to] + total
        used[grow] += fan
        active = active[done[active] < n]

    result = []
    for k in range(min(n, paths)):
        some = np.flatnonzero(ends[:, k] >= 0)
        at, steps, places = ends[some, k], [], []
        while True:
            step = np.where(at > 0, piece[some, at], -1)
            if (step == -1).all():
                break
            steps.append(step)
            places.append(place[some, at])
            at = np.where(at > 0, parent[some, at], 0)
        sizes = np.full(count, -1, np.int64)
        sizes[some] = 0
        if not steps:
            result.append((np.zeros(0, np.int32), sizes))
            continue
        matrix = np.stack(steps, axis=1)
        row, column = np.nonzero(matrix != -1)
        flat = matrix[row, column]
        spelled = flat == _SPELLED
        if spelled.any():
            begins = np.stack(places, axis=1)[row[spelled], column[spelled]]
            character = (points[some[row[spelled]], begins] - np.uint64(1)).astype(np.int64)
            flat, row = _spelt(pieces, flat, row, spelled, character)
        sizes[some] = np.bincount(row, minlength=len(some))
        result.append((flat.astype(np.int32), sizes))
    return totals, result


def _spelt(
    pieces: Pieces, flat: np.ndarray, row: np.ndarray, spelled: np.ndarray, character: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ids with those of the UTF-8 bytes of ``character`` in place of the spelled ones, and their rows."""
    bytes_each = 1 + (character > 0x7F) + (character > 0x7FF) + (character > 0xFFFF)
    each = np.ones(len(flat), np.int64)
    each[spelled] = bytes_each
    ids = np.repeat(flat, each)
    inside = np.repeat(spelled, each)
    number = np.arange(bytes_each.sum()) - np.repeat(np.cumsum(bytes_each) - bytes_each, bytes_each)
    size, point = np.repeat(bytes_each, bytes_each), np.repeat(character, bytes_each)
    bits = point >> (6 * (size - 1 - number))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    value = np.where(number == 0, lead | bits, 0x80 | (bits & 0x3F))
    ids[inside] = np.array(pieces.byte_ids)[value]
    return ids, np.repeat(row, each)


class Segmenter:
    """N-best segmentation of texts, remembering the words it has met."""

    def __init__(self, path: str, n: int = N_BEST, keep: bool = False):
        self.pieces, self.n, self.keep = _pieces(path), n, keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.ids = np.zeros(0, np.int32)  # of all segmentations of all words
        self.bytes = 0
        # Of each word: its two best scores, where its best segmentation stands, its row among the deep ones.
        self.totals = np.zeros((0, 2))
        self.starts = self.sizes = np.zeros((0, 1), np.int64)
        self.deep = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)  # slices of texts with the word
        # Of words searched for all n: the scores, and where all segmentations stand.
        self.deep_totals = np.zeros((0, self.n))
        self.deep_starts = self.deep_sizes = np.zeros((0, self.n), np.int64)

    def _search(self, words: list[str], n: int, paths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the ``n`` best of words, shortest first, and where the first ``paths`` stand in ``ids``."""
        short = sum(len(w) < SHORT for w in words)
        totals, starts, sizes, ids = [], [], [], [self.ids]
        used = len(self.ids)
        searched = []
        for at in range(0, short, TOGETHER):
            some = [BLANK + w for w in words[at : min(at + TOGETHER, short)]]
            two = n == 2 and paths == 1
            searched.append(
                _two_best_together(self.pieces, some) if two else _search_together(self.pieces, some, n, paths)
            )
        for word in words[short:]:
            found = n_best_of(self.pieces, BLANK + word, n)
            total = np.array([[f[0] for f in found] + [-np.inf] * (n - len(found))])
            searched.append((total, [(np.array(f[1], np.int32), np.array([len(f[1])])) for f in found[:paths]]))
        for total, found in searched:
            begin, size = np.zeros((len(total), paths), np.int64), np.full((len(total), paths), -1)
            for k, (flat, each) in enumerate(found):
                taken = np.maximum(each, 0)
                begin[:, k], size[:, k] = used + np.cumsum(taken) - taken, each
                ids.append(flat)
                used += len(flat)
            totals.append(total)
            starts.append(begin)
            sizes.append(size)
        self.ids = np.concatenate(ids)
        return np.concatenate(totals), np.concatenate(starts), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> None:
        """Search the two best segmentations of those words that are new."""
        new = sorted((w for w in words if w not in self.known), key=len)
        if not new:
            return
        totals, starts, sizes = self._search(new, 2, 1)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.names += new
        self.totals = np.concatenate([self.totals, totals])
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.deep = np.concatenate([self.deep, np.full(len(new), -1)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.bytes += 4 * sum(map(len, new)) + _WORD_BYTES * len(new)

    def _deepen(self, numbers: np.ndarray) -> None:
        """Search all n best segmentations of those words that have only two so far."""
        new = np.unique(numbers[self.deep[numbers] < 0])
        if not len(new):
            return
        new = new[np.argsort([len(self.names[i]) for i in new], kind="stable")]
        totals, starts, sizes = self._search([self.names[i] for i in new], self.n, self.n)
        self.deep[new] = np.arange(len(self.deep_totals), len(self.deep_totals) + len(new))
        self.deep_totals = np.concatenate([self.deep_totals, totals])
        self.deep_starts = np.concatenate([self.deep_starts, starts])
        self.deep_sizes = np.concatenate([self.deep_sizes, sizes])
        self.bytes += 24 * self.n * len(new)

    def _shrink(self) -> None:
        """Keep the words met repeatedly, a third of all at most, and forget the others."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > len(self.names) // 3:
            kept = kept[np.argsort(-self.met[kept], kind="stable")[: len(self.names) // 3]]
        names, totals, deep, met = [self.names[i] for i in kept], self.totals[kept], self.deep[kept], self.met[kept]
        searched = np.flatnonzero(deep >= 0)
        rows = deep[searched]
        parts, moved, used = [], [], 0
        for starts, sizes in ((self.starts[kept], self.sizes[kept]), (self.deep_starts[rows], self.deep_sizes[rows])):
            taken = np.maximum(sizes, 0).ravel()
            parts.append(self._gather(starts.ravel(), taken))
            moved.append(((used + np.cumsum(taken) - taken).reshape(sizes.shape), sizes))
            used += len(parts[-1])
        deep_totals = self.deep_totals[rows]
        self._forget()
        self.names, self.known = names, dict(zip(names, range(len(names))))
        self.ids, self.totals, self.met, self.deep_totals = np.concatenate(parts), totals, met // 2, deep_totals
        (self.starts, self.sizes), (self.deep_starts, self.deep_sizes) = moved
        self.deep = np.full(len(names), -1)
        self.deep[searched] = np.arange(len(searched))
        self.bytes = 4 * sum(map(len, names)) + _WORD_BYTES * len(names) + 24 * self.n * len(rows)

    def _near(self, losses: np.ndarray) -> np.ndarray:
        """The places of the n - 1 words of a text whose second segmentations lose least."""
        few = min(self.n - 1, len(losses))
        near = np.argpartition(losses, few - 1)[:few] if 0 < few < len(losses) else np.arange(few)
        near = near[np.lexsort((near, losses[near]))]
        return near[np.isfinite(losses[near])]

    def _choices(self, near: np.ndarray, losses: np.ndarray) -> tuple[np.ndarray, list[dict[int, int]]]:
        """What the n best of a text lose, and where they do not take a word's best."""
        lost, taken = np.zeros(1), [{}]
        for place, own in zip(near.tolist(), losses):
            sums = (lost[:, None] + own[None, :]).ravel()
            order = np.argsort(sums, kind="stable")[: self.n]
            order = order[np.isfinite(sums[order])]
            lost = sums[order]
            taken = [taken[i // self.n] | ({place: i % self.n} if i % self.n else {}) for i in order.tolist()]
        return lost, taken

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, one after another, and how many each has."""
        if self.bytes + self.ids.nbytes > REMEMBERED:
            self._shrink()
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        apart = [self._odd_words(t) for t in texts.filter(odd).to_pylist()]
        self._learn(list(dict.fromkeys(itertools.chain(distinct, *apart))))
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.met[numbers] += 1
        at = numbers[numbered.indices.to_numpy()]
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if apart:
            plain = iter(np.split(at, np.cumsum(per_text)[:-1]) if len(per_text) else [])
            others = iter(apart)
            each = [
                np.array([self.known[w] for w in next(others)], np.int64) if o else next(plain) for o in odd.to_pylist()
            ]
            at, per_text = np.concatenate(each), np.array([len(e) for e in each], np.int64)
        return at, per_text

    def _gather(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        reached = np.cumsum(sizes)
        return self.ids[np.repeat(starts - (reached - sizes), sizes) + np.arange(sizes.sum())]

    def best_of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For each text the scores of its n best segmentations and, if kept, the ids of each, else of the best."""
        at, per_text = self._words(texts)
        totals = self.totals[at]
        losses = totals[:, 0] - totals[:, 1]
        summed = np.concatenate([[0.0], np.cumsum(totals[:, 0])])
        ends = np.cumsum(per_text)
        begins = ends - per_text
        near = [self._near(losses[begin:end]) for begin, end in zip(begins, ends)]
        self._deepen(np.concatenate([at[begin + n] for begin, n in zip(begins, near)] or [at]))
        for begin, end, places in zip(begins.tolist(), ends.tolist(), near):
            words = at[begin:end]
            deep = self.deep[words[places]]
            lost, others = self._choices(places, self.deep_totals[deep, :1] - self.deep_totals[deep])
            starts, sizes = self.starts[words, 0], self.sizes[words, 0]
            # Of equally good ones, those the search from the end gives.
            starts[places], sizes[places] = self.deep_starts[deep, 0], self.deep_sizes[deep, 0]
            found = []
            for other in others if self.keep else others[:1]:
                own, each = starts, sizes
                if other:
                    place, k = np.array(list(other.items())).T
                    own, each = starts.copy(), sizes.copy()
                    row = self.deep[words[place]]
                    own[place], each[place] = self.deep_starts[row, k], self.deep_sizes[row, k]
                found.append(self._gather(own, each))
            yield (summed[end] - summed[begin]) - lost, found

    def segment(self, texts: pa.Array):
        """The ids of the best segmentations one after another, how many each text has, for each
        text the scores of its n best and, if kept, their ids."""
        scores, choices = [], []
        for score, found in self.best_of(texts):
            scores.append(score)
            choices.append(found)
        sizes = np.array([len(found[0]) for found in choices], np.int64)
        ids = np.concatenate([found[0] for found in choices]) if choices else np.zeros(0, np.int32)
        return ids, sizes, scores, [[ids.tolist() for ids in found] for found in choices] if self.keep else []

    @staticmethod
    def _odd_words(text: str) -> list[str]:
        """The parts of a text that no piece crosses: blanks and what follows them."""
        if not text:
            return []
        parts: list[str] = []
        for word in (BLANK + text.replace(" ", BLANK)).split(BLANK)[1:]:
            if parts and not parts[-1].strip(BLANK):
                parts[-1] += BLANK + word
            else:
                parts.append(word)
        return parts


_SEGMENTERS: dict[tuple[str, int, bool], Segmenter] = {}


def _segmenter(path: str, n: int, keep: bool) -> Segmenter:
    if (path, n, keep) not in _SEGMENTERS:
        _SEGMENTERS[path, n, keep] = Segmenter(path, n, keep)
    return _SEGMENTERS[path, n, keep]


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


_NESTED = pa.list_(pa.list_(pa.int32()))


def _nested(choices: Sequence[list[np.ndarray]]) -> pa.Array:
    """Lists of lists of ids, without Python's integers."""
    flat = [ids for found in choices for ids in found]
    inner = np.cumsum([0, *map(len, flat)]).astype(np.int32)
    outer = np.cumsum([0, *map(len, choices)]).astype(np.int32)
    ids = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), ids))


def encode_documents(
    docs: DataFrame, vocabulary: str, text: str = "text", n: int = N_BEST, all_ids: bool = False
) -> DataFrame:
    """``docs`` with pieces (ids of the best segmentation), scores (of the n best, best first)
    and, with ``all_ids``, alternatives (ids of each of the n best).

    ``vocabulary`` is the path of a SentencePiece model on every machine.
    """
    rows = boxed(docs, text=known(text))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(vocabulary, n, all_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                scores, choices = zip(*segmenter.best_of(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(ROW),
                        _nested([[found[0]] for found in choices]).flatten(),
                        pa.array(scores, pa.list_(pa.float64())),
                        _nested(choices) if all_ids else pa.nulls(piece.num_rows, _NESTED),
                    ],
                    [ROW, "pieces", "scores", "alternatives"],
                )

    more = "pieces array<int>, scores array<double>, alternatives array<array<int>>"
    found = rows.mapInArrow(encode, schema_of(rows, [ROW], more))
    names = ["pieces", "scores", *(["alternatives"] if all_ids else [])]
    return unboxed(found, {c: F.col(c) for c in names})


def report_segmentations(docs: DataFrame, vocabulary: str, text: str = "text", n: int = N_BEST) -> DataFrame:
    """``docs`` without their text, with scores (of the n best, best first) and, for each of the n
    best segmentations, all_sizes (its pieces) and all_crc32 (of its ids as little-endian unsigned
    32-bit integers), and all_back: whether every one of them decodes to the text.

    All is done where the segmentations are, a text at a time; only numbers leave the task.
    """
    rest = F.struct(*[c for c in docs.columns if c != text]).alias(ROW)
    rows = docs.select(rest, known(text).alias("text"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(vocabulary, n, True)
        table = segmenter.pieces
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                scores, sizes, sums, back = [], [], [], []
                texts = piece.column("text")
                for whole, (score, found) in zip(texts, segmenter.best_of(texts)):
                    want = whole.as_py().replace(BLANK, " ")
                    scores.append(score)
                    sizes.append([len(ids) for ids in found])
                    sums.append([zlib.crc32(ids.astype("<u4", copy=False)) for ids in found])
                    back.append(all(table.decode(ids.tolist()) == want for ids in found))
                columns = [
                    piece.column(ROW),
                    pa.array(scores, pa.list_(pa.float64())),
                    pa.array(sizes, pa.list_(pa.int64())),
                    pa.array(sums, pa.list_(pa.int64())),
                    pa.array(back, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [ROW, "scores", "all_sizes", "all_crc32", "all_back"])

    more = "scores array<double>, all_sizes array<long>, all_crc32 array<long>, all_back boolean"
    found = rows.mapInArrow(report, schema_of(rows, [ROW], more))
    return unboxed(found, {c: F.col(c) for c in ("scores", "all_sizes", "all_crc32", "all_back")})


def decode_documents(docs: DataFrame, vocabulary: str, pieces: str = "pieces") -> DataFrame:
    """``docs`` with decoded (the text of the ids in ``pieces``) and pieces_crc32 (of the ids
    as little-endian unsigned 32-bit integers)."""
    rows = boxed(docs, ids=F.col(pieces))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces(vocabulary)
        for batch in batches:
            texts, sums = [], []
            for scalar in batch.column("ids"):
                ids = scalar.values.to_numpy() if scalar.is_valid else np.zeros(0, np.int32)
                texts.append(table.decode(ids.tolist()) if scalar.is_valid else None)
                sums.append(zlib.crc32(ids.astype("<u4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array(texts, pa.string()), pa.array(sums, pa.int64())],
                [ROW, "decoded", "pieces_crc32"],
            )

    found = rows.mapInArrow(decode, schema_of(rows, [ROW], "decoded string, pieces_crc32 long"))
    return unboxed(found, {"decoded": F.col("decoded"), "pieces_crc32": F.col("pieces_crc32")})


def check_alternatives(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs``, which have alternatives, with all_crc32 (of the ids of each) and all_back (whether
    each decodes to the text)."""
    rows = boxed(docs, text=known(text), ids=F.col("alternatives"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces(vocabulary)
        for batch in batches:
            sums, back = [], []
            for whole, every in zip(batch.column("text"), batch.column("ids")):
                want, lists = whole.as_py().replace(BLANK, " "), [ids.values.to_numpy() for ids in every.values]
                sums.append([zlib.crc32(ids.astype("<u4")) for ids in lists])
                back.append(all(table.decode(ids.tolist()) == want for ids in lists))
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array(sums, pa.list_(pa.int64())), pa.array(back, pa.bool_())],
                [ROW, "all_crc32", "all_back"],
            )

    found = rows.mapInArrow(check, schema_of(rows, [ROW], "all_crc32 array<long>, all_back boolean"))
    return unboxed(found, {"all_crc32": F.col("all_crc32"), "all_back": F.col("all_back")})
