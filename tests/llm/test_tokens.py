import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_cases import LONG, ROWS, none, odd

from pagewright.llm.packing import (
    WordTokenizer, checksums, documents_in, pack, unpack, width_of, write_blocks,
)
from pagewright.llm.pieces import (
    BLANK, Pieces, Segmenter, decode_documents, encode_documents, n_best_of, n_best_together,
)

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [
    "", "a", " a", "  b c", "a  b", "a \n b", "x\n\ny z ", "a<|endoftext|>b c", "don't it's  'tis", "ä ö ü  k",
    "日本 語　x", "\x1c \x1cfoo \x85", "tail ", "one", "  em", "tab\t tab", "a  b",
]


@pytest.mark.parametrize("width", [1, 3, 13, 16, 17, 24])
def test_packed_ids_come_back_from_any_place(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1_001).astype(np.uint32)
    payload = pack(ids, width)
    assert len(payload) == -(-1_001 * width // 8)
    for first, count in ((0, 1_001), (0, 0), (1_000, 1), (7, 13), (512, 300)):
        assert unpack(payload, width, first, count).tolist() == ids[first : first + count].tolist()
    assert width_of(1 << width) == width and width_of((1 << width) + 1) == width + 1


def test_pieces_between_blanks_encode_as_the_whole_text():
    words = WordTokenizer(BYTES, remembered=20)
    for _ in range(2):
        ids, sizes = words.encode(pa.array(ODD_TEXTS))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for text, part in zip(ODD_TEXTS, parts):
            assert part.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_file_of_odd_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "last of all"), (3, None), (3, "again"), (-9, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = write_blocks(docs, BYTES, 2, str(tmp_path / "file"), block_ids=40, part_documents=6)
    tokenizer = Tokenizer.from_file(BYTES)
    want = sorted((tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows))
    read = sorted(documents_in(blocks).collect(), key=lambda r: r["start"])
    assert sorted(tuple(r["ids"]) for r in read) == want
    assert [r["doc_id"] for r in read][-1] is None
    known = [r["doc_id"] for r in read][:-1]
    assert known == sorted(known)
    start = 0
    sums = {(r["doc_id"], r["start"]): r for r in checksums(blocks).collect()}
    for row in read:
        assert row["start"] == start and row["n_tokens"] == len(row["ids"])
        start += row["n_tokens"]
        crc = zlib.crc32(np.array(row["ids"], "<u4").tobytes())
        assert sums[row["doc_id"], row["start"]]["ids_crc32"] == crc


def test_file_of_no_rows(spark):
    assert checksums(write_blocks(none(spark), BYTES, 2)).count() == 0
    assert checksums(write_blocks(odd(spark), BYTES, 2)).count() == len(ROWS)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PIECES)


def brute(pieces, text, n):
    """All segmentations of a short text."""
    if not text:
        return [(0.0, [])]
    found = []
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, begin = [], 0
        for end in [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]:
            parts.append(text[begin:end])
            begin = end
        score, ids = 0.0, []
        for part in parts:
            if part in pieces.ids:
                score += pieces.scores[pieces.ids[part]]
                ids.append(pieces.ids[part])
            elif len(part) == 1:
                score += pieces.spelled
                ids += [pieces.byte_ids[b] for b in part.encode()]
            else:
                break
        else:
            found.append((score, ids))
    return sorted(found, key=lambda f: -f[0])[:n]


WORDS = ["hello", "theses", "a", "\n", "x\nyz", "äöü", "日本", "naïve", "zzzz", "\U0001f600"]


def test_n_best_of_words_equals_all_segmentations(pieces):
    words = [BLANK + w for w in WORDS] + [BLANK * 3, BLANK * 2 + "to"]
    for n in (1, 4, 9):
        totals, paths = n_best_together(pieces, words, n, n)
        for word, row, ids in zip(words, totals, paths):
            want = [s for s, _ in brute(pieces, word, n)]
            found = n_best_of(pieces, word, n)
            assert [s for s, _ in found] == want
            assert [t for t in row if t > -np.inf] == want and ids == [i for _, i in found]


def test_n_best_of_texts_equals_all_segmentations(pieces):
    segmenter = Segmenter(PIECES, 5, keep=True)
    texts = ["", "in the a", "  to", "it ", "a  b\nc", "▁", "x▁y", "of of of", "ö"]
    ids, sizes, scores, choices = segmenter.segment(pa.array(texts))
    for text, best, score, all_ in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), scores, choices):
        whole = (BLANK + text.replace(" ", BLANK)) if text else ""
        assert score.tolist() == [s for s, _ in brute(pieces, whole, 5)], text
        assert all_[0] == best.tolist() and len(set(map(tuple, all_))) == len(all_)
        for one in all_:
            assert pieces.decode(one) == text.replace(BLANK, " ")


def test_words_met_repeatedly_are_kept_when_memory_is_full(monkeypatch):
    import pagewright.llm.pieces as module

    texts = [pa.array([f"the cat w{i} of x{i}", "the end of naïve"]) for i in range(30)]
    roomy = Segmenter(PIECES, 4, keep=True)
    wanted = [roomy.segment(t) for t in texts]
    monkeypatch.setattr(module, "REMEMBERED", 4_000)
    small = Segmenter(PIECES, 4, keep=True)
    for t, want in zip(texts, wanted):
        ids, sizes, scores, choices = small.segment(t)
        assert ids.tolist() == want[0].tolist() and sizes.tolist() == want[1].tolist() and choices == want[3]
        assert [s.tolist() for s in scores] == [s.tolist() for s in want[2]]
    assert len(small.known) < 20 and "the" in small.known and len(roomy.known) > 60


def test_odd_rows_come_back_from_their_pieces(spark):
    encoded = encode_documents(odd(spark), PIECES, all_ids=True)
    rows = decode_documents(encoded, PIECES).collect()
    assert len(rows) == len(ROWS)
    for row in rows:
        assert row["decoded"] == (row["text"] or "") and row["label"] == "x"
        assert row["alternatives"][0] == row["pieces"] and len(row["scores"]) == len(row["alternatives"])
        assert row["scores"] == sorted(row["scores"], reverse=True)
    assert encode_documents(none(spark), PIECES).count() == 0


def test_the_report_has_all_segmentations(spark):
    from pagewright.llm.queries import piece_report

    docs = spark.createDataFrame([(1, "in the a"), (2, None), (3, "naïve \u2581 x")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in piece_report(docs).collect()}
    assert all(r["round_trip"] and len(r["all_ids_crc32"]) == len(r["scores"]) == r["n_best"] for r in rows.values())
    assert len(set(rows[1]["all_ids_crc32"])) == 4 and rows[1]["ids_crc32"] == rows[1]["all_ids_crc32"][0]
    assert rows[2]["n_best"] == 1
