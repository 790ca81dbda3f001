"""Chunks found by the index against plain containment."""

import random

from pagewright.operators import literal_index
from pagewright.operators.literal_index import build_index, containing, read_index
from pagewright.plans.materialize import materialize

TEXTS = "chunk_id bigint, subject string, text string"
PATTERNS = "pattern_id string, subject string, pattern string"


def check(spark, rows, patterns, index=None):
    index = index or build_index(spark.createDataFrame(rows, TEXTS))
    asked = [(f"{s}|{p}", s, p) for s, p in patterns]
    found = containing(index, spark.createDataFrame(asked, PATTERNS)).collect()
    wanted = {(f"{s}|{p}", i) for s, p in patterns for i, subject, text in rows if subject == s and text and p in text}
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    return wanted


def test_words_phrases_and_parts_of_words(spark):
    rows = [
        (1, "a", "the right triangle is here"), (2, "a", "bright triangles"), (3, "a", "right  triangle"),
        (4, "a", "right\ntriangle"), (5, "a", "triangle right"), (6, "a", "x"), (7, "a", ""), (8, "a", None),
        (9, "b", "the right triangle"), (10, "a", "right right triangle triangle là gì"), (11, "a", " right triangle "),
    ]
    patterns = ["right triangle", "right", "ight tri", "t t", "x", "the right triangle is", "iangle", "là", "right right tri", "zzz", "right zzz here", "gì"]
    hits = check(spark, rows, [("a", p) for p in patterns] + [("b", "right"), ("c", "right")])
    assert {p.split("|")[1] for p, _ in hits} == {"right triangle", "right", "ight tri", "t t", "x", "the right triangle is", "iangle", "là", "right right tri", "gì"}


def test_random_texts_with_a_hot_word(spark, tmp_path):
    draw = random.Random(4)
    words = ["aa", "ab", "ba", "aab", "b", "c", "hot"]
    text = lambda n: " ".join(draw.choice(words) if draw.random() < 0.6 else "hot" for _ in range(n))
    rows = [(i, draw.choice("xy"), text(draw.randint(0, 12))) for i in range(200)]
    patterns = {(draw.choice("xy"), text(draw.randint(1, 4))[draw.randint(0, 1) :].strip()) for _ in range(60)}
    index = build_index(spark.createDataFrame(rows, TEXTS), str(tmp_path / "index"))
    assert check(spark, rows, sorted(p for p in patterns if p[1]), index)
    assert read_index(spark, str(tmp_path / "index")).vocabulary.count() == index.vocabulary.count()


def test_nothing_to_find(spark):
    assert not check(spark, [], [("a", "x")])
    assert not check(spark, [(1, "a", "x y")], [("a", "y x")])


def test_places_are_stored_without_a_shuffle(spark, monkeypatch):
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name)

    monkeypatch.setattr(literal_index, "materialize", noted)
    build_index(spark.createDataFrame([(1, "a", "x y x"), (2, "b", None)], TEXTS))
    assert "Exchange" not in plans["postings"] and "Exchange" in plans["vocabulary"]


def test_frequent_and_rare_words_are_found_alike(spark, monkeypatch):
    draw = random.Random(7)
    words = ["aaa", "bab", "abba", "c", "cab", "", "a\nb", "đoạn"]
    rows = [(i, draw.choice("xy"), " ".join(draw.choices(words, k=draw.randint(0, 9)))) for i in range(80)]
    patterns = {(draw.choice("xy"), " ".join(draw.choices(words[:5], k=draw.randint(1, 5)))[draw.randint(0, 1) :]) for _ in range(60)}
    patterns = sorted({(s, p) for s, p in patterns if p and p == p.strip() and "  " not in p} | {("x", "oạ"), ("y", "ab"), ("x", "a")})
    wanted = check(spark, rows, patterns)
    for share in (0, 4):  # none and some of the words count as frequent
        monkeypatch.setattr(literal_index, "HOT_WORDS", share)
        assert check(spark, rows, patterns) == wanted
