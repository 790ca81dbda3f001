import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ROWS, none, odd
from pyspark.sql import functions as F

from pagewright.llm.near import components, near_duplicates
from pagewright.llm.shingles import bag_min_hashes, bags, word_hashes


def bag(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 1.0


def brute_classes(rows):
    """Every pair that shares a shingle, by union of those that are similar."""
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    found = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if similarity(found[i], found[j]) >= 0.8:
                up[max(top(i), top(j))] = min(top(i), top(j))
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[top(i)].append(rows[i][0])
    return sorted(sorted(c) for c in classes.values())


def classes_of(df):
    classes = defaultdict(list)
    for row in df.collect():
        classes[row["class_id"]].append(row["doc_id"])
    return sorted(sorted(c) for c in classes.values())


def test_classes_equal_brute_force_also_for_chains_and_crowds(spark):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for length in (1, 3, 5, 9, 40, 90, 200):
        base = [draw.choice(vocabulary) for _ in range(length)]
        for changes in (0, 0, 1, 1, 2, 4):
            words = list(base)
            for _ in range(min(changes, length)):
                words[draw.randrange(length)] = draw.choice(vocabulary)
            texts.append(" ".join(words))
    chain = [draw.choice(vocabulary) for _ in range(120)]
    for step in range(12):  # each like the one before, the ends unlike
        chain = chain[4:] + [draw.choice(vocabulary) for _ in range(4)]
        texts.append(" ".join(chain))
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(draw.choice(vocabulary) for _ in range(30)) for _ in range(40)]
    texts += ["again and again and again " * 30, "again and again and again " * 33, "", "  ", "ONE", "one"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert classes_of(near_duplicates(docs)) == brute_classes(rows)


def test_odd_rows(spark):
    rows = near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ROWS) and all(r["label"] == "x" for r in rows)
    six = [r for r in rows if (r["text"] or "").split()[:2] == ["the", "same"]]
    assert {r["class_id"] for r in six} == {1} and {r["class_size"] for r in six} == {5}
    assert sum(r["kept"] for r in six) == 1
    assert {r["class_id"] for r in rows if not (r["text"] or "").strip()} == {4}


def test_an_empty_table(spark):
    assert near_duplicates(none(spark), carry=False).count() == 0


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(1)
    for spread in (1, 6, 200):
        shingles = np.arange(300)
        a = draw.integers(0, spread + 1, 300)
        b = np.where(draw.random(300) < 0.7, a, draw.integers(0, spread + 1, 300))
        text = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        hashed = np.concatenate([shingles[a > 0], shingles[b > 0]])
        counts = np.concatenate([a[a > 0], b[b > 0]])
        slots = 4_000
        signature = bag_min_hashes(text, hashed, counts, 2, slots)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((signature[0] == signature[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / slots)


def test_bags_count_repeats_and_do_not_cross_texts():
    texts = ["a b c d e a b c d e a b c d e", "a b", None or "", "B A", "c d e a b"]
    words, per_text = word_hashes(pa.array(texts))
    text, shingle, count = bags(words, per_text, 5)
    assert per_text.tolist() == [15, 2, 0, 2, 5]
    want = [sorted(bag(t).values()) for t in texts]
    assert [sorted(count[text == i].tolist()) for i in range(5)] == want
    assert set(shingle[text == 4]) <= set(shingle[text == 0])


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "x long, y long")
    labels = {r["node"]: r["label"] for r in components(df).collect()}
    want = {}
    for x, y in edges:
        a, b = want.get(x, x), want.get(y, y)
        for k in [k for k in want if want[k] in (a, b)] + [x, y]:
            want[k] = min(a, b)
    assert labels == want
    assert df.where(F.col("x") == F.col("y")).count() == 0
