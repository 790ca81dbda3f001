import re
from collections import defaultdict

import numpy as np
from llm_cases import ROWS, none, odd

from pagewright.llm.mixing import _settle, expand, mix_sources, pivotal_copies


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Deal by weight, cut what is above the most, deal the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < weight[s] * level}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_odd_rows(spark):
    rows = mix_sources(odd(spark)).collect()
    assert len(rows) == len(ROWS)
    sizes = defaultdict(int)
    for row in rows:
        assert row["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
        sizes[row["source"]] += row["size"]
        assert 0 <= row["taken"] <= 2 * row["size"] and row["label"] == "x"
    want = brute_targets(sizes)
    for row in rows:
        assert row["source_size"] == sizes[row["source"]]
        assert abs(row["target"] - want[row["source"]]) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(odd(spark)).collect()))


def test_words_stay_on_target_and_the_mix_has_the_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mix_sources(docs).cache()
    rows = mixed.collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for row in rows:
        taken[row["source"]] += row["taken"]
        target[row["source"]] = row["target"]
        largest[row["source"]] = max(largest[row["source"]], row["size"])
    for source in target:
        assert abs(taken[source] - target[source]) <= largest[source]
    assert expand(mixed, docs.columns).count() == sum(r["copies"] for r in rows)
    assert expand(mixed, docs.columns).columns == docs.columns
    mixed.unpersist()


def test_an_empty_table(spark):
    assert mix_sources(none(spark)).count() == 0


def test_settling_keeps_words_and_expectations():
    mass = np.array([5.0, 1.0, 40.0, 7.0, 7.0, 300.0])
    share = np.array([0.3, 0.5, 0.9, 0.25, 0.0, 0.6])
    sums = np.zeros(6)
    for seed in range(4_000):
        settled = _settle(mass, share, np.random.default_rng(seed), False)
        open_ = (settled > 0) & (settled < 1)
        assert open_.sum() <= 1 and abs(mass @ settled - mass @ share) < 1e-6
        sums += _settle(mass, share, np.random.default_rng(seed), True)
    assert np.abs(sums / 4_000 - share).max() < 0.04


def test_many_leaves_meet_in_a_tree(spark):
    from pyspark.sql import functions as F

    units = spark.range(600).select(
        "id", F.lit(0).alias("place"), F.xxhash64("id").alias("text_hash"), F.xxhash64("id").alias("turn"),
        (F.col("id") % 40).cast("long").alias("leaf"), (F.col("id") % 9 + 1.0).alias("mass"), F.lit(0.37).alias("share"),
    )
    rows = pivotal_copies(units, 40, fan_in=3).collect()
    assert len(rows) == 600 and {r["share"] for r in rows} <= {0.0, 1.0}
    assert abs(sum(r["share"] * r["mass"] for r in rows) - 0.37 * sum(r["mass"] for r in rows)) <= 9
