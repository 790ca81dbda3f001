"""Clusters against plain rounds over whole vectors in Python's integers."""

import hashlib
import math
import random

from pagewright.llm.lloyd import FARTHEST, cluster_vectors

SCHEMA = "vec_id long, embedding array<double>, key string, cluster string, `__row` string, part0 string, distance string"
EXTRA = ("x",) * 5


def plain(rows, k, rounds, dimensions, scale, seed):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) of every kept row."""
    kept = []
    for name, vector, *_ in rows:
        if vector is None or len(vector) != dimensions or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((name, [math.floor(max(min(scale * x, FARTHEST), -FARTHEST)) for x in vector]))
    digest = lambda name: hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]
    centres = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [
            [sum(column) // len(groups[i]) for column in zip(*groups[i])] if i in groups else c
            for i, c in enumerate(centres)
        ]
    final = [(name, *near(v)) for name, v in kept]
    inside = {}
    for _, d, c in final:
        inside[c] = inside.get(c, 0) + d
    fits = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(n, c, fits(d), fits(inside[c]), fits(sum(inside.values())), sha[c]) for n, d, c in final]


def check(spark, rows, k=3, rounds=3, dimensions=5, scale=64, seed=1, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = cluster_vectors(df, k, rounds, dimensions, scale, seed, **options)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    mine = [tuple(r[n] for n in names) for r in found.collect()]
    assert sorted(mine, key=repr) == sorted(plain(rows, k, rounds, dimensions, scale, seed), key=repr)
    return found


def some(n, dimensions=5, spread=1.0, seed=3):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(dimensions)], *EXTRA) for i in range(n)]


def test_equals_plain_rounds_with_any_blocks(spark):
    rows = some(60)
    for block in (1, 2, 5, 32):
        check(spark, rows, block=block)


def test_odd_rows(spark):
    odd = [
        (1, None, *EXTRA),
        (2, [], *EXTRA),
        (3, [1.0, 2.0, 3.0, 4.0], *EXTRA),
        (4, [1.0, None, 3.0, 4.0, 5.0], *EXTRA),
        (5, [1.0, float("nan"), 3.0, 4.0, 5.0], *EXTRA),
        (6, [1.0, float("-inf"), 3.0, 4.0, 5.0], *EXTRA),
        (None, [0.5] * 5, *EXTRA),
        (7, [0.25] * 5, *EXTRA),
        (7, [0.25] * 5, *EXTRA),
        (7, [-0.25] * 5, *EXTRA),
        (8, [-0.0] * 5, *EXTRA),
    ]
    found = check(spark, odd + some(20), block=2)
    assert [c for c in found.columns if c in ("key", "__row", "part0")] == ["key", "__row", "part0"]
    assert found.columns.count("cluster") == 1


def test_large_components_stay_exact(spark):
    for size in (1e6, 1e9, 1e15, 1e300):
        rows = some(12) + [(100, [size, 1.0, 1.0, -size, 0.0], *EXTRA), (101, [size, 1.0, 1.0, -size, 0.5], *EXTRA)]
        check(spark, rows, k=4, block=2)


def test_one_vector_holds_a_third_of_all_rows(spark):
    check(spark, some(100) + [(i, [0.1] * 5, *EXTRA) for i in range(200, 250)], k=4, block=3)


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, some(2), k=3)
    empty = cluster_vectors(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    assert set(empty.columns) == set(cluster_vectors(spark.createDataFrame(some(3, 64), SCHEMA)).columns)
