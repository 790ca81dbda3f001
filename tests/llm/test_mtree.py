import numpy as np
import pytest

from pagewright.llm import mtree


def brute(rows, k, every):
    usable = {
        i: np.floor(256 * np.array(v, float)).astype(object)
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    size = max((len(v) for v in usable.values()), default=0)
    usable = {i: np.concatenate([v, [0] * (size - len(v))]) for i, v in usable.items()}
    result = set()
    for q in (i for i in usable if i % every == 0):
        scores = sorted((-int(sum(usable[q] * v)), i) for i, v in usable.items() if i != q)[:k]
        result |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return result


@pytest.mark.parametrize("tree,leaf", [(16_384, 256), (60, 8)])
def test_search_equals_brute_force(spark, monkeypatch, tree, leaf):
    monkeypatch.setattr(mtree, "TREE", tree)
    monkeypatch.setattr(mtree, "LEAF", leaf)
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] * (1 + i % 3) + 0.1 * draw.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)]  # one vector of many rows
    rows += [(500, [0.0] * 8), (501, None), (502, [None] * 8), (503, [float("nan")] * 8), (504, [float("inf")] * 8)]
    rows += [(None, [1.0] * 8), (505, [3.0, 1.0]), (510, []), (520, centers[0].tolist()), (530, centers[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    as_floats = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = mtree.nearest_embeddings(df, every=10).collect()
    assert {tuple(r) for r in found} == brute(as_floats, 5, 10)
    assert len(found) == len(set(found))


@pytest.mark.parametrize("tree,leaf", [(16_384, 256), (20, 4)])
def test_large_finite_components(spark, monkeypatch, tree, leaf):
    """Products with other rows fit 64 bits, a large row's with itself does not."""
    monkeypatch.setattr(mtree, "TREE", tree)
    monkeypatch.setattr(mtree, "LEAF", leaf)
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=3).tolist()) for i in range(1, 80)]
    rows += [(0, [1e9, 1.0, 1.0]), (100, [1.0, 1e9, 0.0]), (150, [0.5, -1e8, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in mtree.nearest_embeddings(df, every=10).collect()} == brute(rows, 5, 10)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0]), (1, [2.0])], [(0, None), (50, [float("nan")])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in mtree.nearest_embeddings(df).collect()} == brute(rows, 5, 50)


def test_pages_hold_what_the_search_relies_on():
    draw = np.random.default_rng(2)
    vectors = draw.integers(-300, 300, (3_000, 5))
    metric = mtree._Metric(int((vectors**2).sum(axis=1).max()))
    pages = mtree.build_tree(vectors, [[i] for i in range(3_000)], metric)

    def below(number):
        page = pages[number]
        return page["vectors"] if page["leaf"] else np.concatenate([below(c) for c in page["children"]])

    assert len(below(0)) == 3_000
    for page in pages:
        for center, radius, child in zip(page["vectors"], page["radii"], page["children"]):
            assert metric.between(below(child), center).max() <= radius + 1e-9
            above = metric.between(pages[child]["vectors"], center)
            assert np.allclose(above, pages[child]["above"])
