import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators.chunking import chunk_pages
from pagewright.plans.ordered import change_epochs, last_known, prefix_sum


def sentences(n, tag="Cau"):
    return " ".join(f"{tag} so {i} noi ve mot dieu rat hay." for i in range(n))


def run(spark, pages, size, overlap, width=64):
    df = spark.createDataFrame(pages, "book string, page_number int, text string")
    rows = chunk_pages(df, ["book"], chunk_size=size, chunk_overlap=overlap, pages_per_block=width).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["book"], r["chunk_index"])):
        out.setdefault(r["book"], []).append((r["chunk_index"], r["text"], r["page_start"], r["page_end"]))
    return out


def test_size_overlap_and_pages(spark):
    books = [("one", 1, sentences(40)), ("two", 5, sentences(12)), ("two", 6, sentences(12, "Dong"))]
    got = run(spark, books, 400, 60)
    assert all(len(t) <= 400 for _, t, _, _ in got["one"])
    assert [c[0] for c in got["one"]] == list(range(len(got["one"])))
    for a, b in zip(got["one"], got["one"][1:]):
        assert a[1].split(". ")[-1].rstrip(".") == b[1].split(". ")[0]
    assert any((c[2], c[3]) == (5, 6) for c in got["two"])
    plain = run(spark, [("one", 1, sentences(40))], 200, 0)["one"]
    assert " ".join(c[1] for c in plain) == sentences(40)


def test_special_pages(spark):
    body = sentences(6)
    long = "x" * 900 + "."
    books = [
        ("toc", 1, "MỤC LỤC\nCHƯƠNG I"), ("toc", 2, body),
        ("long", 1, long),
        ("sections", 1, f"a. Mot\n{body}\nb. Hai\n{body}"),
        ("head2", 1, sentences(2)), ("head2", 2, f"1. Tieu de\n{sentences(2)}"),
    ]
    got = run(spark, books, 450, 80)
    assert all("MỤC LỤC" not in c[1] for c in got["toc"]) and got["toc"]
    assert got["long"] == [(0, long, 1, 1)]
    assert any(c[1].startswith("b. Hai") for c in got["sections"])
    assert len(got["head2"]) == 1  # a page's first heading never forces a boundary
    with pytest.raises(ValueError):
        run(spark, books, 100, 100)


@pytest.mark.parametrize("width", [1, 2, 7])
def test_blocks_equal_one_fold(spark, width):
    """One hot book over many blocks gives what a single block over all its pages gives."""
    rng = random.Random(width)

    def page():
        n = rng.choice([0, 1, 2, 5, 9])
        parts = ["w" * rng.choice([3, 20, 55, 90, 240]) + rng.choice([".", "!", ";"]) for _ in range(n)]
        if rng.random() < 0.2:
            parts.insert(len(parts) // 2, "\n\nBÀI 2 abc.\n")
        return " ".join(parts) or " "

    pages = [("hot", i, page()) for i in range(0, 160, rng.choice([1, 3]))] + [("cold", 3, page())]
    assert run(spark, pages, 200, 60, width) == run(spark, pages, 200, 60, 100_000)


def test_ordered_helpers(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 3)}", i * 3, rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int").repartition(5)
    state = F.coalesce(F.col("v"), F.lit(0))
    out = change_epochs(
        last_known(
            last_known(prefix_sum(df, ["k"], "o", state, "s", width=20), ["k"], "o", F.col("v"), "l", width=20),
            ["k"], "o", F.col("v"), "b", include_current=False, width=20,
        ),
        ["k"], "o", state, "e", width=20,
    )
    got = {(r["k"], r["o"]): (r["s"], r["l"], r["b"], r["e"]) for r in out.collect()}
    total, last, epoch, prev, want = {}, {}, {}, {}, {}
    for k, o, v in rows:
        if k in prev and prev[k] != (v or 0):
            epoch[k] = epoch.get(k, 0) + 1
        before = last.get(k)
        if v is not None:
            last[k] = v
        want[(k, o)] = (total.get(k, 0), last.get(k), before, epoch.get(k, 0))
        total[k] = total.get(k, 0) + (v or 0)
        prev[k] = v or 0
    assert got == want
