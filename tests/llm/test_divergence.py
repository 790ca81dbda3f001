"""Differences of sources against comparing every kept term of every pair."""

import random
import re

import pyarrow as pa
from llm_cases import none, odd

from pagewright.llm import divergence
from pagewright.llm.divergence import source_divergence, terms_in

SCHEMA = "doc_id long, text string, lang string, source string, value string, part string, item string"


def plain(rows, least, ranks):
    texts = [(r[2] or "", r[3] or "", r[1] or "") for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    uses, docs = {}, {}
    for lang, source, text in texts:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        own = uses.setdefault((lang, source), {})
        for w in words:
            own[w] = own.get(w, 0) + 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for lang in {g[0] for g in uses}:
        kept = sorted(t for (name, t), n in docs.items() if name == lang and n >= least)
        sources = sorted(s for name, s in uses if name == lang)
        p = lambda ns: {t: 1 + 10**9 * (ns.get(t, 0) + 2) // (sum(ns.get(k, 0) for k in kept) + 2 * len(kept)) for t in kept}
        whole = {t: sum(uses[lang, s].get(t, 0) for s in sources) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(uses[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in sources if o != s]
            over = [(t, f(ps[s][t], q[t])) for t in kept if uses[lang, s].get(t, 0) > 0 and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", over, ranks)):
                best = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:most]
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(best, 1)]
    return sorted(out)


def check(rows, df, least, ranks=10):
    found = source_divergence(df, least, ranks)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    mine = [tuple(r) for r in found.collect()]
    assert sorted(mine) == plain(rows, least, ranks)
    assert len(mine) == len(set(mine))


def drawn(n, seed=5, hot=0.34):
    """Documents of skewed words, languages and sources; one source holds a third."""
    draw = random.Random(seed)
    words = [f"w{i}x" for i in range(20)] + ["über", "naïve", "日本", "A", "b", "Ä"]
    rows = []
    for i in range(n):
        source = "hot" if draw.random() < hot else draw.choice(["a", "b", "c", "", None, "ß", "B"])
        text = " ".join(draw.choice(words[: draw.randint(1, len(words))]) for _ in range(draw.randint(0, 30)))
        rows.append((i, text, draw.choice(["en", "en", "de", None]), source, "x", "x", "x"))
    return rows


def test_terms():
    text = "It's NAÏVE—don't x2y ÄÖ \x00\x7f[a]"
    found = terms_in(pa.array(["before", text, "", " . ", "last"]).slice(1, 3)).to_pylist()
    assert [[t for t in terms if t] for terms in found] == [["it", "s", "naÏve—don", "t", "x", "y", "ÄÖ", "a"], [], []]


def test_equals_all_pairs(spark):
    for least in (1, 3, 10):
        rows = drawn(150) + drawn(1) * 3
        check(rows, spark.createDataFrame(rows, SCHEMA).repartition(4), least, ranks=5)


def test_flushes_of_full_tasks_change_nothing(spark, monkeypatch):
    rows = drawn(80, seed=8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 50)
    monkeypatch.setattr(divergence, "HELD_COMBINATIONS", 1)
    check(rows, df, 2)


def test_tree_in_small_steps(monkeypatch):
    """Corrections of few combinations at once add up to those of all."""
    draw = random.Random(4)
    paths = {
        (lang, tuple((s, draw.choice([3, 40, 900]), 2) for s in "abcdef" if draw.random() < 0.6))
        for lang in "xy"
        for _ in range(60)
    }
    rows = [{"lang": n, "path": [dict(zip(("source", "p", "none"), x)) for x in p], "m": 2} for n, p in sorted(paths)]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7)]

    def totals():
        out = {}
        for batch in divergence._tree(iter(batches)):
            for r in batch.to_pylist():
                key = (r["lang"], *sorted((r["source"], r["item"])))
                out[key] = out.get(key, 0) + r["value"]
        return out

    wanted = {}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for lang, path in paths:
        for i, (s, p, p0) in enumerate(path):
            for t, q, q0 in path[:i]:
                value = 2 * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
                wanted[lang, t, s] = wanted.get((lang, t, s), 0) + value
    assert totals() == wanted
    monkeypatch.setattr(divergence, "HELD_COMBINATIONS", 1)
    assert totals() == wanted


def test_tree_cut_anywhere(spark):
    rows = drawn(120, seed=9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(rows, spark.createDataFrame(rows, SCHEMA), 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_kept_terms_odd_rows_and_none(spark):
    rows = drawn(20)
    check(rows, spark.createDataFrame(rows, SCHEMA), 1_000)
    check([tuple(r)[:4] for r in odd(spark).collect()], odd(spark), 1)
    assert source_divergence(none(spark)).count() == 0
