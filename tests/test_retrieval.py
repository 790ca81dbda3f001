import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import retrieval as rt
from pagewright.operators.embedding import embed

CHUNKS = "chunk_id bigint, text string, grade int, subject string, source_file string, chunk_index int, embedding array<float>"
QUESTIONS = "qid string, question string, grade int, subject string, embedding array<float>"


def at(distance):
    """A unit vector at this cosine distance from [1, 0]."""
    c = 1 - distance
    return [float(c), float(np.sqrt(max(0.0, 1 - c * c)))]


def chunks_of(spark, rows):
    df = spark.createDataFrame(rows, CHUNKS)
    return df.withColumn("passage", rt.passage_key(F.col("source_file"), F.col("chunk_index"), F.col("text")))


def ask(spark, rows, question, grade, subject, top_k=10, **kw):
    questions = spark.createDataFrame([("q", question, grade, subject, [1.0, 0.0])], QUESTIONS)
    hits = rt.retrieve(questions, chunks_of(spark, rows), top_k=top_k, **kw)
    return [(r["chunk_id"], round(r["distance"], 4)) for r in hits.orderBy("rank").collect()]


BASE = [
    (1, "Phân số", 6, "Toán", "a.pdf", 0, at(0.10)),
    (2, "Hàm số bậc nhất", 9, "Toán", "b.pdf", 0, at(0.11)),
    (3, "Chiến thắng năm 938", 6, "Lịch sử", "c.pdf", 0, at(0.12)),
]


def test_scope_and_cutoff(spark):
    assert ask(spark, BASE, "Một câu hỏi rất dài về tất cả mọi thứ trên đời này", 6, "Toán") == [(1, 0.1)]
    # Grade 6 material stays visible to grade 9, behind the own grade's close match.
    assert ask(spark, BASE, "Một câu hỏi rất dài về tất cả mọi thứ trên đời này", 9, "Toán") == [(2, 0.11), (1, 0.1)]
    assert ask(spark, [(1, "x", 6, "Toán", "a", 0, at(1.9))], "abc def", 6, "Toán") == []
    assert ask(spark, BASE, "   ", 6, "Toán") == []


def test_grade_preference(spark):
    close = [(1, "a", 5, "Toán", "a", 0, at(0.40)), (2, "b", 9, "Toán", "b", 0, at(0.45))]
    clear = [(1, "a", 5, "Toán", "a", 0, at(0.20)), (2, "b", 9, "Toán", "b", 0, at(0.45))]
    assert ask(spark, close, "xyz?", 9, "Toán") == [(2, 0.45), (1, 0.4)]
    assert ask(spark, clear, "xyz?", 9, "Toán") == [(1, 0.2), (2, 0.45)]


def test_literal_passes(spark):
    rows = [
        (1, "Cân nặng của vật", 2, "Toán", "a", 0, at(0.32)),
        (2, "Tam giác cân là tam giác có hai cạnh bằng nhau", 7, "Toán", "b", 0, at(0.80)),
        (3, "xem tam giác cân ở hình", 7, "Toán", "b", 1, at(0.60)),
        (4, "một tam giác cân là hình", 7, "Toán", "b", 2, at(0.90)),
    ]
    # Definition first, then other literal hits nearest first, then the vector pass.
    assert ask(spark, rows, "Thế nào là tam giác cân?", 7, "Toán") == [(4, 0.9), (3, 0.6), (1, 0.32), (2, 0.8)]
    # Only the shorter term is found when sentence-initial capitals hide the phrase.
    assert ask(spark, rows[:2], "Thế nào là tam giác cân?", 7, "Toán") == [(2, 0.8), (1, 0.32)]
    named = [(1, "Descartes là nhà toán học", 8, "Toán", "a", 0, at(0.9)), (2, "khác", 8, "Toán", "a", 1, at(0.1))]
    assert ask(spark, named, "toạ độ decat là gì", 8, "Toán") == [(1, 0.9), (2, 0.1)]


def test_null_passage_keys(spark):
    rows = [(1, "một", 6, "Toán", None, None, at(0.1)), (2, "hai", 6, "Toán", None, None, at(0.2)), (3, "hai", 6, "Toán", None, 4, at(0.3))]
    assert ask(spark, rows, "xyz?", 6, "Toán") == [(1, 0.1), (2, 0.2)]


def test_subjects_and_best_subject(spark):
    chunks = chunks_of(spark, BASE)
    grades = spark.createDataFrame([(6,), (9,), (1,)], "grade int")
    got = {(r["grade"], r["subject"]) for r in rt.list_subjects(chunks, grades).collect()}
    assert got == {(6, "Toán"), (6, "Lịch sử"), (9, "Toán"), (9, "Lịch sử")}
    questions = spark.createDataFrame([("q", "xyz?", 6, None, [1.0, 0.0]), ("none", "xyz?", 1, None, [1.0, 0.0])], QUESTIONS)
    scoped = rt.scope_to_every_subject(questions, chunks)
    best = rt.best_subject(scoped, rt.retrieve(scoped, chunks)).collect()
    assert [(r["asked"], r["subject"], round(r["distance"], 4)) for r in best] == [("q", "Toán", 0.1)]


def test_against_brute_force(spark):
    """Random chunks with ties, a hot subject and several scans, against plain Python."""
    rng = random.Random(11)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    lexicon = ["alpha", "beta", "gamma", "delta là", "omega"]
    rows = [
        (i, " ".join(rng.choices(lexicon, k=4)), rng.randint(1, 12), "hot" if rng.random() < 0.8 else "cold", f"f{i % 5}", i // 5, rng.choice(vectors))
        for i in range(400)
    ]
    asked = [
        (f"q{i}", rng.choice(["gamma omega?", "alpha beta gamma", "delta là gì", "nothing here", "word " * 20]), rng.randint(1, 12), rng.choice(["hot", "cold"]), rng.choice(vectors))
        for i in range(30)
    ]
    chunks = chunks_of(spark, rows).repartition(4)
    got = rt.retrieve(spark.createDataFrame(asked, QUESTIONS), chunks, top_k=5, per_scan=7)
    found = {}
    for r in got.collect():
        found.setdefault(r["qid"], []).append((r["rank"], r["chunk_id"]))

    def dist(a, b):
        a, b = np.array(a, dtype="float32").astype(float), np.array(b, dtype="float32").astype(float)
        return round(1 - float(a @ b) / float(np.sqrt((a @ a) * (b @ b))), 8)

    def one_pass(q, needle):
        pool = [(dist(q[4], c[6]), c[0], c[2]) for c in rows if c[3] == q[3] and c[2] <= q[2] and needle in c[1]]
        pool = sorted(pool)[:15]
        return [p[1] for p in sorted(pool, key=lambda p: round(p[0] + 0.02 * (q[2] - p[2]), 8))][:5]

    terms = {"gamma omega?": "gamma omega", "alpha beta gamma": "alpha beta gamma", "delta là gì": "delta", "nothing here": "nothing here"}
    byid = {c[0]: c for c in rows}
    for q in asked:
        term = terms.get(q[1])
        literal = []
        if term:
            literal = one_pass(q, term + " là") + one_pass(q, term)
            if not literal and len(term.split()) >= 3:
                literal = one_pass(q, " ".join(term.split()[-2:]))
        merged = list(dict.fromkeys(literal + one_pass(q, "")))[:5]
        want = [(n, c) for n, c in enumerate(merged, 1) if dist(q[4], byid[c][6]) <= 1.1]
        assert sorted(found.get(q[0], [])) == want, q


def test_embedder(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(embed(F.col("t"))).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and sum(got[1]) == 0 and got[2] is None
