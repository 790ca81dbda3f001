"""What runs write and later runs read: page cache, offsets, repairs, question sets; second asks; the command line."""

import json
import os
import re

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.__main__ import parser, run
from pagewright.operators.embedding import embed
from pagewright.operators.generation import OfflineClient, RateLimited, ServiceError
from pagewright.plans.answering import run_benchmark
from pagewright.sources import books as bk
from pagewright.sources import tables as tb
from pagewright.plans.materialize import materialize
from pagewright.sources.question_sets import all_questions, read_question_set


def test_load_through_extracts_what_the_cache_lacks(spark, tmp_path):
    asked, path = [], str(tmp_path / "cache")

    def extract(missing):
        names = sorted(r["book"] for r in missing.collect())
        asked.append(names)
        rows = [(6, n, p, f"{n} {p} v{len(asked)}") for n in names if n != "hỏng" for p in (1, 2)]
        return spark.createDataFrame(rows, "grade int, book string, page_number int, text string")

    def load(*names, **more):
        books = spark.createDataFrame([(6, n) for n in names], "grade int, book string")
        return sorted(r["text"] for r in tb.load_through(books, path, extract, **more).collect())

    assert load("a", "007") == ["007 1 v1", "007 2 v1", "a 1 v1", "a 2 v1"]
    kept = {f: os.stat(f).st_mtime_ns for f in (str(p) for p in tmp_path.rglob("*.parquet"))}
    assert load("a", "b", "hỏng") == ["a 1 v1", "a 2 v1", "b 1 v2", "b 2 v2"]
    assert load("a", "b", "hỏng") == ["a 1 v1", "a 2 v1", "b 1 v2", "b 2 v2"]
    assert asked == [["007", "a"], ["b", "hỏng"], ["hỏng"]]
    assert all(os.stat(f).st_mtime_ns == t for f, t in kept.items())
    assert load("b", force=True) == ["b 1 v4", "b 2 v4"] and load("a") == ["a 1 v1", "a 2 v1"]


class Broken:
    def pages(self, content):
        for text in json.loads(bytes(content)):
            yield text, []


def test_an_unreadable_file_is_a_row(spark):
    files = spark.createDataFrame([("good", bytearray(b'["one", "two"]')), ("bad", bytearray(b"{"))], "path string, content binary")
    rows = {(r["path"], r["page_number"]): r["error"] for r in bk.extract_or_report(files, Broken).collect()}
    assert set(rows) == {("good", 1), ("good", 2), ("bad", 0)} and "JSONDecodeError" in rows["bad", 0]
    assert bk.extract_pages(files, Broken).count() == 2


class Limited:
    def read(self, image):
        if image.startswith(b"x"):
            raise RateLimited
        if image.startswith(b"!"):
            raise KeyError("broken image")
        return "first " + image.decode()


class Second:
    def read(self, image):
        return "second " + image.decode()


def test_readers_in_order(spark):
    rows = [("p", 1, "text", [b"x"]), ("p", 2, " ", [b"a", b"x1"]), ("p", 3, "", [b"!", b"b"]), ("p", 4, "", []), ("p", 5, None, None)]
    pages = spark.createDataFrame(rows, "path string, page_number int, text string, images array<binary>")
    read = bk.read_images(pages, Limited, Second)
    assert {r["page_number"]: r["text"] for r in read.collect()} == {1: "text", 2: "first a\nsecond x1", 3: "first b", 4: "", 5: None}
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1  # only pages to be read are dealt out


def test_offsets_and_repairs_come_back(spark, tmp_path):
    offsets = spark.createDataFrame([("b.pdf", 2), ("a.pdf", 0), ("c.pdf", None)], "source_file string, offset int")
    tb.write_offsets(offsets, str(tmp_path / "offsets"))
    assert sorted(map(tuple, tb.read_offsets(spark, str(tmp_path / "offsets")).collect())) == [("a.pdf", 0), ("b.pdf", 2)]
    shape = "grade int, subject string, book_title string, source_file string, page int, text string, kinds array<string>"
    first = spark.createDataFrame([(6, "Toán", "T", "a.pdf", p, f"old {p}", ["k"]) for p in (1, 2)], shape)
    second = spark.createDataFrame([(6, "Toán", "T", "a.pdf", 2, "new 2", [])], shape)
    path = str(tmp_path / "repairs")
    tb.save_repairs(spark, path, first, 1)
    for _ in range(2):  # a repeated run counts once
        saved = tb.save_repairs(spark, path, second, 2)
    assert sorted((r["page"], r["text"]) for r in saved.collect()) == [(1, "old 1"), (2, "new 2")]


def write_lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_question_sets_are_read_and_united(spark, tmp_path):
    inside = [{"question": f"q{i}", "grade": 6, "subject": "Toán", "keywords": ["k"]} for i in range(3)]
    inside += [{"question": " ", "grade": 6, "subject": "Toán"}, {"question": "no grade"}]
    outside = [{"question": "o", "grade": 7, "subject": "Toán", "in_textbook": False}]
    one = read_question_set(spark, write_lines(tmp_path / "in.json", inside))
    two = read_question_set(spark, write_lines(tmp_path / "out.json", outside))
    rows = all_questions(one, two).orderBy("position").collect()
    assert [(r["position"], r["qid"], r["question"], r["in_textbook"]) for r in rows] == [
        (1, "1", "q0", True), (2, "2", "q1", True), (3, "3", "q2", True), (4, "4", "o", False),
    ]
    assert [list(r["keywords"]) for r in rows] == [["k"]] * 3 + [[]]


class Busy(OfflineClient):
    def complete(self, model, messages, settings):
        if "bận" in messages[-1]["content"].rsplit("HỎI:", 1)[1]:
            raise ServiceError("busy")
        return super().complete(model, messages, settings)


def corpus(spark):
    rows = [(1, "Phân số là số có tử và mẫu", "Toán", 6, "toan.pdf", 0, "Toán", 5, 5)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string, subject string, grade int, source_file string, chunk_index int, book_title string, page_start int, page_end int")
    return chunks.withColumn("embedding", embed(F.col("text"))), spark.createDataFrame([("toan.pdf", 1)], "source_file string, offset int")


def test_failed_questions_are_asked_again(spark):
    rows = [("1", "phân số", 6, "Toán", [], True), ("2", "phân số bận", 6, "Toán", [], True)]
    questions = spark.createDataFrame(rows, "qid string, question string, grade int, subject string, keywords array<string>, in_textbook boolean")
    questions = questions.withColumn("embedding", embed(F.col("question")))

    def got(**more):
        outcomes, totals = run_benchmark(questions, *corpus(spark), make_client=Busy, **more)
        return {r["qid"]: (r["attempt"], r["verdict"]) for r in outcomes.collect()}, totals.first()["provider_errors"]

    assert got(ask_again=OfflineClient) == ({"1": (1, fv.VERDICT_PASS), "2": (2, fv.VERDICT_PASS)}, 0)
    assert got(attempts=3) == ({"1": (1, fv.VERDICT_PASS), "2": (3, fv.VERDICT_ERROR)}, 1)
    assert got(attempts=1) == ({"1": (1, fv.VERDICT_PASS), "2": (1, fv.VERDICT_ERROR)}, 1)


def test_command_line(spark, sf, tmp_path, capsys):
    args = parser().parse_args(["bench", "i", "o", "a", "b", "--out", "x"])
    assert (args.index, args.questions, args.out) == ("i", ["a", "b"], "x")
    run(["query", "session_history", sf, str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    cached = [(1, "m0t s6tu t0an" + " lorem ipsum dolor sit amet" * 6, 6, "a")]
    spark.createDataFrame(cached, tb.CACHED).write.partitionBy("grade", "book").parquet(str(tmp_path / "pages"))
    run(["audit", str(tmp_path / "pages"), str(tmp_path / "audit")], spark)
    assert spark.read.parquet(str(tmp_path / "audit")).where("size(issues) > 0").count() == 1
    assert "kind" in capsys.readouterr().out


def test_pages_are_not_shuffled_to_their_books(spark, tmp_path, monkeypatch):
    plans, path = [], str(tmp_path / "cache")

    def noted(df, name):
        if name == "extracted-pages":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda n: F.sha2((F.col("id") * 100 + n).cast("string"), 256)), " ")
    spark.range(200).select(F.concat(F.lit("b"), F.col("id") % 3).alias("book"), F.col("id").alias("page_number"), text.alias("text")).write.parquet(
        str(tmp_path / "pages")
    )
    pages = spark.read.parquet(str(tmp_path / "pages")).withColumn("grade", F.lit(6))
    monkeypatch.setattr(tb, "materialize", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # the pages are larger, their list of books is not
    try:
        loaded = tb.load_through(pages.select("grade", "book").distinct(), path, lambda m: pages.join(m, ["grade", "book"], "left_semi"))
        plans.append(loaded._jdf.queryExecution().executedPlan().toString())
        assert loaded.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and not any(re.search("SortMergeJoin .*LeftSemi", p) for p in plans)
