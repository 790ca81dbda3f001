"""The stored index changed in place, and books brought in as one job."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import retrieval as rt
from pagewright.operators.embedding import embed
from pagewright.operators.index import with_chunk_id
from pagewright.plans.answering import answer_questions
from pagewright.plans.ingest import bulk_ingest, ingest, read_manifest
from pagewright.settings import Settings
from pagewright.sources import books as bk
from pagewright.sources.index_table import IndexTable

TEXTS = "grade int, subject string, book_title string, source_file string, chunk_index int, text string, page_start int, page_end int"
PAGE = "grade int, subject string, book_title string, source_file string, page int, text string"
FIXES = "source_file string, chunk_index int, position int, wrong string, right string"


def chunks_of(spark, rows):
    full = [(g, s, s, f"{s}{g}.pdf", i, t, i, i) for g, s, i, t in rows]
    return with_chunk_id(spark.createDataFrame(full, TEXTS)).withColumn("embedding", embed(F.col("text")))


def files_under(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def texts(table):
    return sorted((r["grade"], r["subject"], r["chunk_index"], r["text"]) for r in table.chunks().collect())


@pytest.fixture()
def table(spark, tmp_path):
    made = IndexTable(spark, str(tmp_path / "index"))
    made.create(chunks_of(spark, [(g, s, i, f"{s} {g} chunk {i}") for g in (6, 7) for s in ("Toán", "Lịch sử", "007") for i in range(3)]))
    return made


def untouched(before, table, *touched):
    """Files of partitions other than ``touched`` keep name and time stamp; those of touched ones do not."""
    after = files_under(table.path)
    inside = lambda f: any(f"grade={g}/subject={s}/" in f for g, s in touched)
    assert {f: t for f, t in before.items() if not inside(f)} == {f: t for f, t in after.items() if not inside(f)}
    assert not {f for f in before if inside(f)} & set(after)


def test_upsert_touches_its_partition_only(spark, table):
    before, old = files_under(table.path), texts(table)
    again = table.chunks().where("grade = 6 AND subject = 'Toán' AND chunk_index = 1").withColumn("book_title", F.lit("new title"))
    table.upsert(chunks_of(spark, [(6, "Toán", 9, "a new one")]).unionByName(again.select(*chunks_of(spark, [(1, "x", 0, "")]).columns)))
    assert texts(table) == sorted([*old, (6, "Toán", 9, "a new one")])
    assert table.chunks().where("book_title = 'new title'").count() == 1
    untouched(before, table, (6, "Toán"))


def test_delete_and_an_emptied_partition(spark, table):
    before = files_under(table.path)
    table.delete(table.chunks().where("grade = 7 AND subject = '007'").select("id"))
    assert {(g, s) for g, s, _, _ in texts(table)} == {(g, s) for g in (6, 7) for s in ("Toán", "Lịch sử", "007")} - {(7, "007")}
    untouched(before, table, (7, "007"))
    table.delete(spark.createDataFrame([("no such id",)], "id string"))
    table.upsert(chunks_of(spark, [(7, "007", 0, "back")]))
    assert (7, "007", 0, "back") in texts(table) and len(texts(table)) == 16


def test_corrections_in_place(spark, table):
    before = files_under(table.path)
    patches = spark.createDataFrame([(6, "Toán", "Toán", "Toán6.pdf", 2, "by hand")], PAGE)
    repairs = spark.createDataFrame([(6, "Toán", "Toán", "Toán6.pdf", 2, "read again")], PAGE)
    fixes = spark.createDataFrame([("Lịch sử7.pdf", 1, 0, "chunk", "part"), ("nowhere.pdf", 1, 0, "a", "b")], FIXES)
    table.correct(patches, fixes, repairs)
    found = texts(table)
    assert (7, "Lịch sử", 1, "Lịch sử 7 part 1") in found and len(found) == 20
    assert sum(t in ("by hand", "read again") for *_, t in found) == 2
    untouched(before, table, (6, "Toán"), (7, "Lịch sử"))
    stored = table.chunks().withColumn("fresh", embed(F.col("text"))).collect()
    assert all(r["embedding"] == r["fresh"] for r in stored)
    table.correct(patches, fixes, repairs)
    assert texts(table) == found


def test_fixes_do_not_shuffle_texts(spark, table):
    from pagewright.operators.index import apply_text_fixes

    fixes = spark.createDataFrame([("Toán6.pdf", 1, 0, "chunk", "part")], FIXES)
    plan = apply_text_fixes(table.chunks(), fixes)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


class Extractor:
    """Content is a JSON list of page texts; a number in it breaks the file off."""

    def pages(self, content):
        for text in json.loads(bytes(content)):
            if not isinstance(text, str):
                raise OSError("page is torn")
            yield text, []


def write_book(root, grade, name, pages):
    (root / str(grade)).mkdir(parents=True, exist_ok=True)
    (root / str(grade) / f"{name}.pdf").write_text(json.dumps(pages, ensure_ascii=False))


def body(topic, n=12):
    return " ".join(f"Câu số {i} nói về {topic}." for i in range(n))


def test_bulk_ingest_goes_on_after_bad_files_and_tries_them_again(spark, tmp_path):
    root, table, manifest = tmp_path / "books", IndexTable(spark, str(tmp_path / "index")), str(tmp_path / "manifest")
    write_book(root, 6, "SGKToan6", [body("phân số"), body("số tự nhiên")])
    write_book(root, 6, "SGKLichsu6", [body("chiến thắng"), 5, body("triều đại")])
    write_book(root, 7, "SGKToan6", [body("sai lớp")])
    write_book(root, 7, "SGKNguvan7", ["", " "])

    def run(number, **more):
        files = bk.list_files(spark, str(root))
        rows = bulk_ingest(files, table, manifest, number, Extractor, settings=Settings(chunk_size=300, chunk_overlap=50), **more)
        return {r["path"].rsplit("/", 2)[1] + "/" + r["path"].rsplit("/", 1)[1]: (r["state"], r["reason"]) for r in rows.collect()}

    assert run(1) == {
        "6/SGKToan6.pdf": ("done", None),
        "6/SGKLichsu6.pdf": ("failed", "OSError: page is torn"),
        "7/SGKToan6.pdf": ("rejected", "grade differs from folder"),
        "7/SGKNguvan7.pdf": ("failed", "no text on any page"),
    }
    assert {s for _, s, _, _ in texts(table)} == {"Toán"}
    before = files_under(table.path)
    # The second run reads what failed, not what is done.
    write_book(root, 6, "SGKLichsu6", [body("chiến thắng"), body("triều đại")])
    assert run(2)["6/SGKLichsu6.pdf"] == ("done", None) and "6/SGKToan6.pdf" not in run(3)
    assert {s for _, s, _, _ in texts(table)} == {"Toán", "Lịch sử"}
    untouched(before, table, (6, "Lịch sử"))
    # A changed file replaces its chunks; corrections are part of the job.
    write_book(root, 6, "SGKToan6", [body("hình học", 5)])
    patch = spark.createDataFrame([(6, "Toán", "Toán 6", "SGKToan6.pdf", 1, "ghi tay")], PAGE)
    none = spark.createDataFrame([], FIXES)
    assert run(4, corrections=(patch, none, spark.createDataFrame([], PAGE)))["6/SGKToan6.pdf"] == ("done", None)
    math = [t for _, s, _, t in texts(table) if s == "Toán"]
    assert "ghi tay" in math and all("hình học" in t or t == "ghi tay" for t in math)
    assert read_manifest(spark, manifest).count() == 4 + 3 + 2 + 3


def test_what_is_ingested_can_be_asked(spark, tmp_path):
    """Pages to chunks to index to answers, without a step between."""
    pages = spark.createDataFrame([("b", i, body(t)) for i, t in enumerate(["phân số", "hình tròn"], 1)], "path string, page_number int, text string")
    books = spark.createDataFrame([("b", 6, "Toán", "Toán 6", "SGKToan6.pdf")], "path string, grade int, subject string, book_title string, source_file string")
    table = IndexTable(spark, str(tmp_path / "index"))
    table.create(ingest(pages, books, Settings(chunk_size=300, chunk_overlap=50)))
    asked = spark.createDataFrame([("q", "hình tròn là gì", 6, "Toán")], "qid string, question string, grade int, subject string")
    asked = asked.withColumn("embedding", embed(F.col("question")))
    hits = rt.retrieve(asked, table.chunks(), top_k=3).join(table.chunks().select(F.col("id").alias("chunk_id"), "text"), "chunk_id").collect()
    first = min(hits, key=lambda r: r["rank"])
    assert len(hits) == 3 and "hình tròn" in first["text"] and first["slot"] == rt.SLOT_LITERAL
    offsets = spark.createDataFrame([("SGKToan6.pdf", 0)], "source_file string, offset int")
    row = answer_questions(asked, table.chunks(), offsets).first()
    assert row["grounded"] and "Toán 6, trang" in row["answer"]
