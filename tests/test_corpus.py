import json

import pytest
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.operators import audit as oa
from pagewright.operators import boilerplate as bp
from pagewright.operators import catalog as ct
from pagewright.operators import citations as ci
from pagewright.operators import index as ix
from pagewright.operators import page_offsets as po
from pagewright.plans.ingest import ingest, plan_files
from pagewright.registry import QUERIES
from pagewright.settings import Settings
from pagewright.sources import books as bk
from pagewright.sources import tables as tb

CHUNKS = "grade int, subject string, book_title string, source_file string, chunk_index int, text string, page_start int, page_end int"


def test_repeated_lines_and_drop(spark):
    header = "Chương 1"
    pages = [("b", i, f"{header}\nnội dung trang {i}\n\n\n{'x' * 90}") for i in range(6)]
    pages += [("two", i, "Đầu trang\nnội dung") for i in range(2)]
    df = spark.createDataFrame(pages, "book string, page int, text string")
    found = bp.repeated_lines(df, "book", "text").collect()
    assert [(r["book"], r["line"]) for r in found] == [("b", header)]
    kept = {(r["book"], r["page"]): r["text"] for r in bp.drop_boilerplate(df, "book", "page", "text").collect()}
    assert kept[("b", 0)] == f"nội dung trang 0\n\n{'x' * 90}" and kept[("two", 1)] == "Đầu trang\nnội dung"


def test_filenames(spark):
    rows = [
        ("raw/9/SGKToan9tapmot.pdf", 9, "Toán", "Toán 9 - tập 1"),
        ("raw/10/SGKChuyendehoctapToan10.pdf", 10, "Toán", "Chuyên đề học tập Toán 10"),
        ("raw/6/SGKLichsuvaDiali6.pdf", 6, "Lịch sử và Địa lí", "Lịch sử và Địa lí 6"),
        ("raw/11/SGKCongnghe11ModunChebien.pdf", 11, "Công nghệ", "Công nghệ 11 - Modun Chebien"),
    ]
    bad = ["raw/6/SGKToan7.pdf", "raw/13/SGKToan13.pdf", "raw/6/Toan.pdf", "raw/abc/SGKToan6.pdf"]
    df = spark.createDataFrame([(r[0],) for r in rows] + [(b,) for b in bad], "path string")
    books = ct.infer_books(df)
    got = {r["path"]: (r["grade"], r["subject"], r["book_title"]) for r in ct.accepted(books).collect()}
    assert got == {r[0]: r[1:] for r in rows}
    assert {r["path"] for r in ct.rejected(books).collect()} == set(bad)


def test_index_upserts_and_fixes(spark):
    rows = [(6, "Toán", "T", "a.pdf", 0, "sai rồi", 1, 1), (6, "Toán", "T", "a.pdf", 1, "đúng", 2, 2)]
    chunks = ix.with_chunk_id(spark.createDataFrame(rows, CHUNKS))
    again = ix.upsert(chunks, chunks, ["id"], ["chunk_index"])
    assert again.count() == 2
    other_title = ix.with_chunk_id(spark.createDataFrame([(6, "Toán", "Khác", "a.pdf", 0, "sai rồi", 9, 9)], CHUNKS))
    merged = ix.upsert(chunks, other_title, ["id"], ["chunk_index"]).collect()
    assert sorted(r["book_title"] for r in merged) == ["Khác", "T"]
    fixes = spark.createDataFrame([("a.pdf", 0, 1, "sai", "đúng"), ("a.pdf", 7, 1, "x", "y")], "source_file string, chunk_index int, position int, wrong string, right string")
    fixed = ix.apply_text_fixes(chunks, fixes)
    twice = ix.apply_text_fixes(fixed, fixes)
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, twice.collect()))
    texts = {r["chunk_index"]: (r["text"], r["id"]) for r in fixed.collect()}
    old = {r["chunk_index"]: r["id"] for r in chunks.collect()}
    assert texts[0][0] == "đúng rồi" and texts[0][1] != old[0] and texts[1][1] == old[1]
    assert ix.delete(chunks, other_title, ["id"]).count() == 1


def test_corrections_are_idempotent(spark):
    chunks = ix.with_chunk_id(spark.createDataFrame([(6, "Toán", "T", "a.pdf", 0, "sai", 1, 1)], CHUNKS))
    page = "grade int, subject string, book_title string, source_file string, page int, text string"
    patches = spark.createDataFrame([(6, "Toán", "T", "a.pdf", 12, "vá")], page)
    readings = spark.createDataFrame([(6, "Toán", "T", "a.pdf", 3, "cũ", 1), (6, "Toán", "T", "a.pdf", 3, "mới", 2)], page + ", arrival int")
    repairs = ix.latest_repairs(readings, "arrival").drop("arrival")
    fixes = spark.createDataFrame([("a.pdf", 0, 1, "sai", "đúng")], "source_file string, chunk_index int, position int, wrong string, right string")
    once = ix.apply_corrections(chunks, patches, fixes, repairs)
    twice = ix.apply_corrections(once, patches, fixes, repairs)
    got = {(r["chunk_index"], r["text"]) for r in once.collect()}
    assert got == {(0, "đúng"), (900012, "vá"), (800003, "mới")}
    assert sorted(r["id"] for r in once.collect()) == sorted(r["id"] for r in twice.collect())


def test_printed_pages_and_citations(spark, evaluate):
    rows = [(72, 1), (72, None), (1, 3), (72, -2)]
    assert evaluate(ci.printed_page, rows, "int; int") == [71, 72, 1, 72]
    cites = evaluate(ci.citation, [("Toán 6", 12, 12), ("Toán 6", 12, 14), (None, 3, None), ("Toán 6", None, None)], "string; int; int")
    assert cites == ["Toán 6, trang 12", "Toán 6, trang 12-14", "SGK, trang 3", "Toán 6"]


def test_cited_sources(evaluate):
    passages = [("A, trang 1-3", 1, 3), ("B, trang 3", 3, 3), ("C, trang 9", 9, None)]
    kind = "string; array<struct<citation:string,page_start:int,page_end:int>>"
    rows = [(a, passages) for a in ["trang 9 rồi trang 3", "trang 77", "không nêu", "trang 1, trang 2, trang 9, trang 3"]] + [("trang 3", [])]
    got = evaluate(ci.select_cited_sources, rows, kind)
    assert got == [["C, trang 9", "A, trang 1-3"], ["A, trang 1-3"], ["A, trang 1-3"], ["A, trang 1-3", "C, trang 9"], []]


def test_page_offsets(spark):
    seen = [("sure", p, [p - 1, 300]) for p in range(30, 40)] + [("split", p, [p - p % 2]) for p in range(30, 36)]
    seen += [("few", p, [p]) for p in range(3)] + [("none", 5, [900])] + [("tie", p, [p - (1 if p % 2 else 2)]) for p in range(11, 21)]
    df = spark.createDataFrame(seen, "source_file string, page_number int, read array<int>")
    observed = df.withColumn("offset", po.page_offset(F.col("page_number"), F.col("read")))
    got = {r["source_file"]: (r["offset"], r["agreeing"], r["usable"]) for r in po.measure_books(observed).collect()}
    assert got == {"sure": (1, 10, 10), "split": (None, 3, 6), "few": (None, 3, 3), "tie": (None, 5, 10)}
    measured = po.measure_books(observed)
    known = spark.createDataFrame([("sure", 7), ("old", 2), ("few", 4)], "source_file string, offset int")
    merged = {r["source_file"]: r["offset"] for r in po.merge_offsets(known, measured).collect()}
    assert merged == {"sure": 1, "old": 2, "few": 4}
    assert {r[0] for r in po.unmeasured(known, measured).collect()} == {"split", "tie"}


def test_audit_worklist(spark):
    pad = " lorem ipsum dolor sit amet" * 6
    rows = [("a", 1, "m0t s6tu t0an" + pad), ("a", 2, "a - b = b - a, c - d = d - c" + pad), ("b", 1, "ok" + pad), ("b", 2, "ngắn")]
    pages = spark.createDataFrame(rows, "book string, page int, text string").withColumn("grade", F.lit(6))
    repairs = spark.createDataFrame([("a", 1)], "book string, page int")
    audits = oa.mark_repaired(oa.audit_pages(oa.population(pages)), repairs, ["book", "page"])
    assert tuple(oa.totals(audits).first()) == (3, 1, 2, 1, 1)
    kinds = [r["kind"] for r in oa.kind_counts(audits).collect()]
    flagged = oa.flagged_pages(audits, kinds).select("book", "page", "n_issues")
    assert [tuple(r) for r in oa.worklist(flagged, repairs, ["book", "page"]).collect()] == [("a", 2, 2)]
    assert oa.sample(pages, [F.col("book"), F.col("page")], 2, 7).count() == 2
    assert oa.population(pages, formulas_only=True, grades=[6]).count() == 1


class FakeExtractor:
    """Content is JSON: a list of [text, images]."""

    def pages(self, content):
        for text, images in json.loads(bytes(content)):
            yield text, [i.encode() for i in images]


class FakeReader:
    def read(self, image):
        return image.decode().upper()


def test_files_to_chunks(spark, tmp_path):
    body = " ".join(f"Câu số {i} nói về phân số và số tự nhiên." for i in range(30))
    book = [[f"Đầu trang\n{body}\n{n}", []] for n in range(1, 5)] + [["", ["đầu trang\nquét ảnh"]], ["", []]]
    for grade, name in [("6", "SGKToan6tapmot"), ("7", "SGKNguvan7"), ("7", "SGKToan6")]:
        (tmp_path / grade).mkdir(exist_ok=True)
        (tmp_path / grade / f"{name}.pdf").write_text(json.dumps(book))
    files = bk.list_files(spark, str(tmp_path))
    planned = plan_files(files.select("path", "content"), None)
    assert planned.count() == 2
    pages = bk.read_images(bk.extract_pages(planned, FakeExtractor), FakeReader)
    cleaned = bk.clean_pages(pages)
    assert cleaned.count() == 2 * 5
    assert cleaned.where(F.contains("text", F.lit("Đầu trang"))).count() == 0
    chunks = ingest(cleaned, planned, Settings(chunk_size=400, chunk_overlap=80))
    tb.write_chunks(chunks, str(tmp_path / "index"))
    stored = tb.read_chunks(spark, str(tmp_path / "index"))
    assert {(r["grade"], r["subject"]) for r in stored.collect()} == {(6, "Toán"), (7, "Ngữ văn")}
    assert stored.count() == stored.select("id").distinct().count() > 10
    assert plan_files(files.select("path"), stored).count() == 0
    assert plan_files(files.select("path"), stored, force=True).count() == 2
    with pytest.raises(Exception):
        tb.read_chunks(spark, str(tmp_path / "nothing"))


def test_stored_documents(spark, tmp_path):
    cache = tmp_path / "cache" / "6"
    cache.mkdir(parents=True)
    (cache / "SGKToan6.json").write_text(json.dumps([{"page_number": 1, "text": "một"}, {"page_number": 2, "text": "hai"}]))
    (cache / "Hong.json").write_text("{not json")
    pages = tb.read_page_cache(spark, str(tmp_path / "cache"))
    assert sorted(map(tuple, pages.collect())) == [(6, "SGKToan6", 1, "một"), (6, "SGKToan6", 2, "hai")]
    assert tb.read_page_cache(spark, str(tmp_path / "missing")).count() == 0
    offsets = tmp_path / "offsets.json"
    offsets.write_text(json.dumps({"offsets": {"a.pdf": 1, "b.pdf": -1, "c.pdf": "x", "d.pdf": 0, "e.pdf": 1.5}, "note": "n"}))
    assert sorted(map(tuple, tb.read_offsets(spark, str(offsets)).collect())) == [("a.pdf", 1), ("d.pdf", 0)]
    offsets.write_text("broken")
    assert tb.read_offsets(spark, str(offsets)).count() == 0
    assert tb.read_offsets(spark, str(tmp_path / "none.json")).count() == 0
    repairs = tmp_path / "repairs.json"
    repairs.write_text(json.dumps({"pages": [{"grade": 6, "subject": "Toán", "book_title": "T", "source_file": "a.pdf", "page": 3, "text": "x", "kinds": ["k"]}]}))
    assert tb.read_repairs(spark, str(repairs)).first()["kinds"] == ["k"]
    small = spark.createDataFrame([("k", 1)], "kind string, n int")
    assert tb.markdown_table(small) == "| kind | n |\n|---|---|\n| k | 1 |"
    with pytest.raises(ValueError):
        tb.markdown_table(spark.range(5), limit=3)


def test_a_worklist_scans_its_pages_once_and_only_suspects_in_full(spark, sf):
    kinds = [fv.KIND_SWAPPED_MINUS, fv.KIND_LOST_EXPONENT]
    tail = " và đây là phần còn lại của trang sách, đủ dài để được xem xét như mọi trang khác trong cuốn sách này của chúng ta."
    texts = ["Ta có a - b = b - a." + tail, "A? - B* = C?" + tail, "Ta gọi = là một phân số." + tail, "a - b = b - a", None, "§" * 200]
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = oa.suspects(pages, kinds)
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 1]
    whole = oa.flagged_pages(oa.audit_pages(pages), kinds).select("doc_id", "issues")
    some = oa.flagged_pages(oa.audit_pages(found), kinds).select("doc_id", "issues")
    assert sorted(map(str, whole.collect())) == sorted(map(str, some.collect()))
    plan = QUERIES["repair_worklist"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "worklist" in plan  # what is sorted is a stored list
