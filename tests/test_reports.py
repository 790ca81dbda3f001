"""Reports: what they state, and what they say where there is nothing to state."""

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.operators import evaluation as ev
from pagewright.operators import reports as rp

PASSAGES = "array<struct<subject:string,grade:int,page_start:int,page_end:int,citation:string>>"
ASKED = f"position int, question string, grade int, subject string, in_textbook boolean, keywords array<string>, answer string, passages {PASSAGES}"
HERE = ("toán", 6, 12, 12, "SGK Toán 6, trang 12")


def _text(lines):
    return "\n".join(r["text"] for r in lines.orderBy("part", "place").collect())


def _benchmark(spark, *rows):
    return _text(rp.benchmark_lines(ev.with_verdict(ev.score(spark.createDataFrame(list(rows), ASKED)))))


def test_benchmark_report_states_figures_and_groups(spark, tmp_path):
    answer = "Theo sách Toán 6, trang 12: có hai ước."
    inside = (1, "Ước là gì?", 6, "toán", True, [], answer, [HERE])
    text = _benchmark(spark, inside, (2, "Giá vàng?", 6, "toán", False, [], answer, [HERE]))
    assert f"| {rp.HALLUCINATIONS} | 1/1 |" in text and f"| {rp.ANSWERED} | 1/1 (100.0%) |" in text
    assert f"## {rp.HALLUCINATIONS}: 1\n- Lớp 6 toán: Giá vàng?" in text and "## " + rp.WRONG_REFUSALS not in text
    assert "### 1. Lớp 6 toán: Ước là gì?" in text and text.index("| 1 | 6") < text.index("| 2 | 6") < text.index("### 1.")
    text = _benchmark(spark, inside, (2, "Giá vàng?", 6, "toán", False, [], fv.SERVICE_ERROR_ANSWER, []))
    assert f"| {rp.ERRORS} | 1 |" in text and f"| {rp.HALLUCINATIONS} | 0/0 |" in text
    assert "Không có câu nào cần xem lại." in text
    outcomes = ev.with_verdict(ev.score(spark.createDataFrame([inside], ASKED)))
    rp.write_report(rp.benchmark_lines(outcomes), str(tmp_path / "report"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert written.startswith("# Kết quả kiểm thử") and written.rstrip().endswith(answer)


def _tables(spark, reports, ratings):
    answers = spark.createDataFrame(
        [(1, "10", None, 6, "toán", "Phân số là gì?", "Là a/b.\nThế thôi.", "SGK Toán 6, trang 12", 1)],
        "answer_id long, user_id string, display_name string, grade int, subject string, question string, answer string, citations string, grounded int",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    kind = "report_id long, answer_id long, reporter_id string, note string, reporter_name string"
    reported = spark.createDataFrame(reports, kind).withColumn("created_at", F.lit("2024-01-02").cast("timestamp"))
    return answers, reported, spark.createDataFrame(ratings, "answer_id long, user_id string, clarity int, guidance int")


def test_review_sheet_and_message(spark):
    full = _tables(spark, [(7, 1, "11", None, "An")], [(1, "11", 5, 4)])
    for text in (_text(rp.feedback_lines(*full)), rp.feedback_message(*full).first()["text"]):
        assert "Phân số là gì?" in text and "SGK Toán 6, trang 12" in text and "5.00/5" in text and "4.00/5" in text
        assert "#7 – An" in text and rp.NO_REPORTS not in text
    assert "> Là a/b.\n> Thế thôi." in _text(rp.feedback_lines(*full))
    empty = _tables(spark, [], [])
    for text in (_text(rp.feedback_lines(*empty)), rp.feedback_message(*empty).first()["text"]):
        assert rp.NO_REPORTS in text and rp.NO_SCORE in text and "0.00/5" not in text


def test_audit_report_lists_what_is_not_repaired(spark):
    kind = "grade int, book string, page int, has_formula boolean, repaired boolean, issues array<struct<kind:string,explanation:string,snippet:string>>"
    issue = ("mất phân số", "thiếu gạch ngang", "1 2")
    rows = [(6, "Toán", 3, True, False, [issue]), (6, "Toán", 4, False, True, [issue]), (6, "Toán", 5, False, False, [])]
    text = _text(rp.audit_lines(spark.createDataFrame(rows, kind), seed=7))
    assert "Số trang đã soát: 3 (seed = 7)" in text and "Còn phải xử lí: 1" in text and "| mất phân số | 2 |" in text
    assert "### Lớp 6 – Toán – trang 3" in text and "trang 4" not in text and "`1 2`" in text
