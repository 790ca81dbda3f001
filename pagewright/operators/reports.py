"""Reports as tables of their parts, so that one over any number of rows is written by Spark.

A report has the columns part, place and text: parts follow one another, and
within a part texts come in the order of place.  Totals are small aggregates that
become rows; a question, page or reported answer becomes its own rows where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.answers import is_blank
from pagewright.functions.text import percentage
from pagewright.operators import audit as ad
from pagewright.operators import evaluation as ev
from pagewright.operators import feedback as fb

# What a report calls its figures.
ANSWERED = "Câu trong sách được trả lời"
WRONG_REFUSALS = "Từ chối nhầm (sách có mà không trả lời)"
RIGHT_REFUSALS = "Câu ngoài sách bị từ chối đúng"
HALLUCINATIONS = "Trả lời câu ngoài sách (bịa đặt)"
CITING = "Câu trả lời có nêu số trang"
INVENTED = "Nêu trang không hề được tra ra"
OUT_OF_SCOPE = "Dùng đoạn sai môn hoặc vượt lớp"
REVIEW = "Cần người đọc lại để chấm đúng/sai"
ERRORS = "Lỗi kỹ thuật, chưa hỏi được"
NO_REPORTS = "Chưa có câu nào bị báo sai."
NO_SCORE = "chưa có"

TABLE = "| Chỉ số | Kết quả |\n|---|---|"


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _of(part: str, whole: str) -> Column:
    return _said(F.col(part), "/", F.col(whole))


def _row(name: str, value: Column) -> Column:
    return _said(f"| {name} | ", value, " |")


def _lines(row: DataFrame, lines: list[tuple[int, Column | str, Column | None]]) -> DataFrame:
    """The lines (part, text, condition) of a one-row table."""
    entries = [
        F.struct(
            F.lit(part).alias("part"), F.lit(i).cast("long").alias("place"),
            (F.lit(t) if isinstance(t, str) else t if given is None else F.when(given, t)).alias("text"),
        )
        for i, (part, t, given) in enumerate(lines)
    ]
    return row.select(F.inline(F.array(*entries))).where("text IS NOT NULL")


def benchmark_lines(outcomes: DataFrame, title: str = "Kết quả kiểm thử") -> DataFrame:
    """The report on scored outcomes (with position and verdict), which are read twice.

    Parts: 1 figures, 2 to 6 the groups to look at first (as in the figures), 7 every question, 8 every answer.
    """
    counts = ev.report(outcomes)
    groups = [
        (WRONG_REFUSALS, "wrong_refusals", ~F.col("provider_error") & F.col("in_textbook") & F.col("refused")),
        (HALLUCINATIONS, "hallucinations", ~F.col("provider_error") & ~F.col("in_textbook") & ~F.col("refused")),
        (INVENTED, "invented_citations", F.size("invented_pages") > 0),
        (OUT_OF_SCOPE, "out_of_scope", ~F.col("in_scope")),
        (REVIEW, "needs_human_review", ~F.col("provider_error") & F.col("in_textbook") & ~F.col("refused")
         & (F.size("keywords") > 0) & (F.size("keywords_found") == 0)),
    ]
    figures = [
        _said(f"# {title}\n\n", F.col("questions"), " câu: ", F.col("in_textbook"), " trong sách, ", F.col("out_of_textbook"), " ngoài sách"),
        TABLE,
        _row(ANSWERED, _said(_of("answered", "in_book_asked"), " (", percentage(F.col("answered"), F.col("in_book_asked")), ")")),
        _row(WRONG_REFUSALS, _of("wrong_refusals", "in_book_asked")),
        _row(RIGHT_REFUSALS, _of("refused_rightly", "out_book_asked")),
        _row(HALLUCINATIONS, _of("hallucinations", "out_book_asked")),
        _row(CITING, _of("answers_citing_a_page", "answered")),
        _row(INVENTED, F.col("invented_citations")),
        _row(OUT_OF_SCOPE, F.col("out_of_scope")),
        _row(REVIEW, F.col("needs_human_review")),
        _row(ERRORS, F.col("provider_errors")),
    ]
    heads = [(2 + k, _said(f"## {name}: ", F.col(c)), F.col(c) > 0) for k, (name, c, _) in enumerate(groups)]
    nothing = F.greatest(*[F.col(c) for _, c, _ in groups]) == 0
    more = [(2, _said("Không có câu nào cần xem lại."), nothing), (7, "| # | Lớp | Môn | Câu hỏi | Đoạn | Kết quả | Trang |\n|" + "---|" * 7, None)]
    # Heads stand before all positions of their part.
    head = _lines(counts, [(1, f, None) for f in figures] + heads + more)
    head = head.withColumn("place", F.when(F.col("part") > 1, F.lit(-1)).otherwise(F.col("place")).cast("long"))

    asked = _said("Lớp ", F.col("grade"), " ", F.col("subject"), ": ", F.col("question"))
    pages = F.array_join(F.col("invented_pages").cast("array<string>"), ", ")
    sources = F.when(F.col("refused"), "-").otherwise(F.array_join(F.slice("retrieved_sources", 1, 2), "; "))
    entries = [(2 + k, F.when(rule, _said("- ", asked, F.when(pages != "", _said(" – trang: ", pages))))) for k, (_, _, rule) in enumerate(groups)]
    cells = [F.col("position"), F.col("grade"), F.col("subject"), F.col("question"), F.col("retrieved"), F.col("verdict"), sources]
    entries.append((7, _said("| ", *[x for c in cells[:-1] for x in (c, " | ")], cells[-1], " |")))
    answer = F.when(is_blank(F.col("answer")), "(không có nội dung)").otherwise(F.trim("answer"))
    entries.append((8, _said("### ", F.col("position"), ". ", asked, "\n\n", F.col("verdict"), "\n\n", answer)))
    rows = [F.struct(F.lit(p).alias("part"), F.col("position").cast("long").alias("place"), t.alias("text")) for p, t in entries]
    return head.unionByName(outcomes.select(F.inline(F.array(*rows))).where("text IS NOT NULL"))


def audit_lines(audits: DataFrame, seed: int, title: str = "Soát lỗi đọc chữ") -> DataFrame:
    """The report on audited pages (grade, book, page, issues, has_formula, repaired).

    Parts: 1 figures, 2 kinds of issues, most frequent first, 3 the flagged pages not repaired yet.
    """
    figures = [
        (1, _said(f"# {title}\n\nSố trang đã soát: ", F.col("pages"), f" (seed = {seed})"), None),
        (1, _said("Số trang có công thức: ", F.col("formula_pages")), None),
        (1, _said("Số trang bị gắn cờ: ", F.col("flagged")), None),
        (1, _said("Trong đó đã vá: ", F.col("repaired")), None),
        (1, _said("Còn phải xử lí: ", F.col("to_do")), None),
    ]
    kinds = ad.kind_counts(audits).select(F.lit(2).alias("part"), (-F.col("n")).alias("place"), _row_of("kind", "n").alias("text"))
    issue = F.transform("issues", lambda i: _said("- ", i["kind"], ": ", i["explanation"], " `", i["snippet"], "`"))
    page = _said("### Lớp ", F.col("grade"), " – ", F.col("book"), " – trang ", F.col("page"), "\n\n", F.array_join(issue, "\n"))
    todo = audits.where((F.size("issues") > 0) & ~F.col("repaired"))
    pages = todo.select(F.lit(3).alias("part"), F.col("page").cast("long").alias("place"), page.alias("text"))
    return _lines(ad.totals(audits), figures).unionByName(kinds).unionByName(pages)


def _row_of(name: str, value: str) -> Column:
    return _said("| ", F.col(name), " | ", F.col(value), " |")


def _score(average: str) -> Column:
    return F.when(F.col(average).isNull(), NO_SCORE).otherwise(F.format_string("%.2f/5", F.col(average)))


def _cited(missing: str) -> Column:
    cited = F.array_join(F.filter(F.split(F.coalesce("citations", F.lit("")), "\n"), lambda c: c != ""), "; ")
    return F.when(cited == "", missing).otherwise(cited)


def _totals(answers: DataFrame, reports: DataFrame, ratings: DataFrame) -> DataFrame:
    return fb.summary(answers, reports, ratings)


def feedback_lines(
    answers: DataFrame, reports: DataFrame, ratings: DataFrame, limit: int = 50, title: str = "Phiếu rà soát câu trả lời"
) -> DataFrame:
    """The review sheet: 1 figures, 2 the ``limit`` newest reports with their answers."""
    figures = [
        _said(f"# {title}\n\n" + TABLE),
        _row("Số câu đã trả lời", F.col("answers")),
        _row("Trả lời được từ sách", F.col("grounded_answers")),
        _row("Chưa tìm thấy trong sách", F.col("refusals")),
        _row("Số lần báo sai", _said(F.col("reports"), " (từ ", F.col("reporters"), " bạn)")),
        _row("Tỉ lệ báo sai", F.format_string("%.1f%%", F.col("report_rate") * 100)),
        _row("Số lượt chấm điểm", _said(F.col("ratings"), " (từ ", F.col("raters"), " bạn)")),
        _row("Dễ hiểu", _score("average_clarity")),
        _row("Gợi mở", _score("average_guidance")),
    ]
    lines = [(1, f, None) for f in figures] + [(2, F.lit(NO_REPORTS), F.col("reports") == 0)]
    entry = _said(
        "### #", F.col("report_id"), " – ", F.col("reporter"), " (lớp ", F.col("grade"), ", ", F.col("subject"), ")\n\n- ",
        F.col("created_at"), "\n- Câu hỏi: ", F.col("question"), "\n- Lý do: ", F.coalesce("note", F.lit("(không ghi)")),
        "\n- Trang sách: ", _cited("(không trích)"), "\n\n> ", F.replace("answer", F.lit("\n"), F.lit("\n> ")),
    )
    newest = fb.recent_reports(reports, answers, limit)
    return _lines(_totals(answers, reports, ratings), lines).unionByName(
        newest.select(F.lit(2).alias("part"), (-F.col("report_id")).cast("long").alias("place"), entry.alias("text"))
    )


def feedback_message(answers: DataFrame, reports: DataFrame, ratings: DataFrame, newest: int = 5) -> DataFrame:
    """One row with ``text``: the totals and the newest reports, as sent to those who may read them."""
    entry = _said(
        "\n\n#", F.col("report_id"), " – ", F.col("reporter"), " (lớp ", F.col("grade"), ", ", F.col("subject"), ")\nHỏi: ",
        F.col("question"), "\nLý do: ", F.coalesce("note", F.lit("không ghi")), "\nTrang sách: ", _cited("không trích"),
    )
    listed = fb.recent_reports(reports, answers, newest).select("report_id", entry.alias("entry"))
    # At most ``newest`` rows.
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("report_id", "entry")), asc=False).alias("entries"))
    text = _said(
        "Câu trả lời: ", F.col("answers"), " (từ sách: ", F.col("grounded_answers"), ", chưa tìm thấy: ", F.col("refusals"),
        ")\nBáo sai: ", F.col("reports"), " lượt, ", F.col("reporters"), " bạn\nChấm điểm: ", F.col("ratings"), " lượt, ",
        F.col("raters"), " bạn\nDễ hiểu: ", _score("average_clarity"), "\nGợi mở: ", _score("average_guidance"),
        F.when(F.size("entries") == 0, "\n\n" + NO_REPORTS).otherwise(F.array_join("entries.entry", "")),
    )
    one = F.lit(1).alias("__one")
    return _totals(answers, reports, ratings).select("*", one).join(listed.select("*", one), "__one").select(text.alias("text"))


def write_report(lines: DataFrame, path: str) -> None:
    """The report as text files in the order of their names; large parts are cut over several files."""
    ordered = lines.repartitionByRange("part", "place").sortWithinPartitions("part", "place", "text")
    ordered.select("text").write.mode("overwrite").text(path, lineSep="\n\n")
