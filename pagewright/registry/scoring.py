"""Queries over answer checking and benchmark scoring.

Answers are composed from table columns, so that the expected result follows
from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import answers as an
from pagewright.operators import citations as ci
from pagewright.operators import evaluation as ev
from pagewright.operators import reports as rp
from pagewright.plans.spread import spread
from pagewright.registry.common import query, quote, table
from pagewright.sources.tables import benchmark_sheet

# Each line item is an answer: it names page l_quantity, and a range from
# l_linenumber of length l_suppkey % 30; pages 1-5 and 20-24 were retrieved.
def _items(spark, sf_dir):
    return spread(table(spark, sf_dir, "lineitem"))


def _answer():
    return F.concat(
        F.lit("Theo sách Toán 6, TRANG "), F.col("l_quantity").cast("int").cast("string"),
        F.lit(": đúng. Trang  "), F.col("l_linenumber").cast("string"), F.lit(" - "),
        (F.col("l_linenumber") + F.col("l_suppkey") % 30).cast("string"), F.lit(" cũng có."),
    )


_SQL_NAMED = """
    named AS (
        SELECT l_orderkey, l_linenumber, l_partkey,
               list_sort(list_distinct([l_quantity::BIGINT] || CASE WHEN l_suppkey % 30 <= 20
                     THEN range(l_linenumber, l_linenumber + l_suppkey % 30 + 1) ELSE [l_linenumber::BIGINT] END)) AS pages FROM lineitem)
"""
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(f"WITH {_SQL_NAMED} SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(pages, ' ') AS pages FROM named")
def pages_named(spark, sf_dir):
    pages = F.array_join(an.pages_named(_answer()).cast("array<string>"), " ")
    return _items(spark, sf_dir).select(*_KEYS, pages.alias("pages"))


@query(
    f"""WITH {_SQL_NAMED}
    SELECT l_orderkey, l_linenumber, l_partkey,
           array_to_string(list_filter(pages, lambda x: x NOT IN (1, 2, 3, 4, 5, 20, 21, 22, 23, 24)), ' ') AS invented
    FROM named"""
)
def invented_pages(spark, sf_dir):
    spans = F.array(
        F.struct(F.lit(1).alias("page_start"), F.lit(5).alias("page_end")),
        F.struct(F.lit(20).alias("page_start"), F.lit(24).alias("page_end")),
    )
    invented = an.invented_pages(_answer(), ci.retrieved_pages(spans))
    return _items(spark, sf_dir).select(
        *_KEYS, F.array_join(invented.cast("array<string>"), " ").alias("invented")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN q IS NULL AND n IS NULL THEN 'P1' WHEN q IS NULL THEN n WHEN n IS NULL OR n = q THEN q ELSE q || '; ' || n END AS cited
    FROM (SELECT *, CASE WHEN l_quantity <= 5 THEN 'P1' WHEN l_quantity BETWEEN 4 AND 9 THEN 'P2' WHEN l_quantity = 30 THEN 'P3' END AS q,
                 CASE WHEN l_linenumber <= 5 THEN 'P1' WHEN l_linenumber <= 9 THEN 'P2' END AS n FROM lineitem)
    """
)
def cited_sources(spark, sf_dir):
    """Sources an answer sends its reader to: the first passage holding each mentioned page, two at most."""

    def passage(name, start, end):
        return F.struct(
            F.lit(name).alias("citation"), F.lit(start).cast("int").alias("page_start"), F.lit(end).cast("int").alias("page_end")
        )

    passages = F.array(passage("P1", 1, 5), passage("P2", 4, 9), passage("P3", 30, None))
    cited = F.array_join(ci.select_cited_sources(_answer(), passages), "; ")
    return _items(spark, sf_dir).select(*_KEYS, cited.alias("cited"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           'Câu ' || l_linenumber || ' nói rõ' || CASE WHEN l_quantity IN (4, 5, 20) THEN ' ở trang ' || l_quantity::INT ELSE '' END || ' nhé.' ||
           CASE WHEN l_quantity IN (4, 5, 20) THEN ' Xem thêm **trang ' || l_quantity::INT || '** nhé.' ELSE '' END || chr(10) ||
           '- theo sách x' || ['⁰','¹','²','³','⁴','⁵','⁶','⁷'][l_linenumber + 1] || ' trong sách' AS polished
    FROM lineitem
    """
)
def polished_answers(spark, sf_dir):
    """Internal wording hidden, invented page references dropped, exponents raised."""
    page = F.col("l_quantity").cast("int").cast("string")
    raw = F.concat(
        F.lit("[Đoạn 3] Câu "), F.col("l_linenumber").cast("string"), F.lit(" nói rõ ở trang "), page, F.lit(" nhé. Xem thêm **trang "),
        page, F.lit("** nhé.\n- theo ngữ cảnh x^"), F.col("l_linenumber").cast("string"), F.lit(" trong ngữ cảnh trên"),
    )
    polished = an.polish_answer(raw, F.array(F.lit(4), F.lit(5), F.lit(20)))
    return _items(spark, sf_dir).select(*_KEYS, polished.alias("polished"))


@query(
    """SELECT o_orderkey, array_to_string(list_filter([o_orderpriority || ', trang ' || (o_orderkey % 3), 'B, trang 2', o_orderpriority || ', trang ' || (o_orderkey % 2)],
              lambda x, i: starts_with(x, o_orderpriority || ', ') AND (i = 1 OR o_orderkey % 3 <> o_orderkey % 2)), '; ') AS listed FROM orders"""
)
def same_book_sources(spark, sf_dir):
    """Citations worth opening: those of the best match's book."""

    def cite(n):
        return F.concat("o_orderpriority", F.lit(", trang "), (F.col("o_orderkey") % n).cast("string"))

    citations = F.array(cite(3), F.lit("B, trang 2"), F.lit("  "), cite(2))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(an.same_book_as_best(citations), "; ").alias("listed")
    )


_REPLIES = [
    "Mình KHÔNG TÌM THẤY nội dung này", "Phần này không có trong sách giáo khoa", "Câu hỏi ngoài phạm vi lớp 6, xem trang 12",
    "Phân số là số có dạng a/b", fv.NO_CONTEXT_ANSWER, fv.RATE_LIMIT_ANSWER, "Theo trang 7, sách nói đủ",
]


@query(
    f"""SELECT o_orderkey, r IN (0, 1, 2, 4) AS refused, r IN (2, 6) AS names_a_page, r NOT IN (0, 1, 4) AS grounded, r = 5 AS provider_error
        FROM (SELECT o_orderkey, o_orderkey % {len(_REPLIES)} AS r FROM orders)"""
)
def refusals(spark, sf_dir):
    reply = F.element_at(F.array(*map(F.lit, _REPLIES)), (F.col("o_orderkey") % len(_REPLIES)).cast("int") + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("a")).select(
        "o_orderkey", an.looks_like_refusal(F.col("a")).alias("refused"), an.names_a_page(F.col("a")).alias("names_a_page"),
        an.grounded(F.col("a")).alias("grounded"), an.is_provider_error(F.col("a")).alias("provider_error"),
    )


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Toán' WHEN 1 THEN 'Lịch sử' WHEN 3 THEN '__not_subject_specific__' END AS detected FROM part"""
)
def subject_replies(spark, sf_dir):
    """Replies of a classifier matched to the subjects on offer."""
    replies = ["Môn toan.", "LICH SU", "Toán hoặc Lịch sử", " khac ", ""]
    reply = F.element_at(F.array(*map(F.lit, replies)), (F.col("p_partkey") % 5).cast("int") + 1)
    subjects = F.array(F.lit("Lịch sử"), F.lit("Toán"), F.lit("Vật lí"))
    return table(spark, sf_dir, "part").select("p_partkey", an.parse_classification(reply, subjects).alias("detected"))


# --- Benchmark: labelled documents are questions ---------------------------------------------
# quality 1: the textbook covers it.  toxic 1: the answer refuses.

_SQL_OUTCOMES = f"""
    outcomes AS (
        SELECT doc_id, quality = 1 AS in_textbook, doc_id % 11 = 0 AS provider_error, toxic = 1 AND doc_id % 11 <> 0 AS refused,
               CASE WHEN toxic = 0 AND doc_id % 11 <> 0 THEN doc_id % 7 END AS page, lang IN ('en', 'fr') AS keyed,
               CASE lang WHEN 'en' THEN contains(lower(text), 'the') WHEN 'fr' THEN contains(lower(text), 'zzz') END AS hit,
               doc_id % 13 <> 0 AS in_scope, n_chars % 3 AS retrieved, doc_id % 11 <> 0 AND toxic = 0 AS from_text
        FROM labels JOIN documents USING (doc_id)),
    scored AS (
        SELECT *, coalesce(from_text AND hit, false) AS found,
               from_text AND (page >= 4 OR retrieved = 0) AS invented, from_text AS cites, in_scope OR retrieved = 0 AS scope_ok FROM outcomes),
    judged AS (
        SELECT *, CASE WHEN provider_error THEN {quote(fv.VERDICT_ERROR)}
                       WHEN in_textbook AND refused THEN {quote(fv.VERDICT_WRONG_REFUSAL)}
                       WHEN in_textbook AND invented THEN {quote(fv.VERDICT_WRONG_PAGE)}
                       WHEN in_textbook AND keyed AND NOT found THEN {quote(fv.VERDICT_HUMAN)}
                       WHEN in_textbook THEN {quote(fv.VERDICT_PASS)}
                       WHEN refused THEN {quote(fv.VERDICT_REFUSED_RIGHTLY)} ELSE {quote(fv.VERDICT_HALLUCINATION)} END AS verdict,
               NOT provider_error AND refused <> in_textbook AS handled_correctly
        FROM scored)
"""


def _outcomes(spark, sf_dir):
    answer = (
        F.when(F.col("doc_id") % 11 == 0, fv.SERVICE_ERROR_ANSWER)
        .when(F.col("toxic") == 1, fv.NO_CONTEXT_ANSWER)
        .otherwise(F.concat("text", F.lit(" trang "), (F.col("doc_id") % 7).cast("string")))
    )
    keywords = F.when(F.col("lang") == "en", F.array(F.lit("THE"))).when(F.col("lang") == "fr", F.array(F.lit("zzz"))).otherwise(
        F.array().cast("array<string>")
    )
    passage = F.struct(
        F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("lang")).alias("subject"), F.lit(5).alias("grade"),
        F.lit(0).alias("page_start"), F.lit(3).alias("page_end"), F.concat("source", F.lit(", trang 0-3")).alias("citation"),
    )
    passages = F.filter(F.array_repeat(passage, (F.col("n_chars") % 3).cast("int")), lambda p: p.isNotNull())
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("source").alias("question"), F.lit(6).alias("grade"), F.col("lang").alias("subject"),
        (F.col("quality") == 1).alias("in_textbook"), keywords.alias("keywords"), answer.alias("answer"), passages.alias("passages"),
    )
    return ev.with_verdict(ev.score(rows))


@query(f"WITH {_SQL_OUTCOMES} SELECT doc_id, verdict, handled_correctly, refused, invented, cites, found, scope_ok FROM judged")
def verdicts(spark, sf_dir):
    return _outcomes(spark, sf_dir).select(
        "doc_id", "verdict", "handled_correctly", "refused", (F.size("invented_pages") > 0).alias("invented"),
        F.col("cites_a_page").alias("cites"), (F.size("keywords_found") > 0).alias("found"), F.col("in_scope").alias("scope_ok"),
    )


@query(
    f"""WITH {_SQL_OUTCOMES}
    SELECT count(*) AS questions, count(*) FILTER (in_textbook) AS in_textbook, count(*) FILTER (NOT in_textbook) AS out_of_textbook,
           count(*) FILTER (provider_error) AS provider_errors, count(*) FILTER (in_textbook AND NOT provider_error) AS in_book_asked,
           count(*) FILTER (NOT in_textbook AND NOT provider_error) AS out_book_asked,
           count(*) FILTER (in_textbook AND NOT provider_error AND NOT refused) AS answered,
           count(*) FILTER (in_textbook AND refused) AS wrong_refusals,
           count(*) FILTER (NOT in_textbook AND NOT provider_error AND NOT refused) AS hallucinations,
           count(*) FILTER (NOT in_textbook AND refused) AS refused_rightly,
           count(*) FILTER (in_textbook AND NOT provider_error AND NOT refused AND cites) AS answers_citing_a_page,
           count(*) FILTER (invented) AS invented_citations, count(*) FILTER (NOT scope_ok) AS out_of_scope,
           count(*) FILTER (in_textbook AND NOT provider_error AND NOT refused AND keyed AND NOT found) AS needs_human_review
    FROM judged"""
)
def benchmark_report(spark, sf_dir):
    return ev.report(_outcomes(spark, sf_dir))


def _sql_rate(part: str, whole: str) -> str:
    return f"coalesce(count(*) FILTER ({part}) / nullif(count(*) FILTER ({whole}), 0), 0)"


_SQL_IN, _SQL_OUT = "in_textbook AND NOT provider_error", "NOT in_textbook AND NOT provider_error"


@query(
    f"""WITH {_SQL_OUTCOMES}
    SELECT {_sql_rate(_SQL_IN + " AND NOT refused", _SQL_IN)} AS answer_rate,
           {_sql_rate(_SQL_IN + " AND refused", _SQL_IN)} AS wrong_refusal_rate,
           {_sql_rate(_SQL_OUT + " AND refused", _SQL_OUT)} AS right_refusal_rate,
           {_sql_rate(_SQL_OUT + " AND NOT refused", _SQL_OUT)} AS hallucination_rate,
           {_sql_rate(_SQL_IN + " AND NOT refused AND cites", _SQL_IN + " AND NOT refused")} AS citation_rate
    FROM judged"""
)
def benchmark_rates(spark, sf_dir):
    return ev.rates(ev.report(_outcomes(spark, sf_dir)))


@query(
    f"""WITH {_SQL_OUTCOMES}
    SELECT doc_id AS stt, CASE WHEN in_textbook THEN 'có' ELSE 'không' END AS co_trong_sach, CASE WHEN refused THEN 'không' ELSE 'có' END AS da_tra_loi,
           verdict AS ket_qua_tu_dong, retrieved AS so_doan_tra_duoc, CASE WHEN retrieved > 0 THEN source || ', trang 0-3' ELSE '' END AS trang_da_trich,
           CASE WHEN invented THEN page::VARCHAR ELSE '' END AS trang_bia_dat
    FROM judged JOIN documents USING (doc_id)"""
)
def benchmark_marking_sheet(spark, sf_dir):
    """The sheet a person marks, one row per question."""
    sheet = benchmark_sheet(_outcomes(spark, sf_dir).withColumn("position", F.col("doc_id")))
    return sheet.select(
        "stt", "co_trong_sach", "da_tra_loi", "ket_qua_tu_dong", "so_doan_tra_duoc", "trang_da_trich", "trang_bia_dat"
    )


_SQL_GROUPS = [
    (rp.WRONG_REFUSALS, "NOT provider_error AND in_textbook AND refused"),
    (rp.HALLUCINATIONS, "NOT provider_error AND NOT in_textbook AND NOT refused"),
    (rp.INVENTED, "invented"),
    (rp.OUT_OF_SCOPE, "NOT scope_ok"),
    (rp.REVIEW, "NOT provider_error AND in_textbook AND NOT refused AND keyed AND NOT found"),
]
_SQL_HEADS = " UNION ALL ".join(
    f"SELECT {2 + k}, -1, {quote('## ' + name + ': ')} || count(*) FROM judged WHERE {rule} HAVING count(*) > 0"
    for k, (name, rule) in enumerate(_SQL_GROUPS)
)
_SQL_ENTRIES = " UNION ALL ".join(
    f"""SELECT {2 + k}, doc_id, '- ' || asked || CASE WHEN invented THEN ' – trang: ' || page ELSE '' END FROM told WHERE {rule}"""
    for k, (_, rule) in enumerate(_SQL_GROUPS)
)


@query(
    f"""WITH {_SQL_OUTCOMES},
    told AS (SELECT j.*, d.source, d.lang, 'Lớp 6 ' || d.lang || ': ' || d.source AS asked FROM judged j JOIN documents d USING (doc_id))
    {_SQL_HEADS} UNION ALL {_SQL_ENTRIES} UNION ALL
    SELECT 7 AS part, doc_id AS place, '| ' || doc_id || ' | 6 | ' || lang || ' | ' || source || ' | ' || retrieved || ' | ' || verdict || ' | ' ||
           CASE WHEN refused THEN '-' WHEN retrieved > 0 THEN source || ', trang 0-3' ELSE '' END || ' |' AS text FROM told""".replace(
        "SELECT 2, -1, ", "SELECT 2 AS part, -1 AS place, ", 1
    ).replace(" || count(*) FROM", " || count(*) AS text FROM", 1)
)
def benchmark_lines(spark, sf_dir):
    """The groups of questions to look at first, and the table of all questions."""
    lines = rp.benchmark_lines(_outcomes(spark, sf_dir).withColumn("position", F.col("doc_id")))
    return lines.where("part BETWEEN 2 AND 6 OR (part = 7 AND place >= 0)")


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN '-' ELSE printf('%.1f%%', (o_orderkey % 3) / (o_custkey % 4) * 100) END AS share FROM orders"""
)
def percentages(spark, sf_dir):
    from pagewright.functions.text import percentage

    return table(spark, sf_dir, "orders").select(
        "o_orderkey", percentage(F.col("o_orderkey") % 3, F.col("o_custkey") % 4).alias("share")
    )
