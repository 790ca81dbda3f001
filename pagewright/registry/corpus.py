"""Queries over ingestion: boilerplate, catalogue, chunks, index upkeep, page numbers, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import text as tx
from pagewright.operators import audit as oa
from pagewright.operators import boilerplate as bp
from pagewright.operators import catalog as ct
from pagewright.operators import citations as ci
from pagewright.operators import index as ix
from pagewright.operators import page_offsets as po
from pagewright.operators.chunking import chunk_pages
from pagewright.plans.materialize import scratch_path
from pagewright.registry.common import query, quote, sql_sentences, sql_strip, table
from pagewright.sources.question_sets import all_questions, read_question_set
from pagewright.sources.tables import load_through, save_repairs, saved_repairs

# --- Boilerplate: a source is a book, a document a page --------------------------------

#: Share of a source's documents a line has to be on.  No line is on half of them.
_RATIO = 0.1

_SQL_REPEATED = f"""
    lines AS (
        SELECT source, doc_id, unnest(list_distinct(list_filter(
            list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}),
            lambda x: x <> '' AND length(x) <= 80))) AS line
        FROM documents),
    books AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 3),
    repeated AS (
        SELECT source, line, count(*) AS pages_with_line
        FROM lines JOIN books USING (source)
        GROUP BY source, line, n HAVING count(*) >= greatest(2, floor(n * {_RATIO})))
"""


@query(f"WITH {_SQL_REPEATED} SELECT * FROM repeated")
def repeated_lines(spark, sf_dir):
    return bp.repeated_lines(table(spark, sf_dir, "documents"), "source", "text", _RATIO)


@query(
    f"""
    WITH {_SQL_REPEATED},
    blocked AS (SELECT source, list(line) AS b FROM repeated GROUP BY source)
    SELECT doc_id, CASE WHEN b IS NULL THEN text ELSE {sql_strip(
        "regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), "
        "lambda x: NOT list_contains(b, " + sql_strip('x') + ")), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')"
    )} END AS text
    FROM documents LEFT JOIN blocked USING (source)
    """
)
def drop_boilerplate(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return bp.drop_boilerplate(pages, "source", "doc_id", "text", _RATIO).select("doc_id", "text")


# --- Catalogue ---------------------------------------------------------------------------

_SQL_FILES = """
    parts AS (
        SELECT page_id, regexp_extract(url, '//([^/]+)/([a-z]+)/([0-9]+)', 2) AS lang,
               regexp_extract(url, '//([^/]+)/([a-z]+)/([0-9]+)', 3)::BIGINT AS number FROM pages),
    names AS (
        SELECT page_id, number % 14 AS folder,
               [concat('toan'), 'Dialy', 'xyz', 'Chuyendehoctap'][lang_no] AS stem,
               (number % 14 + CASE WHEN number % 5 = 0 THEN 1 ELSE 0 END) AS named,
               ['', 'taphai', 'tap1', 'ModunChebien'][(number % 4) + 1] AS suffix, lang_no
        FROM (SELECT *, list_position(['en', 'fr', 'de', 'es'], lang) AS lang_no FROM parts))
"""


def _book_files(spark, sf_dir):
    """Book paths made from page URLs: grade folder, subject by language, volume by number."""
    url = r"//[^/]+/([a-z]+)/([0-9]+)"
    number = F.regexp_extract("url", url, 2).cast("bigint")
    lang = F.array_position(F.array(*map(F.lit, ["en", "fr", "de", "es"])), F.regexp_extract("url", url, 1)).cast("int")
    stems = F.array(*map(F.lit, ["toan", "Dialy", "xyz", "Chuyendehoctap"]))
    suffixes = F.array(*map(F.lit, ["", "taphai", "tap1", "ModunChebien"]))
    named = number % 14 + F.when(number % 5 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(
            F.lit("raw/"), (number % 14).cast("string"), F.lit("/SGK"), F.element_at(stems, lang),
            named.cast("string"), F.element_at(suffixes, (number % 4 + 1).cast("int")), F.lit(".PDF"),
        ).alias("path"),
    )


@query(
    f"""
    WITH {_SQL_FILES}
    SELECT page_id, folder AS grade, ['Toán', 'Địa lí', 'Xyz'][lang_no] AS subject,
           ['Toán', 'Địa lí', 'Xyz'][lang_no] || ' ' || folder ||
           ['', ' - tập 2', ' - tập 1', ' - Modun Chebien'][list_position(['', 'taphai', 'tap1', 'ModunChebien'], suffix)] AS book_title
    FROM names WHERE folder BETWEEN 1 AND 12 AND lang_no < 4 AND named = folder
    """
)
def catalog(spark, sf_dir):
    books = ct.accepted(ct.infer_books(_book_files(spark, sf_dir)))
    return books.select("page_id", "grade", "subject", "book_title")


@query(
    f"""
    WITH {_SQL_FILES}
    SELECT page_id, CASE WHEN folder NOT BETWEEN 1 AND 12 THEN 'folder is not a grade'
                         WHEN lang_no = 4 THEN 'file name does not match'
                         ELSE 'grade differs from folder' END AS reject_reason
    FROM names WHERE folder NOT BETWEEN 1 AND 12 OR lang_no = 4 OR named <> folder
    """
)
def catalog_rejects(spark, sf_dir):
    return ct.rejected(ct.infer_books(_book_files(spark, sf_dir))).select("page_id", "reject_reason")


# --- Chunks --------------------------------------------------------------------------------

SQL_CHUNKS = f"""
    units AS (
        SELECT source, doc_id, s.i AS pos, s.t AS t
        FROM (SELECT source, doc_id, unnest(list_transform({sql_sentences('text')}, lambda x, i: {{'i': i, 't': x}})) AS s
              FROM documents WHERE NOT contains(text, 'MỤC LỤC'))),
    seq AS (SELECT source, doc_id AS page, t, length(t) + 1 AS n,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS k,
                   count(*) OVER (PARTITION BY source) AS total FROM units),
    fold AS (
        SELECT source, k, total, k AS first, n AS held, NULL::BIGINT AS cut_from, NULL::BIGINT AS cut_to, [n] AS ns FROM seq WHERE k = 1
        UNION ALL
        SELECT f.source, s.k, f.total,
               CASE WHEN full_now THEN s.k - keep ELSE first END,
               CASE WHEN full_now THEN coalesce(list_sum(ns[len(ns) - keep + 1:]), 0) + s.n ELSE held + s.n END,
               CASE WHEN full_now THEN first END,
               CASE WHEN full_now THEN s.k - 1 END,
               list_append(CASE WHEN full_now THEN ns[len(ns) - keep + 1:] ELSE ns END, s.n)
        FROM (SELECT *, CASE WHEN len(ns) = tail AND len(ns) > 1 THEN tail - 1 ELSE tail END AS keep
              FROM (SELECT *, greatest(1, len(list_filter(range(1, len(ns) + 1), lambda c: list_sum(ns[len(ns) - c + 1:]) <= 100))) AS tail
                    FROM fold)) f
        JOIN (SELECT * FROM seq) s ON s.source = f.source AND s.k = f.k + 1,
        LATERAL (SELECT f.held + s.n > 700 AS full_now)),
    cuts AS (
        SELECT source, cut_from, cut_to FROM fold WHERE cut_from IS NOT NULL
        UNION ALL SELECT source, first, k FROM fold WHERE k = total),
    chunks AS (
        SELECT c.source, row_number() OVER (PARTITION BY c.source ORDER BY cut_from) - 1 AS chunk_index, cut_from, cut_to FROM cuts c)
"""


@query(
    f"""
    WITH RECURSIVE {SQL_CHUNKS}
    SELECT c.source, c.chunk_index, md5(string_agg(s.t, ' ' ORDER BY s.k)) AS body, min(s.page) AS page_start, max(s.page) AS page_end
    FROM chunks c JOIN seq s ON s.source = c.source AND s.k BETWEEN c.cut_from AND c.cut_to
    GROUP BY c.source, c.chunk_index
    """
)
def chunk_documents(spark, sf_dir):
    """Every source as one book, every document as one page, chunked across page breaks."""
    pages = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    # A source has about every twentieth document, so 512 numbers hold some 25 pages.
    chunks = chunk_pages(pages, ["source"], page="doc_id", pages_per_block=512)
    return chunks.select("source", "chunk_index", F.md5("text").alias("body"), "page_start", "page_end")


# --- Index upkeep ----------------------------------------------------------------------------


def _document_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 12 + 1).cast("int").alias("grade"),
        F.col("lang").alias("subject"),
        F.col("source").alias("book_title"),
        F.concat("source", F.lit(".pdf")).alias("source_file"),
        F.col("doc_id").alias("chunk_index"),
        "text",
        F.col("doc_id").alias("page_start"),
        F.col("doc_id").alias("page_end"),
    )


def _sql_id(grade, subject, source, index, text):
    return f"sha256({grade} || '|' || {subject} || '|' || {source} || '|' || {index} || '|' || {text})"


_SQL_DOC_ID = _sql_id("(doc_id % 12 + 1)", "lang", "source || '.pdf'", "doc_id", "text")


@query(f"SELECT doc_id AS chunk_index, {_SQL_DOC_ID} AS id FROM documents")
def chunk_ids(spark, sf_dir):
    return ix.with_chunk_id(_document_chunks(spark, sf_dir)).select("chunk_index", "id")


@query(
    """
    WITH newest AS (
        SELECT l_orderkey, l_extendedprice, l_linestatus,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS r
        FROM lineitem)
    SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT l_orderkey, l_extendedprice, l_linestatus FROM newest WHERE r = 1
    """
)
def index_upsert(spark, sf_dir):
    """Orders as the table, line items as arrivals with many copies of a key; the last one wins."""
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    incoming = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_linestatus").alias("o_orderstatus"), "l_shipdate", "l_linenumber", "l_partkey",
    )
    return ix.upsert(stored, incoming, ["o_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "o_totalprice"])


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    return ix.delete(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), gone, ["doc_id"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def not_indexed_yet(spark, sf_dir):
    return ix.not_indexed_yet(
        table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"]
    )


@query("SELECT count(*) AS chunks FROM documents")
def index_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("chunks"))


def _fixes(spark, sf_dir):
    """Two corrections for every labelled document, the second one depending on the first."""
    books = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    wrong = F.when(F.col("lang") == "en", "the ").otherwise("e ")
    base = table(spark, sf_dir, "labels").join(books, "doc_id").select(
        F.concat("source", F.lit(".pdf")).alias("source_file"), F.col("doc_id").alias("chunk_index"), wrong.alias("w")
    )
    first = base.select("source_file", "chunk_index", F.lit(1).alias("position"), F.col("w").alias("wrong"), F.lit("<1> ").alias("right"))
    second = base.select("source_file", "chunk_index", F.lit(2).alias("position"), F.lit("<1> a").alias("wrong"), F.lit("<2>").alias("right"))
    return first.unionByName(second)


_SQL_FIXED = """
    CASE WHEN doc_id IN (SELECT doc_id FROM labels)
         THEN replace(replace(text, CASE WHEN lang = 'en' THEN 'the ' ELSE 'e ' END, '<1> '), '<1> a', '<2>') ELSE text END"""


@query(
    f"""WITH fixed AS (SELECT doc_id, lang, source, {_SQL_FIXED} AS text FROM documents)
        SELECT doc_id AS chunk_index, md5(text) AS body, {_SQL_DOC_ID} AS id FROM fixed"""
)
def text_fixes(spark, sf_dir):
    chunks = ix.with_chunk_id(_document_chunks(spark, sf_dir))
    return ix.apply_text_fixes(chunks, _fixes(spark, sf_dir)).select("chunk_index", F.md5("text").alias("body"), "id")


@query(
    f"""
    WITH fixed AS (SELECT doc_id, lang, source, {_SQL_FIXED} AS text FROM documents),
    repaired AS (SELECT doc_id, lang, source, arg_max(c.text, turn) AS text
                 FROM conversations c JOIN documents d ON d.doc_id = c.conv_id GROUP BY doc_id, lang, source)
    SELECT doc_id AS chunk_index, {_SQL_DOC_ID} AS id, doc_id AS page_start FROM fixed
    UNION ALL
    SELECT 900000 + item_id, {_sql_id("(item_id % 12 + 1)", "'patch'", "'patches.pdf'", "(900000 + item_id)", "text")}, item_id FROM benchmark
    UNION ALL
    SELECT 800000 + doc_id, {_sql_id("(doc_id % 12 + 1)", "lang", "source || '.pdf'", "(800000 + doc_id)", "text")}, doc_id FROM repaired
    """
)
def corrections(spark, sf_dir):
    """Patches, text fixes, then the last re-reading of each page, on top of the chunks."""
    chunks = ix.with_chunk_id(_document_chunks(spark, sf_dir))
    patches = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") % 12 + 1).cast("int").alias("grade"), F.lit("patch").alias("subject"),
        F.lit("patches").alias("book_title"), F.lit("patches.pdf").alias("source_file"),
        F.col("item_id").alias("page"), "text",
    )
    pages = chunks.select("grade", "subject", "book_title", "source_file", F.col("chunk_index").alias("page"))
    rereads = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), "turn", "text").join(pages, "page")
    repairs = ix.latest_repairs(rereads, "turn").drop("turn")
    return ix.apply_corrections(chunks, patches, _fixes(spark, sf_dir), repairs).select("chunk_index", "id", "page_start")


# --- Printed page numbers -------------------------------------------------------------------

_SQL_OBSERVED = """
    observed AS (
        SELECT l_suppkey, l_orderkey, l_linenumber,
               CASE WHEN l_quantity BETWEEN 0 AND 8 THEN least(l_linenumber, l_quantity) ELSE l_linenumber END::BIGINT AS off
        FROM lineitem),
    counts AS (SELECT l_suppkey, off, count(*) AS n, min(l_orderkey) AS first_page FROM observed WHERE off BETWEEN 0 AND 8 GROUP BY ALL),
    measured AS (
        SELECT l_suppkey AS s_suppkey, max(n) AS agreeing, sum(n)::BIGINT AS usable,
               CASE WHEN max(n) >= 4 AND max(n) / sum(n) >= 0.1
                    THEN arg_max(off, n * 1000000000000 - first_page) END AS off,
               string_agg(off || ':' || n, ' ' ORDER BY off) AS observed
        FROM counts GROUP BY l_suppkey)
"""


def _measured(spark, sf_dir):
    """Line items as sampled pages of their supplier's book: the order is the page, two numbers are read on it."""
    page = F.col("l_orderkey")
    read = F.array(page - F.col("l_linenumber"), page - F.col("l_quantity").cast("bigint"))
    observed = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), page.alias("page_number"), po.page_offset(page, read).alias("offset")
    )
    return po.measure_books(observed, "s_suppkey")


@query(
    f"""WITH {_SQL_OBSERVED.replace('>= 0.1', '>= 0.6')}
        SELECT s_suppkey, off AS "offset", agreeing, usable, observed FROM measured"""
)
def page_offsets(spark, sf_dir):
    seen = F.array_join(
        F.transform(F.map_entries("observed"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " "
    )
    return _measured(spark, sf_dir).select("s_suppkey", "offset", "agreeing", "usable", seen.alias("observed"))


@query(
    f"""WITH {_SQL_OBSERVED.replace('>= 0.1', '>= 0.6')}
        SELECT off AS "offset", count(*) AS books FROM measured GROUP BY off"""
)
def offset_histogram(spark, sf_dir):
    return po.offset_histogram(_measured(spark, sf_dir))


def _one_page_books(spark, sf_dir):
    """Line items of one ship mode per supplier as books whose pages mostly agree."""
    page = F.col("l_orderkey")
    agrees = F.when(F.col("l_partkey") % (F.col("l_suppkey") % 4 + 1) == 0, F.col("l_linenumber")).otherwise(F.col("l_suppkey") % 9)
    observed = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), page.alias("page_number"),
        po.page_offset(page, F.array(page - agrees.cast("bigint"))).alias("offset"),
    )
    return po.measure_books(observed, "s_suppkey")


_SQL_AGREEING = """
    counts AS (
        SELECT l_suppkey AS s_suppkey, off, count(*) AS n, min(l_orderkey) AS first_page
        FROM (SELECT *, CASE WHEN l_partkey % (l_suppkey % 4 + 1) = 0 THEN l_linenumber ELSE l_suppkey % 9 END AS off FROM lineitem) GROUP BY ALL),
    measured AS (
        SELECT s_suppkey, CASE WHEN max(n) >= 4 AND max(n) / sum(n) >= 0.6 THEN arg_max(off, n * 1000000000000 - first_page) END AS off
        FROM counts WHERE off <= 8 GROUP BY s_suppkey),
    known AS (SELECT s_suppkey, s_nationkey % 9 AS off FROM supplier WHERE s_nationkey % 3 > 0)
"""


def _known_offsets(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_nationkey % 3 > 0").select(
        "s_suppkey", (F.col("s_nationkey") % 9).cast("bigint").alias("offset")
    )


@query(
    f"""WITH {_SQL_AGREEING}
        SELECT s_suppkey, coalesce(m.off, k.off) AS "offset"
        FROM known k FULL OUTER JOIN (SELECT * FROM measured WHERE off IS NOT NULL) m USING (s_suppkey)"""
)
def merged_offsets(spark, sf_dir):
    return po.merge_offsets(_known_offsets(spark, sf_dir), _one_page_books(spark, sf_dir), "s_suppkey")


@query(
    f"""WITH {_SQL_AGREEING}
        SELECT s_suppkey FROM measured WHERE off IS NULL AND s_suppkey NOT IN (SELECT s_suppkey FROM known)"""
)
def unmeasured_books(spark, sf_dir):
    return po.unmeasured(_known_offsets(spark, sf_dir), _one_page_books(spark, sf_dir), "s_suppkey")


@query(
    """
    WITH numbered AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
                             count(*) OVER (PARTITION BY source) AS total FROM documents)
    SELECT source, doc_id FROM numbered
    WHERE total >= 20 AND i >= floor(total * 0.15) AND i < floor(total * 0.85)
      AND (i - floor(total * 0.15)) % greatest(1, floor((floor(total * 0.85) - floor(total * 0.15)) / 14)) = 0
    """
)
def sampled_pages(spark, sf_dir):
    from pagewright.plans.ordered import prefix_sum

    pages = table(spark, sf_dir, "documents").select("source", "doc_id")
    totals = pages.groupBy("source").agg(F.count("*").alias("total"))
    numbered = prefix_sum(pages, ["source"], "doc_id", F.lit(1), "i")
    return (
        numbered.join(totals, ["source"], "left")
        .where(po.sampled(F.col("i"), F.col("total")))
        .select("source", "doc_id")
    )


@query(
    """
    WITH offsets AS (SELECT DISTINCT source, source[4:]::INT % 5 - 1 AS off FROM documents),
    shifted AS (SELECT doc_id, source, d.doc_id % 9 + 1 AS a, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE d.doc_id % 9 + 1 + doc_id % 2 END AS b,
                       CASE WHEN off >= 0 THEN off ELSE 0 END AS off FROM documents d JOIN offsets USING (source)),
    printed AS (SELECT doc_id, source, CASE WHEN a - off >= 1 THEN a - off ELSE a END AS a,
                       CASE WHEN b - off >= 1 THEN b - off ELSE b END AS b FROM shifted)
    SELECT doc_id, a AS page_start, b AS page_end,
           CASE WHEN b IS NULL OR a = b THEN source || ', trang ' || a ELSE source || ', trang ' || a || '-' || b END AS citation
    FROM printed
    """
)
def printed_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    offsets = docs.select(
        F.col("source").alias("source_file"), (F.substring("source", 4, 9).cast("int") % 5 - 1).alias("offset")
    ).distinct()
    start = F.col("doc_id") % 9 + 1
    pages = docs.select(
        "doc_id", F.col("source").alias("source_file"), start.alias("page_start"),
        F.when(F.col("doc_id") % 3 > 0, start + F.col("doc_id") % 2).alias("page_end"),
    )
    return ci.with_printed_pages(pages, offsets).select(
        "doc_id", "page_start", "page_end",
        ci.citation(F.col("source_file"), F.col("page_start"), F.col("page_end")).alias("citation"),
    )


# --- Audit ---------------------------------------------------------------------------------------
# Damage is added to the end of some documents, so that every detector has work.

_DAMAGE = [
    "", " Ta có a - b = b - a; c-d = d-c.", " Ta gọi = là một phân số.", " Vậy ta có định nghĩa: Ví dụ 1.",
    " A? - B* = C?", " m0t s6tu t0an x1 v1et.", " " + "§" * 2000,
]
_ALLOWED = fv.DIGIT_IN_WORD_ALLOWED
_SQL_DAMAGED = f"(SELECT *, text || [{', '.join(map(quote, _DAMAGE))}][doc_id % {len(_DAMAGE)} + 1] AS page FROM documents)"
_SQL_AUDIT = f"""
    damaged AS (SELECT doc_id, source, page, doc_id % {len(_DAMAGE)} AS d FROM {_SQL_DAMAGED}),
    measured AS (
        SELECT *,
               list_filter(regexp_split_to_array(page, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'),
                           lambda w: regexp_full_match(w, '[a-zA-ZÀ-ỹ]{{1,6}}[0-9][a-zA-ZÀ-ỹ]{{0,6}}')
                                     AND NOT regexp_matches(w, {quote(_ALLOWED)})) AS odd,
               length(regexp_replace(page, {quote(fv.EXPECTED_CHARACTERS.replace(chr(92) + "s", chr(92) + "s" + chr(92) + "x{a0}"))}, '', 'g')) / length(page) AS unexpected,
               len(regexp_extract_all(page, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])[A-Za-z]\\s*[?*](\\s*[-+=~)\\]]|\\s*$)')) AS lost
        FROM damaged WHERE length({sql_strip('page')}) >= 120),
    flags AS (
        SELECT doc_id, unnest(
            CASE WHEN d = 1 THEN ['{fv.KIND_SWAPPED_MINUS}', '{fv.KIND_SWAPPED_MINUS}'] ELSE [] END ||
            CASE WHEN d = 2 THEN ['{fv.KIND_FRACTION}'] ELSE [] END ||
            CASE WHEN d = 3 THEN ['{fv.KIND_DEFINITION_BOX}'] ELSE [] END ||
            CASE WHEN lost >= 2 THEN ['{fv.KIND_LOST_EXPONENT}'] ELSE [] END ||
            CASE WHEN len(odd) >= 3 THEN ['{fv.KIND_DIGIT_WORD}'] ELSE [] END ||
            CASE WHEN unexpected > 0.03 THEN ['{fv.KIND_GARBLED}'] ELSE [] END) AS kind FROM measured)
"""


def _damaged(spark, sf_dir):
    endings = F.array(*map(F.lit, _DAMAGE))
    ending = F.element_at(endings, (F.col("doc_id") % len(_DAMAGE)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.col("doc_id") % 12 + 1).cast("int").alias("grade"), F.concat("text", ending).alias("text")
    )


def _audits(spark, sf_dir):
    audits = oa.audit_pages(oa.population(_damaged(spark, sf_dir)))
    return oa.mark_repaired(audits, table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query(f"WITH {_SQL_AUDIT} SELECT doc_id, string_agg(kind, ' ' ORDER BY kind) AS kinds, count(*) AS n_issues FROM flags GROUP BY doc_id")
def audit_pages(spark, sf_dir):
    flagged = _audits(spark, sf_dir).where(F.size("issues") > 0)
    return flagged.select(
        "doc_id", F.array_join(F.array_sort("issues.kind"), " ").alias("kinds"), F.size("issues").alias("n_issues")
    )


@query(f"WITH {_SQL_AUDIT} SELECT kind, count(*) AS n FROM flags GROUP BY kind")
def audit_kind_counts(spark, sf_dir):
    return oa.kind_counts(_audits(spark, sf_dir))


@query(
    f"""WITH {_SQL_AUDIT},
    page_flags AS (
        SELECT m.doc_id, regexp_matches(page, '[=²³√×÷]|(^|[^\\p{{L}}\\p{{N}}_])(phân s|công thức|định lí|tỉ số)') AS formula,
               doc_id IN (SELECT doc_id FROM flags) AS flagged,
               doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS done FROM measured m)
    SELECT count(*) AS pages, count(*) FILTER (formula) AS formula_pages, count(*) FILTER (flagged) AS flagged,
           count(*) FILTER (flagged AND done) AS repaired, count(*) FILTER (flagged AND NOT done) AS to_do FROM page_flags"""
)
def audit_totals(spark, sf_dir):
    return oa.totals(_audits(spark, sf_dir))


@query(
    f"""SELECT doc_id FROM (SELECT doc_id, sha256(doc_id || '|2026') AS draw FROM documents WHERE length({sql_strip('text')}) >= 120
        ORDER BY draw LIMIT 60)"""
)
def audit_sample(spark, sf_dir):
    """A repeatable sample of 60 pages."""
    pages = oa.population(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return oa.sample(pages.select("doc_id"), [F.col("doc_id")], 60, 2026)


@query(
    f"""WITH {_SQL_AUDIT}
    SELECT doc_id, count(*) AS n_issues, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS kinds FROM flags
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id
    HAVING bool_or(kind IN ('{fv.KIND_SWAPPED_MINUS}', '{fv.KIND_DIGIT_WORD}', '{fv.KIND_LOST_EXPONENT}'))"""
)
def repair_worklist(spark, sf_dir):
    kinds = [fv.KIND_SWAPPED_MINUS, fv.KIND_DIGIT_WORD, fv.KIND_LOST_EXPONENT]
    audits = oa.audit_pages(oa.suspects(_damaged(spark, sf_dir), kinds))
    flagged = oa.flagged_pages(audits, kinds).select("doc_id", "n_issues", "kinds")
    todo = oa.worklist(flagged, table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])
    return todo.withColumn("kinds", F.array_join("kinds", " "))


@query(
    f"""WITH {_SQL_AUDIT}
    SELECT doc_id, trim(regexp_replace(substring(page, greatest(1, spot - 45)), '\\s+', ' ', 'g')) AS snippet
    FROM (SELECT doc_id, page, position('a - b = b - a' IN page) AS spot FROM measured WHERE d = 1)"""
)
def audit_snippets(spark, sf_dir):
    """Context of the first flag of the pages with a false commutative law."""
    first = F.get("issues", F.lit(0))
    return _audits(spark, sf_dir).where(first["kind"] == fv.KIND_SWAPPED_MINUS).select(
        "doc_id", first["snippet"].alias("snippet")
    )


@query(
    f"""WITH p AS (SELECT doc_id, {sql_strip("text")} AS body FROM documents)
        SELECT d.doc_id, 800000 + d.doc_id AS chunk_index, length(body) AS length FROM p d WHERE length(body) >= 200"""
)
def accepted_rereads(spark, sf_dir):
    rereads = oa.accept_rereads(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rereads.select(
        "doc_id", (F.col("doc_id") + fv.REPAIR_INDEX_BASE).alias("chunk_index"), F.length(tx.strip(F.col("text"))).alias("length")
    )



# --- What runs leave behind ------------------------------------------------------------------


@query(
    """WITH read AS (
        SELECT source || '.pdf' AS source_file, doc_id % 40 AS page, doc_id % 3 AS run, max(doc_id) AS doc_id FROM documents GROUP BY ALL)
    SELECT source_file, page::INTEGER AS page, md5(text) AS body FROM (
        SELECT *, row_number() OVER (PARTITION BY source_file, page ORDER BY run DESC) AS n FROM read) JOIN documents USING (doc_id) WHERE n = 1"""
)
def repairs_saved(spark, sf_dir):
    """Page readings of three runs, saved one after another; the last reading of each page counts."""
    docs = table(spark, sf_dir, "documents")
    read = docs.groupBy(F.col("source").alias("s"), (F.col("doc_id") % 40).cast("int").alias("page"), (F.col("doc_id") % 3).alias("run")).agg(
        F.max_by("text", "doc_id").alias("text")
    )
    rows = read.select(
        F.lit(6).alias("grade"), F.col("s").alias("subject"), F.col("s").alias("book_title"), F.concat("s", F.lit(".pdf")).alias("source_file"),
        "page", "text", F.array().cast("array<string>").alias("kinds"), "run",
    )
    path = scratch_path(spark, "repairs")
    for run in (2, 0, 1):
        save_repairs(spark, path, rows.where(F.col("run") == run), run)
    return saved_repairs(spark, path).select("source_file", "page", F.md5("text").alias("body"))


@query(
    """WITH strips AS (
        SELECT page_id, unnest([left(html, 200), right(html, 200)]) AS strip FROM pages)
    SELECT p.page_id, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n), '') AS candidates
    FROM (SELECT DISTINCT page_id FROM pages) p LEFT JOIN (
        SELECT DISTINCT page_id, unnest(regexp_extract_all(strip, '(\\d{1,3})', 1))::INTEGER AS n FROM strips) f USING (page_id) GROUP BY p.page_id"""
)
def page_number_strips(spark, sf_dir):
    """Numbers in the upper and the lower edge of each page, together."""
    pages = table(spark, sf_dir, "pages")
    top = pages.select("page_id", F.left("html", F.lit(200)).alias("strip"))
    bottom = pages.select("page_id", F.right("html", F.lit(200)).alias("strip"))
    found = po.both_strips(top, bottom, ["page_id"], "strip")
    return found.select("page_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query(
    """WITH united AS (
        SELECT 0 AS s, item_id AS i, text, true AS in_textbook FROM benchmark WHERE trim(text) <> ''
        UNION ALL SELECT 1, conv_id * 1000 + turn, text, false FROM conversations WHERE role = 'user' AND trim(text) <> '')
    SELECT md5(text) AS body, in_textbook, count(*) AS questions, (SELECT count(*) FROM united)::INTEGER AS last_position FROM united GROUP BY text, in_textbook"""
)
def question_sets(spark, sf_dir):
    """Benchmark items and questions from conversations, written as two sets, read and united."""
    kind = F.array().cast("array<string>").alias("keywords")
    shape = [F.col("text").alias("question"), F.lit(6).alias("grade"), F.lit("en").alias("subject"), kind]
    path = scratch_path(spark, "question-sets")
    table(spark, sf_dir, "benchmark").select(*shape).write.json(f"{path}/inside")
    table(spark, sf_dir, "conversations").where("role = 'user'").select(*shape).write.json(f"{path}/outside")
    united = all_questions(
        read_question_set(spark, f"{path}/inside", True), read_question_set(spark, f"{path}/outside", False)
    )
    last = united.agg(F.max("position").alias("last_position"), F.lit(0).alias("one"))
    counted = united.groupBy("question", "in_textbook").agg(F.count("*").alias("questions")).withColumn("one", F.lit(0))
    return counted.join(last, "one").select(F.md5("question").alias("body"), "in_textbook", "questions", "last_position")


@query("SELECT lang AS book, count(*) AS pages, min(doc_id)::INTEGER AS first_page, md5(arg_max(text, doc_id)) AS last_text FROM documents WHERE text IS NOT NULL GROUP BY lang")
def page_cache(spark, sf_dir):
    """Pages loaded through the cache: two books in a first run, the others in a second."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    books = docs.select(F.lit(6).alias("grade"), F.col("lang").alias("book")).distinct()

    def extract(missing):
        return docs.select(F.lit(6).alias("grade"), F.col("lang").alias("book"), F.col("doc_id").alias("page_number"), "text").join(
            missing, ["grade", "book"], "left_semi"
        )

    path = scratch_path(spark, "page-cache")
    load_through(books.where("book IN ('de', 'fr')"), path, extract)
    pages = load_through(books, path, extract)
    return pages.groupBy("book").agg(
        F.count("*").alias("pages"), F.min("page_number").alias("first_page"), F.md5(F.max_by("text", "page_number")).alias("last_text")
    )
