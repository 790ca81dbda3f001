"""Queries over retrieval.

Vectors: benchmark item i asks with vector i, and a chunk's subject is its
label.  Texts: every sentence of the benchmark items is a question over the
documents, whose subject is their language; both sides use the hashing embedder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import answers as an
from pagewright.functions import text as tx
from pagewright.operators import literal_index as li
from pagewright.operators import retrieval as rt
from pagewright.operators.embedding import embed
from pagewright.operators.generation import OfflineClient, ServiceError
from pagewright.plans import tutoring as tu
from pagewright.plans.answering import answer_questions, run_benchmark
from pagewright.registry import feedback as fq
from pagewright.registry.common import query, quote, sql_sentences, sql_strip, table
from pagewright.registry.texts import SQL_EMBED, sql_keyword

_TOP = 10


def _vector_chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").cast("string").alias("subject"),
        (F.col("vec_id") % 12 + 1).cast("int").alias("grade"),
        F.col("vec_id").cast("string").alias("passage"),
        F.lit(None).cast("string").alias("text"),
        "embedding",
    )


def _vector_questions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return table(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").cast("string").alias("qid"),
        F.col("text").alias("question"),
        (F.col("item_id") % 12 + 1).cast("int").alias("grade"),
        F.col("label").cast("string").alias("subject"),
        "embedding",
    )


#: Distance of two float vectors, worked out in double precision.
_COSINE = "(round(1 - list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 8) + 0::DOUBLE)"

_SQL_VECTOR = f"""
    asked AS (SELECT item_id, item_id % 12 + 1 AS g, label, embedding FROM benchmark JOIN embeddings ON item_id = vec_id),
    pairs AS (
        SELECT a.item_id, a.g, e.vec_id, e.vec_id % 12 + 1 AS cg, {_COSINE.format('a.embedding', 'e.embedding')} AS d
        FROM asked a JOIN embeddings e ON e.label = a.label AND e.vec_id % 12 + 1 <= a.g),
    near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d, vec_id) AS near_rank FROM pairs),
    adjusted AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(d + 0.02 * greatest(0, g - cg), 8), near_rank) AS rank
        FROM near WHERE near_rank <= 30)
"""


@query(f"WITH {_SQL_VECTOR} SELECT item_id::VARCHAR AS qid, vec_id AS chunk_id, near_rank, d AS distance FROM near WHERE near_rank <= {_TOP}")
def knn_scoped(spark, sf_dir):
    """The ten nearest chunks in scope of every question."""
    asked = rt.prepare_questions(_vector_questions(spark, sf_dir), literal=False)
    hits = rt.nearest_per_pass(_vector_chunks(spark, sf_dir), asked, _TOP)
    return hits.select("qid", "chunk_id", "near_rank", "distance")


@query(
    f"""WITH {_SQL_VECTOR}
    SELECT item_id::VARCHAR AS qid, rank, vec_id AS chunk_id, d AS distance FROM adjusted WHERE rank <= {_TOP} AND d <= 1.1"""
)
def knn_grade_rerank(spark, sf_dir):
    """Nearest chunks, own grade preferred, distance reported as measured, cutoff last."""
    hits = rt.retrieve(_vector_questions(spark, sf_dir), _vector_chunks(spark, sf_dir), _TOP, literal=False)
    return hits.select("qid", "rank", "chunk_id", "distance")


@query(
    f"""WITH {_SQL_VECTOR.replace('near_rank <= 30', 'near_rank <= 60')}
    SELECT item_id::VARCHAR AS qid, count(*) AS kept, max(d) AS farthest FROM adjusted WHERE rank <= 20 AND d <= 0.95 GROUP BY item_id"""
)
def distance_cutoff(spark, sf_dir):
    """How many of twenty passages a strict cutoff leaves."""
    hits = rt.retrieve(_vector_questions(spark, sf_dir), _vector_chunks(spark, sf_dir), 20, 0.95, literal=False)
    return hits.groupBy("qid").agg(F.count("*").alias("kept"), F.max("distance").alias("farthest"))


@query("SELECT DISTINCT g AS grade, label::VARCHAR AS subject FROM range(1, 13) r(g), embeddings WHERE vec_id % 12 + 1 <= g")
def list_subjects(spark, sf_dir):
    """Subjects a student of each grade may ask about."""
    chunks = _vector_chunks(spark, sf_dir)
    return rt.list_subjects(chunks, chunks.select("grade").distinct())


@query(
    f"""WITH asked AS (SELECT item_id, item_id % 12 + 1 AS g, embedding FROM benchmark JOIN embeddings ON item_id = vec_id),
    pairs AS (
        SELECT a.item_id, a.g, e.label::VARCHAR AS subject, e.vec_id, e.vec_id % 12 + 1 AS cg, {_COSINE.format('a.embedding', 'e.embedding')} AS d
        FROM asked a JOIN embeddings e ON e.vec_id % 12 + 1 <= a.g),
    near AS (SELECT *, row_number() OVER (PARTITION BY item_id, subject ORDER BY d, vec_id) AS near_rank FROM pairs),
    adjusted AS (
        SELECT *, row_number() OVER (PARTITION BY item_id, subject ORDER BY round(d + 0.02 * greatest(0, g - cg), 8), near_rank) AS rank
        FROM near WHERE near_rank <= 30),
    kept AS (SELECT *, row_number() OVER (PARTITION BY item_id, subject ORDER BY rank) AS place FROM adjusted WHERE rank <= {_TOP} AND d <= 1.1)
    SELECT item_id::VARCHAR AS asked, arg_min(subject, (d, subject)) AS subject, min(d) AS distance
    FROM kept WHERE place = 1 GROUP BY item_id"""
)
def best_subject_by_vector(spark, sf_dir):
    """Subject of each question found by asking in every subject its grade may see."""
    chunks = _vector_chunks(spark, sf_dir)
    scoped = rt.scope_to_every_subject(_vector_questions(spark, sf_dir), chunks)
    best = rt.best_subject(scoped, rt.retrieve(scoped, chunks, _TOP, literal=False))
    return best


# --- Texts -----------------------------------------------------------------------------------


def _text_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("lang").alias("subject"),
        (F.col("doc_id") % 12 + 1).cast("int").alias("grade"),
        rt.passage_key(F.col("source"), F.col("doc_id"), F.col("text")).alias("passage"),
        "text",
        embed(F.col("text")).alias("embedding"),
        F.col("source").alias("book_title"),
        F.col("source").alias("source_file"),
        # Page numbers have three digits at most, as in a book.
        (F.col("doc_id") % 500 + 2).cast("int").alias("page_start"),
        (F.col("doc_id") % 500 + 2 + F.col("doc_id") % 2).cast("int").alias("page_end"),
    )


def _text_questions(spark, sf_dir):
    """Every sentence of the benchmark items, asked by a student of some grade."""
    asked = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("position", "question")
    )
    return asked.select(
        F.concat_ws("-", F.col("item_id").cast("string"), F.col("position").cast("string")).alias("qid"),
        "question",
        ((F.col("item_id") + F.col("position")) % 12 + 1).cast("int").alias("grade"),
        embed(F.col("question")).alias("embedding"),
    )


_SQL_QUESTION_VECTORS = (
    SQL_EMBED.replace("    WITH w AS", "    qw AS")
    .replace("FROM documents),", "FROM questions),")
    .replace("doc_id", "qid")
)
for _name in ("u", "h", "c", "n", "v"):
    _SQL_QUESTION_VECTORS = _SQL_QUESTION_VECTORS.replace(f"    {_name} AS (", f"    q{_name} AS (")
_SQL_QUESTION_VECTORS = (
    _SQL_QUESTION_VECTORS.replace("FROM w)", "FROM qw)").replace("FROM u)", "FROM qu)")
    .replace("FROM w JOIN h", "FROM qw JOIN qh").replace("FROM c GROUP", "FROM qc GROUP")
    .replace("FROM n, range", "FROM qn, range").replace("LEFT JOIN c ON", "LEFT JOIN qc c ON")
    .replace("list_filter(regexp_split_to_array(lower(text)", "list_filter(regexp_split_to_array(lower(question)")
)

_SQL_HYBRID = f"""
{SQL_EMBED.rstrip()},
    questions AS (
        SELECT item_id || '-' || (i - 1) AS qid, s[i] AS question, (item_id + i - 1) % 12 + 1 AS g
        FROM (SELECT item_id, {sql_sentences('text')} AS s FROM benchmark), range(1, 1000) r(i) WHERE i <= len(s)),
{_SQL_QUESTION_VECTORS.rstrip()},
    phrased AS (SELECT qid, question, g, {sql_keyword('question')} AS phrase FROM questions),
    scoped AS (
        SELECT q.qid, q.g, l.lang, phrase, qv.embedding AS vec,
               CASE WHEN len(string_split(phrase, ' ')) >= 3 THEN array_to_string(string_split(phrase, ' ')[-2:], ' ') END AS shorter
        FROM phrased q JOIN qv USING (qid) JOIN (SELECT lang, min(doc_id % 12 + 1) AS low FROM documents GROUP BY lang) l ON l.low <= q.g),
    pairs AS (
        SELECT s.qid, s.lang, s.g, d.doc_id, d.doc_id % 12 + 1 AS cg, {_COSINE.format('s.vec', 'v.embedding')} AS d,
               contains(d.text, phrase || ' là') AS has_definition, contains(d.text, phrase) AS has_phrase, contains(d.text, shorter) AS has_shorter
        FROM scoped s JOIN documents d ON d.lang = s.lang AND d.doc_id % 12 + 1 <= s.g JOIN v ON v.doc_id = d.doc_id),
    passes AS (
        SELECT *, 0 AS tier, 0 AS slot FROM pairs WHERE has_definition UNION ALL
        SELECT *, 0, 1 FROM pairs WHERE has_phrase UNION ALL
        SELECT *, 7, 1 FROM pairs WHERE has_shorter UNION ALL
        SELECT *, -1, 2 FROM pairs),
    near AS (SELECT *, row_number() OVER (PARTITION BY qid, lang, tier, slot ORDER BY d, doc_id) AS near_rank FROM passes),
    adjusted AS (
        SELECT *, row_number() OVER (PARTITION BY qid, lang, tier, slot ORDER BY round(d + 0.02 * greatest(0, g - cg), 8), near_rank) AS pass_rank
        FROM near WHERE near_rank <= 30),
    tiered AS (SELECT *, min(CASE WHEN slot < 2 THEN tier END) OVER (PARTITION BY qid, lang) AS first FROM adjusted WHERE pass_rank <= 10),
    once AS (SELECT *, row_number() OVER (PARTITION BY qid, lang, doc_id ORDER BY slot, pass_rank) AS seen FROM tiered WHERE slot = 2 OR tier = first),
    merged AS (SELECT *, row_number() OVER (PARTITION BY qid, lang ORDER BY slot, pass_rank) AS rank FROM once WHERE seen = 1)
"""


@query(
    f"{_SQL_HYBRID} SELECT qid || '|' || lang AS qid, rank, doc_id AS chunk_id, tier, slot, d AS distance FROM merged WHERE rank <= 10 AND d <= 1.1"
)
def hybrid_retrieval(spark, sf_dir):
    """Definitions, literal hits and nearest passages of every question in every subject it may ask about."""
    chunks = _text_chunks(spark, sf_dir)
    scoped = rt.scope_to_every_subject(_text_questions(spark, sf_dir), chunks)
    hits = rt.retrieve(scoped, chunks, _TOP)
    return hits.select("qid", "rank", "chunk_id", "tier", "slot", "distance")


@query(
    f"""{_SQL_HYBRID},
    tops AS (SELECT qid, lang, d, row_number() OVER (PARTITION BY qid, lang ORDER BY rank) AS place FROM merged WHERE rank <= 10 AND d <= 1.1)
    SELECT qid AS asked, arg_min(lang, (d, lang)) AS subject, min(d) AS distance FROM tops WHERE place = 1 GROUP BY qid"""
)
def best_subject(spark, sf_dir):
    """Subject of every question by its nearest first hit, literal hits included."""
    chunks = _text_chunks(spark, sf_dir)
    scoped = rt.scope_to_every_subject(_text_questions(spark, sf_dir), chunks)
    best = rt.best_subject(scoped, rt.retrieve(scoped, chunks, _TOP))
    return best


@query(
    f"""{_SQL_HYBRID}
    SELECT qid || '|' || lang AS qid, slot, count(*) AS hits, min(doc_id) AS lowest_id FROM tiered WHERE slot < 2 AND tier = first GROUP BY ALL"""
)
def literal_passes(spark, sf_dir):
    """What the literal passes of the first answering tier found."""
    chunks = _text_chunks(spark, sf_dir)
    scoped = rt.prepare_questions(rt.scope_to_every_subject(_text_questions(spark, sf_dir), chunks))
    ranked = rt.prefer_own_grade(rt.nearest_per_pass(chunks, scoped, _TOP * 3), _TOP)
    literal = rt.first_answering_tier(ranked).where(F.col("slot") < rt.SLOT_VECTOR)
    return literal.groupBy("qid", "slot").agg(F.count("*").alias("hits"), F.min("chunk_id").alias("lowest_id"))


_SQL_CITATION = (
    "source || ', trang ' || (doc_id % 500 + 1) || CASE WHEN doc_id % 2 = 1 THEN '-' || (doc_id % 500 + 2) ELSE '' END"
)


def _answered(spark, sf_dir):
    chunks = _text_chunks(spark, sf_dir)
    questions = _text_questions(spark, sf_dir).withColumn("subject", F.lit("en"))
    offsets = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file")).distinct().withColumn("offset", F.lit(1))
    return answer_questions(questions, chunks, offsets)


@query(
    f"""{_SQL_HYBRID},
    hits AS (SELECT qid, rank, doc_id FROM merged WHERE lang = 'en' AND rank <= 10 AND d <= 1.1),
    placed AS (
        SELECT qid, rank, {_SQL_CITATION} AS citation
        FROM hits JOIN documents USING (doc_id)),
    tops AS (SELECT qid, count(*) AS passages, arg_min(citation, rank) AS top FROM placed GROUP BY qid)
    SELECT q.qid, coalesce(passages, 0) AS passages, top AS first_source FROM questions q LEFT JOIN tops USING (qid)"""
)
def question_contexts(spark, sf_dir):
    """Passages found per question and the printed-page citation of the first."""
    return _answered(spark, sf_dir).select(
        "qid", F.size("passages").alias("passages"), F.get("passages", F.lit(0))["citation"].alias("first_source")
    )


_REMINDER = (
    "📖 Bạn mở sách  để kiểm tra lại nhé.\nNếu thấy mình trả lời chưa đúng, bạn bấm nút “🚩 Báo sai” "
    "(hoặc gõ /baosai) để mình ghi lại nha!"
)


@query(
    f"""{_SQL_HYBRID},
    hits AS (SELECT qid, rank, doc_id FROM merged WHERE lang = 'en' AND rank <= 10 AND d <= 1.1),
    tops AS (
        SELECT qid, {_SQL_CITATION} AS cited,
               {sql_strip("string_split(string_split(text, chr(10) || chr(10))[1], '. ')[1]")} AS sentence
        FROM (SELECT qid, arg_min(doc_id, rank) AS doc_id FROM hits GROUP BY qid) JOIN documents USING (doc_id)),
    answered AS (
        SELECT q.qid, coalesce('Theo sách ' || cited || ': ' || sentence, {quote(fv.NO_CONTEXT_ANSWER)}) AS answer, coalesce(cited, '') AS cited,
               cited IS NOT NULL AS found FROM questions q LEFT JOIN tops USING (qid))
    SELECT qid, answer, found AS grounded, cited,
           length(answer) + CASE WHEN found THEN 2 + {len(_REMINDER)} + length(cited) ELSE 0 END AS message_length, found AS names_a_page FROM answered"""
)
def answer_all_questions(spark, sf_dir):
    """Every question answered by the offline service, polished, cited and ready to send."""
    answered = _answered(spark, sf_dir)
    return answered.select(
        "qid", "answer", "grounded", F.array_join("citations", "; ").alias("cited"), F.length("message").alias("message_length"),
        an.names_a_page(F.col("answer")).alias("names_a_page"),
    )


#: What is looked for in the documents: a sentence's first words, those without their first and last letter, a word, and its middle.
_SQL_LOOKED_FOR = f"""
    sentences AS (SELECT item_id, unnest({sql_sentences('text')}) AS s FROM benchmark),
    heads AS (SELECT item_id, array_to_string(string_split(s, ' ')[1:3], ' ') AS head, string_split(s, ' ')[2] AS word FROM sentences),
    looked AS (
        SELECT DISTINCT unnest([head, head[2:-2], word, word[2:-2]]) AS pattern FROM heads),
    wanted AS (SELECT l.lang, pattern FROM (SELECT DISTINCT lang FROM documents) l, looked WHERE pattern <> '' AND trim(pattern) = pattern)
"""


@query(
    f"""WITH {_SQL_LOOKED_FOR}
    SELECT lang AS subject, pattern, count(*) AS chunks, min(doc_id) AS lowest_id
    FROM wanted JOIN documents USING (lang) WHERE contains(text, pattern) GROUP BY ALL"""
)
def literal_index(spark, sf_dir):
    """Phrases and parts of words found in the documents by the index of word positions."""
    head = F.array_join(F.slice("words", 1, 3), " ")
    word = F.get("words", F.lit(1))
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    sentences = table(spark, sf_dir, "benchmark").select(F.explode(tx.split_sentences(F.col("text"))).alias("s"))
    looked = (
        sentences.withColumn("words", F.split("s", " "))
        .select(F.explode(F.array(head, inner(head), word, inner(word))).alias("pattern"))
        .where("pattern <> '' AND trim(pattern) = pattern")
        .distinct()
    )
    docs = table(spark, sf_dir, "documents")
    langs = F.collect_set("lang").alias("langs")
    subjects = docs.agg(langs, F.lit(0).alias("one"))  # one row
    wanted = looked.withColumn("one", F.lit(0)).join(subjects, "one").select("pattern", F.explode("langs").alias("subject"))
    wanted = wanted.withColumn("pattern_id", F.concat_ws("|", "subject", "pattern"))
    index = li.build_index(docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("subject"), "text"))
    found = li.containing(index, wanted).groupBy("pattern_id").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("lowest_id"))
    return found.join(wanted, "pattern_id").select("subject", "pattern", "chunks", "lowest_id")


class _Unsteady(OfflineClient):
    """Fails on half of the questions, by their hash."""

    def complete(self, model, messages, settings):
        question = messages[-1]["content"].rsplit("CÂU HỎI:\n", 1)[1]
        if hashlib.md5(question.encode()).hexdigest() < "8":
            raise ServiceError("busy")
        return super().complete(model, messages, settings)


@query(
    f"""{_SQL_HYBRID},
    hits AS (SELECT qid, rank, doc_id FROM merged WHERE lang = 'en' AND rank <= 10 AND d <= 1.1),
    tops AS (
        SELECT qid, {_SQL_CITATION} AS cited,
               {sql_strip("string_split(string_split(text, chr(10) || chr(10))[1], '. ')[1]")} AS sentence
        FROM (SELECT qid, arg_min(doc_id, rank) AS doc_id FROM hits GROUP BY qid) JOIN documents USING (doc_id)),
    answered AS (
        SELECT q.qid, length(question) % 3 > 0 AS inside, cited IS NOT NULL AS found, md5(question) < '8' AS unsteady,
               coalesce('Theo sách ' || cited || ': ' || sentence, {quote(fv.NO_CONTEXT_ANSWER)}) AS answer FROM questions q LEFT JOIN tops USING (qid))
    SELECT qid, CASE WHEN found AND unsteady THEN 2 ELSE 1 END AS attempt, md5(answer) AS body,
           CASE WHEN inside AND found THEN {quote(fv.VERDICT_PASS)} WHEN inside THEN {quote(fv.VERDICT_WRONG_REFUSAL)}
                WHEN found THEN {quote(fv.VERDICT_HALLUCINATION)} ELSE {quote(fv.VERDICT_REFUSED_RIGHTLY)} END AS verdict FROM answered"""
)
def benchmark_retry(spark, sf_dir):
    """Every question scored, those the service failed on after a second ask."""
    none = F.array().cast("array<string>")
    questions = _text_questions(spark, sf_dir).withColumns(
        {"subject": F.lit("en"), "keywords": none, "in_textbook": F.length("question") % 3 > 0}
    )
    offsets = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file")).distinct().withColumn("offset", F.lit(1))
    outcomes, _ = run_benchmark(
        questions, _text_chunks(spark, sf_dir), offsets, make_client=_Unsteady, ask_again=OfflineClient
    )
    return outcomes.select("qid", "attempt", F.md5("answer").alias("body"), "verdict")


# --- Conversations ---------------------------------------------------------------------------

#: The subject a student asks about in each language's documents, as typed and as known.
_SUBJECTS = {"de": ("toan", "Toán"), "en": ("ngu van", "Ngữ văn"), "es": ("lich su", "Lịch sử"), "fr": ("vat li", "Vật lí")}
_TYPED = ["/baosai sai rồi", "/chamdiem 5 4", "/toi", "/xoa", "/abc"]


def _sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


_SQL_REMINDER = f"replace({quote(_REMINDER)}, 'Bạn mở sách  để', 'Bạn mở sách ' || cited || ' để')"


@query(
    f"""{_SQL_HYBRID},
    {fq.SQL_TABLES.strip()},
    turns AS (
        SELECT qid, question, g, split_part(qid, '-', 1)::BIGINT AS item, split_part(qid, '-', 2)::BIGINT AS pos,
               {_sql_list(_SUBJECTS)}[pos % 4 + 1] AS lang, {_sql_list(n for _, n in _SUBJECTS.values())}[pos % 4 + 1] AS subject
        FROM questions),
    placed AS (
        SELECT *, lag(subject) OVER (PARTITION BY item ORDER BY pos) AS before, lag(g) OVER (PARTITION BY item ORDER BY pos) AS g_before,
               (item * 1000 + pos) * 4 AS arrival, row_number() OVER (ORDER BY item, pos) + (SELECT max(answer_id) FROM answers) AS answer_id
        FROM turns),
    tops AS (
        SELECT qid, {_SQL_CITATION} AS cited,
               {sql_strip("string_split(string_split(text, chr(10) || chr(10))[1], '. ')[1]")} AS sentence
        FROM (SELECT t.qid, arg_min(doc_id, rank) AS doc_id FROM placed t JOIN merged m ON m.qid = t.qid AND m.lang = t.lang
              WHERE rank <= 10 AND d <= 1.1 GROUP BY t.qid) JOIN documents USING (doc_id)),
    answered AS (
        SELECT p.*, coalesce(cited, '') AS cited,
               coalesce('Theo sách ' || cited || ': ' || sentence || chr(10) || chr(10) || {_SQL_REMINDER}, {quote(fv.NO_CONTEXT_ANSWER)}) AS message
        FROM placed p LEFT JOIN tops USING (qid)),
    replies AS (
        SELECT item, arrival, 'set_grade' AS action, g AS grade, coalesce(before, CASE WHEN item % 2 = 0 THEN 'Toán' END) AS subject, NULL AS answer_id,
               'Đã chọn lớp ' || g || coalesce(', môn ' || coalesce(before, CASE WHEN item % 2 = 0 THEN 'Toán' END), '') || '.' AS reply FROM answered
        UNION ALL SELECT item, arrival + 1, 'set_subject', g, subject, NULL, 'Đã chọn lớp ' || g || ', môn ' || subject || '.' FROM answered
        UNION ALL SELECT item, arrival + 2, 'question', g, subject, answer_id, message FROM answered
        UNION ALL SELECT item, arrival + 3, {_sql_list(['report', 'rate', 'show_scope', 'clear_history', 'unknown'])}[pos % 5 + 1], g, subject, NULL,
               CASE pos % 5
                   WHEN 0 THEN 'Cảm ơn bạn đã báo! Lý do của bạn đã được ghi lại. '
                       || CASE WHEN cited = '' THEN 'Bạn thử hỏi lại bằng từ ngữ trong sách nhé.' ELSE 'Bạn mở sách ' || cited || ' đối chiếu nhé.' END
                   WHEN 1 THEN {quote(tu.RATING_THANKS)}
                   WHEN 2 THEN 'Bạn đang học lớp ' || g || ', môn ' || subject || '.'
                   WHEN 3 THEN {quote(tu.CLEARED)}
                   ELSE 'Mình chưa hiểu lệnh /abc. Bạn xem các lệnh bằng /trogiup nhé!' END FROM answered)
    SELECT item::VARCHAR AS user_id, arrival, action, grade::INTEGER AS grade, subject, answer_id::BIGINT AS answer_id, md5(reply) AS reply FROM replies"""
)
def tutor_turns(spark, sf_dir):
    """Every benchmark item is a student who, for each sentence, chooses grade and subject, asks it, and then reports, rates or commands."""
    questions = _text_questions(spark, sf_dir)
    place = F.split("qid", "-")
    item, position = place[0].cast("bigint"), place[1].cast("bigint")
    choice = (position % 4 + 1).cast("int")
    named = F.concat(F.lit("/mon "), F.element_at(F.array(*[F.lit(t) for t, _ in _SUBJECTS.values()]), choice))
    last = F.element_at(F.array(*map(F.lit, _TYPED)), (position % 5 + 1).cast("int"))
    typed = F.array(F.concat(F.lit("/lop "), F.col("grade").cast("string")), named, F.col("question"), last)
    messages = questions.select(
        F.lit("chat").alias("channel"), item.cast("string").alias("user_id"),
        ((item * 1000 + position) * 4).alias("first"), F.posexplode(typed).alias("n", "text"),
    ).select("channel", "user_id", (F.col("first") + F.col("n")).alias("arrival"), "text")
    even = table(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").cast("string").alias("user_id"))
    sessions = even.distinct().select(
        F.lit("chat").alias("channel"), "user_id", F.lit(13).alias("grade"), F.lit("Toán").alias("subject"),
        F.lit(None).cast("bigint").alias("last_answer_id"),
    )
    known = F.create_map(*[F.lit(x) for lang, (_, name) in _SUBJECTS.items() for x in (lang, name)])
    chunks = _text_chunks(spark, sf_dir).withColumn("subject", F.try_element_at(known, F.col("subject")))
    offsets = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file")).distinct().withColumn("offset", F.lit(1))
    log = fq.answer_log(spark, sf_dir)
    turns = tu.tutor_turns(messages, sessions, log, chunks, offsets)
    return turns.select("user_id", "arrival", "action", "grade", "subject", "answer_id", F.md5("reply").alias("reply"))
