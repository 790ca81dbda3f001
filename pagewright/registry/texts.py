"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import messages as ms
from pagewright.functions import text as tx
from pagewright.functions import webhook as wh
from pagewright.operators.embedding import DIMENSIONS, embed
from pagewright.operators.routing import route
from pagewright.registry.common import (
    WORD,
    query,
    quote,
    sql_collapse,
    sql_sentences,
    sql_strip,
    table,
)

SQL_CLEAN_LINES = f"""
    list_filter(
        list_transform(
            string_split(
                regexp_replace(
                    regexp_replace(
                        regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'),
                        '\\r\\n?', chr(10), 'g'),
                    '({WORD})-\\s*\\n\\s*({WORD})', '\\1\\2', 'g'),
                chr(10)),
            lambda line: {sql_strip("regexp_replace(line, '[ \\t\\x{a0}]{2,}', ' ', 'g')")}),
        lambda line: NOT regexp_matches(line, '^[-–—|]*\\s*[0-9]{{1,4}}\\s*[-–—|]*$'))"""
SQL_CLEAN = sql_strip(
    f"regexp_replace(array_to_string({SQL_CLEAN_LINES}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
)
SQL_PLAIN = "replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D')"


@query(f"SELECT doc_id, {SQL_CLEAN} AS text FROM documents")
def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query(
    """SELECT doc_id, len(list_filter(string_split(text, chr(10)),
         lambda line: regexp_matches(line, '^\\s*[-–—|]*\\s*[0-9]{1,4}\\s*[-–—|]*\\s*$'))) AS number_lines
       FROM documents"""
)
def page_number_lines(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), tx.is_page_number_line)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("number_lines"))


@query(f"SELECT doc_id, {SQL_PLAIN.format('text')} AS plain FROM documents")
def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.strip_diacritics(F.col("text")).alias("plain")
    )


@query(
    f"""SELECT doc_id, i - 1 AS position, s[i] AS sentence
        FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents), range(1, 100000) r(i)
        WHERE i <= len(s)"""
)
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("position", "sentence")
    )


@query(
    f"""
    WITH RECURSIVE lines AS (
        SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)) AS l
        FROM documents),
    fold AS (
        SELECT doc_id, l, 1 AS i, 0 AS section, l[1] AS open FROM lines
        UNION ALL
        SELECT doc_id, l, i + 1,
               CASE WHEN cut THEN section + 1 ELSE section END,
               CASE WHEN cut THEN l[i + 1] ELSE open || chr(10) || l[i + 1] END
        FROM (SELECT *, regexp_matches({sql_strip('l[i + 1]')}, '^(?:[0-9]{{1,2}}\\.\\s+\\S|[a-zđ]\\.\\s+\\S|BÀI\\s+[0-9])')
                        AND length({sql_strip('l[i + 1]')}) <= 80
                        AND length({sql_strip('open')}) >= 120 AS cut
              FROM fold WHERE i < len(l)))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1) AS section, md5(body) AS body
    FROM (SELECT doc_id, section, arg_max(open, i) AS body FROM fold GROUP BY doc_id, section)
    WHERE {sql_strip('body')} <> ''
    """
)
def sections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(tx.split_into_sections(F.col("text"))).alias("section", "__body")
    ).select("doc_id", "section", F.md5("__body").alias("body"))


@query(
    f"""SELECT doc_id, length({sql_strip('text')}) AS length, contains(text, 'MỤC LỤC') AS contents_page,
               length({sql_strip('text')}) >= 120 AS long_enough
        FROM documents"""
)
def page_filters(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length(tx.strip(text)).alias("length"),
        tx.is_contents_page(text).alias("contents_page"),
        (F.length(tx.strip(text)) >= fv.MIN_PAGE_LENGTH).alias("long_enough"),
    )


# --- Scope and search terms --------------------------------------------------------


def _sql_case(pairs, key: str) -> str:
    whens = " ".join(f"WHEN {key} = {quote(k)} THEN {quote(v)}" for k, v in pairs)
    return f"CASE {whens} END"


_RAW_SUBJECT = (
    "CASE WHEN p_partkey % 2 = 0 THEN '  ' || p_type ELSE "
    f"upper([{', '.join(map(quote, fv.SUBJECT_ALIASES))}][(p_partkey % {len(fv.SUBJECT_ALIASES)}) + 1]) || ' ' END"
)


@query(
    f"""
    WITH raw AS (SELECT p_partkey, {_RAW_SUBJECT} AS raw, p_size FROM part),
    named AS (SELECT *, {sql_collapse('raw')} AS c FROM raw)
    SELECT p_partkey,
           coalesce({_sql_case(fv.SUBJECT_ALIASES.items(), "replace(lower(" + SQL_PLAIN.format('c') + "), ' ', '')")},
                    upper(c[1:1]) || c[2:]) AS subject,
           CASE WHEN p_size BETWEEN 1 AND 12 THEN p_size END AS grade
    FROM named
    """
)
def scopes(spark, sf_dir):
    aliases = F.array(*map(F.lit, fv.SUBJECT_ALIASES))
    pick = (F.col("p_partkey") % len(fv.SUBJECT_ALIASES)).cast("int") + 1
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), "p_type")).otherwise(
        F.concat(F.upper(F.element_at(aliases, pick)), F.lit(" "))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        tx.normalize_subject(raw).alias("subject"),
        tx.validate_grade(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("grade"),
    )


def sql_keyword(expression: str) -> str:
    """SQL of the search term of a question; needs no columns but ``expression``."""
    noise = quote(tx.WHITE_SPACE + fv.EDGE_NOISE_CHARS)
    bare = f"trim(lower({expression}), {noise})"
    opened = f"regexp_replace({bare}, '^(?:{'|'.join(fv.QUESTION_PREFIXES)})', '')"
    whens = " ".join(
        f"WHEN ends_with(o, {quote(s)}) THEN o[:length(o) - {len(s)}]" for s in fv.QUESTION_SUFFIXES
    )
    closed = f"list_transform([{opened}], lambda o: CASE {whens} ELSE o END)[1]"
    phrase = f"trim({sql_collapse(closed)}, {noise})"
    return (
        f"list_transform([{phrase}], lambda p: CASE WHEN length(p) BETWEEN 4 AND 40 AND "
        f"(p <> {bare} OR len(string_split(p, ' ')) <= 6) THEN p END)[1]"
    )


_ASKED = [
    ("", "?"), ("Thế nào là ", "?"), ("", " là gì?"), ("Hãy nêu ", " có đặc điểm gì"),
]
_SQL_ASKED = (
    "CASE turn % 4 " + " ".join(
        f"WHEN {i} THEN {quote(a)} || s || {quote(b)}" for i, (a, b) in enumerate(_ASKED)
    ) + " END"
)


@query(
    f"""
    WITH s AS (SELECT conv_id, turn, unnest({sql_sentences('text')}) AS s,
                      generate_subscripts({sql_sentences('text')}, 1) - 1 AS position FROM conversations)
    SELECT conv_id, turn, position, {sql_keyword(_SQL_ASKED)} AS phrase FROM s
    """
)
def keyword_phrases(spark, sf_dir):
    asked = F.when(F.lit(False), "")
    for i, (before, after) in enumerate(_ASKED):
        asked = asked.when(F.col("turn") % 4 == i, F.concat(F.lit(before), "s", F.lit(after)))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.posexplode(tx.split_sentences(F.col("text"))).alias("position", "s")
    )
    return rows.select("conv_id", "turn", "position", tx.keyword_phrase(asked).alias("phrase"))


_NAMES = [name for group in fv.NAME_SPELLINGS for name in group]


def _sql_variants() -> str:
    branches = []
    for group in fv.NAME_SPELLINGS:
        for found in group:
            lower = [n for n in group if n != found]
            cased = [n.capitalize() for n in lower]
            listed = (
                [f"'định lí {n}'" for n in cased] + [quote(n) for n in cased]
                + [f"'định lí {n}'" for n in lower] + [quote(n) for n in lower]
            )
            branches.append(f"WHEN {quote(found)} THEN [{', '.join(listed)}]")
    return " ".join(branches)


def _first_spelling() -> dict[str, str]:
    """Which listed spelling each name is recognised as (an earlier one may be contained in it)."""
    out = {}
    for group in fv.NAME_SPELLINGS:
        for name in group:
            key = tx._plain_name_key("định lí " + name)
            out[name] = next(s for s in group if tx._plain_name_key(s) in key)
    return out


@query(
    f"""
    WITH n AS (SELECT s_suppkey, [{', '.join(map(quote, _NAMES))}][s_suppkey % {len(_NAMES)} + 1] AS name FROM supplier),
    f AS (SELECT s_suppkey, name, {_sql_case(_first_spelling().items(), 'name')} AS found FROM n),
    v AS (SELECT s_suppkey, name, found, CASE found {_sql_variants()} END AS listed FROM f),
    w AS (SELECT s_suppkey, list_transform(
              list_filter(listed, lambda x: contains(name, found) OR NOT starts_with(x, 'định lí ')),
              lambda x: CASE WHEN starts_with(x, 'định lí ') THEN 'định lí ' || replace(name, found, x[9:]) ELSE x END) AS vs FROM v)
    SELECT s_suppkey, array_to_string(list_filter(vs, lambda x, i: list_position(vs, x) = i)[:6], '|') AS variants
    FROM w
    """
)
def name_spellings(spark, sf_dir):
    names = F.array(*map(F.lit, _NAMES))
    phrase = F.concat(F.lit("định lí "), F.element_at(names, (F.col("s_suppkey") % len(_NAMES)).cast("int") + 1))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array_join(tx.name_variants(phrase), "|").alias("variants")
    )


# --- Commands and messages -------------------------------------------------------------

_COMMANDS = list(fv.COMMAND_ACTIONS) + ["xyz"]


@query(
    f"""
    WITH c AS (SELECT conv_id, turn, text, [{', '.join(map(quote, _COMMANDS))}][(conv_id + turn) % {len(_COMMANDS)} + 1] AS name FROM conversations)
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN name END AS command,
           CASE WHEN role = 'user' THEN {sql_strip('text')} END AS argument,
           CASE WHEN role = 'user' THEN coalesce({_sql_case(fv.COMMAND_ACTIONS.items(), 'name')}, 'unknown') ELSE 'question' END AS action
    FROM c JOIN conversations USING (conv_id, turn, text)
    """
)
def commands(spark, sf_dir):
    names = F.array(*map(F.lit, _COMMANDS))
    name = F.element_at(names, ((F.col("conv_id") + F.col("turn")) % len(_COMMANDS)).cast("int") + 1)
    typed = F.when(F.col("role") == "user", F.concat(F.lit(" / "), F.upper(name), F.lit("@Bot "), "text"))
    parsed = ms.parse_command(F.coalesce(typed, "text"))
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", parsed.alias("p"))
        .select("conv_id", "turn", "p.command", "p.argument", ms.command_action(F.col("p.command")).alias("action"))
    )


@query(
    f"""
    WITH c AS (SELECT event_id, user_id, event_type, event_id % 7 AS k FROM events)
    SELECT event_id, ['set_grade', 'set_subject', 'clear_history', 'report', 'rate', 'question', 'unknown'][k + 1] AS action,
           CASE k WHEN 0 THEN event_id % 15 BETWEEN 1 AND 12 WHEN 1 THEN event_type = 'view' WHEN 4 THEN event_id % 8 BETWEEN 1 AND 5
                  WHEN 6 THEN false ELSE true END AS valid,
           CASE WHEN k = 0 AND event_id % 15 BETWEEN 1 AND 12 THEN event_id % 15 END AS grade,
           CASE WHEN k = 1 AND event_type = 'view' THEN 'Ngữ văn' END AS subject,
           k = 2 AS clear, CASE WHEN k = 5 THEN event_type || '?' END AS question,
           CASE k WHEN 3 THEN event_id WHEN 4 THEN user_id END AS about
    FROM c
    """
)
def message_routes(spark, sf_dir):
    """Every event as a typed message, routed to its action."""
    kind, number = F.col("event_id") % 7, F.col("event_id").cast("string")
    typed = (
        F.when(kind == 0, F.concat(F.lit("/lop "), (F.col("event_id") % 15).cast("string")))
        .when(kind == 1, F.concat(F.lit("/MON "), F.when(F.col("event_type") == "view", "ngữ  văn").otherwise(F.col("event_type"))))
        .when(kind == 2, "/xoa")
        .when(kind == 3, F.concat(F.lit("/ baosai@Bot #"), number, F.lit(" sai")))
        .when(kind == 4, F.concat(F.lit("/chamdiem "), (F.col("event_id") % 8).cast("string")))
        .when(kind == 5, F.concat(F.lit(" "), F.col("event_type"), F.lit("? ")))
        .otherwise("/nothing")
    )
    messages = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("last_answer_id"), typed.alias("text"))
    return route(messages).select(
        "event_id", "action", "valid", "grade", "subject", "clear", "question",
        F.coalesce("report.answer_id", "rating.answer_id").alias("about"),
    )


@query(
    """
    SELECT event_id,
           CASE WHEN event_id % 3 = 0 THEN event_id ELSE user_id END AS answer_id,
           CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN 3 ELSE 5 END AS clarity,
           CASE WHEN event_id % 4 >= 2 THEN 4 END AS guidance,
           CASE WHEN event_id % 4 = 3 THEN '2 ' ELSE '' END || event_type AS comment,
           CASE WHEN event_id % 3 = 2 THEN user_id ELSE event_id END AS reported_id,
           CASE WHEN event_id % 5 > 0 THEN event_type END AS note
    FROM events
    """
)
def feedback_arguments(spark, sf_dir):
    part = F.col("event_id") % 4
    scores = F.when(part == 0, "").when(part == 1, "5 ").when(part == 2, "5 4 ").otherwise("3 4 2 ")
    mark = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("#"), "event_id", F.lit("  "))).otherwise("")
    rating = ms.parse_rating(F.concat(mark, scores, "event_type"), F.col("user_id"))
    named = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("#"), "event_id")).when(
        F.col("event_id") % 3 == 1, F.col("event_id").cast("string")
    ).otherwise("")
    note = F.when(F.col("event_id") % 5 > 0, F.col("event_type")).otherwise("")
    report = ms.parse_report(F.concat_ws(" ", named, note), F.col("user_id"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", rating.alias("r"), report.alias("p"))
        .select("event_id", "r.answer_id", "r.clarity", "r.guidance", "r.comment",
                F.col("p.answer_id").alias("reported_id"), "p.note")
    )


def _sql_split(limit: int) -> str:
    ws = quote(tx.WHITE_SPACE)
    head = f"rest[:{limit}]"

    def last(ch: str) -> str:
        # 0-based position of the last such character in the head; -1 without one, 0 if only at the start.
        return f"(CASE WHEN contains({head}, {ch}) THEN {limit} - position({ch} IN reverse({head})) ELSE -1 END)"

    at = f"(CASE WHEN {last('chr(10)')} > 0 THEN {last('chr(10)')} WHEN {last(quote(' '))} > 0 THEN {last(quote(' '))} ELSE {limit} END)"
    return f"""
    WITH RECURSIVE cut AS (
        SELECT doc_id, 0 AS piece, text AS rest, NULL::VARCHAR AS part, length(text) <= {limit} AS last FROM documents
        UNION ALL
        SELECT doc_id, piece + 1,
               CASE WHEN length(rest) > {limit} THEN ltrim(rest[{at} + 1:], {ws}) ELSE NULL END,
               CASE WHEN length(rest) > {limit} THEN rtrim(rest[:{at}], {ws}) ELSE rest END,
               false
        FROM cut WHERE rest IS NOT NULL AND (piece = 0 OR rest <> ''))
    SELECT doc_id, piece - 1 AS piece, md5(part) AS body, length(part) AS length FROM cut WHERE piece > 0
    """


@query(_sql_split(fv.DISCORD_MESSAGE_LIMIT))
def message_pieces(spark, sf_dir):
    pieces = ms.split_message(F.col("text"), fv.DISCORD_MESSAGE_LIMIT)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(pieces).alias("piece", "part"))
        .select("doc_id", "piece", F.md5("part").alias("body"), F.length("part").alias("length"))
    )


@query(_sql_split(fv.TELEGRAM_MESSAGE_LIMIT))
def long_message_pieces(spark, sf_dir):
    pieces = ms.split_message(F.col("text"), fv.TELEGRAM_MESSAGE_LIMIT)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(pieces).alias("piece", "part"))
        .select("doc_id", "piece", F.md5("part").alias("body"), F.length("part").alias("length"))
    )


_SECRET = "oa-secret"


def _blob(data: bytes) -> str:
    return "unhex('" + data.hex() + "')"


@query(
    f"""SELECT conv_id, turn,
          sha256({_blob(bytes(b ^ 0x5C for b in _SECRET.encode().ljust(64, bytes(1))))} ||
                 unhex(sha256({_blob(bytes(b ^ 0x36 for b in _SECRET.encode().ljust(64, bytes(1))))} || encode(text)))) AS signature
        FROM conversations"""
)
def body_signatures(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", wh.hmac_sha256(F.col("text"), _SECRET).alias("signature")
    )


@query(
    """SELECT conv_id, turn, 'u' || conv_id AS user_id, text FROM conversations
       WHERE role = 'user' AND turn % 3 <> 2 AND text <> ''"""
)
def webhook_messages(spark, sf_dir):
    """Deliveries signed with the right secret that carry a text message."""
    event = F.to_json(
        F.struct(
            F.when(F.col("role") == "user", fv.TEXT_MESSAGE_EVENT).otherwise("user_seen").alias("event_name"),
            F.struct(F.concat(F.lit("u"), "conv_id").alias("id")).alias("sender"),
            F.struct(F.col("text"), F.col("turn").alias("msg_id")).alias("message"),
        )
    )
    secret = F.when(F.col("turn") % 3 == 2, wh.hmac_sha256(F.col("body"), "other")).otherwise(
        wh.hmac_sha256(F.col("body"), _SECRET)
    )
    delivered = table(spark, sf_dir, "conversations").select("conv_id", "turn", event.alias("body")).withColumn("signature", secret)
    return (
        delivered.where(wh.signature_ok(F.col("body"), F.col("signature"), _SECRET))
        .withColumn("event", wh.parse_event(F.col("body")))
        .where(wh.is_text_message(F.col("event")))
        .select("conv_id", "turn", F.col("event.sender.id").alias("user_id"), F.col("event.message.text").alias("text"))
    )


@query(
    """SELECT doc_id, '6' AS grade, source || ':x' AS book, n_chars AS page, source || ':x' <> '' AS ok FROM documents
       UNION ALL SELECT doc_id, NULL, '', NULL, false FROM documents"""
)
def page_specs(spark, sf_dir):
    raw = F.concat(F.lit(" 6/"), "source", F.lit(":x:"), "n_chars", F.lit(", bad/"), "lang", F.lit(" ,,"))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.inline(tx.parse_page_specs(raw)))
        .select("doc_id", F.col("grade").cast("string").alias("grade"), "book", F.col("page").cast("bigint").alias("page"), "ok")
    )


@query(
    r"""SELECT doc_id, 'x ' || (CASE WHEN doc_id % 2 = 0 THEN 'a/b' ELSE 'n' END) || ' = ' || lang AS shown FROM documents"""
)
def latex_free(spark, sf_dir):
    maths = F.when(F.col("doc_id") % 2 == 0, r"\frac{a} {b}").otherwise(r"\cdot n")
    raw = F.concat(F.lit("$x$ **"), maths, F.lit("** = {"), "lang", F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_stray_latex(raw).alias("shown"))


SQL_EMBED = f"""
    WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '')) AS word FROM documents),
    u AS (SELECT DISTINCT word FROM w),
    h AS (SELECT word, ('0x' || md5(word)[1:4])::INT % {DIMENSIONS} AS slot FROM u),
    c AS (SELECT doc_id, slot, count(*)::DOUBLE AS n FROM w JOIN h USING (word) GROUP BY doc_id, slot),
    n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id),
    v AS (SELECT doc_id, list((coalesce(n, 0) / norm)::FLOAT ORDER BY s) AS embedding
          FROM (SELECT doc_id, norm, s FROM n, range(0, {DIMENSIONS}) r(s)) g LEFT JOIN c ON c.doc_id = g.doc_id AND c.slot = g.s
          GROUP BY g.doc_id)
"""
SQL_EMBED = SQL_EMBED.replace("SELECT doc_id, list((", "SELECT g.doc_id, list((").replace("c.slot = g.s\n", "c.slot = g.s\n")


@query(
    SQL_EMBED
    + f"SELECT doc_id, s AS slot, round(embedding[s + 1]::DOUBLE, 6) AS weight FROM v, range(0, {DIMENSIONS}) r(s) WHERE embedding[s + 1] > 0"
)
def text_vectors(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(embed(F.col("text"))).alias("slot", "w"))
        .where(F.col("w") > 0)
        .select("doc_id", "slot", F.round(F.col("w").cast("double"), 6).alias("weight"))
    )
