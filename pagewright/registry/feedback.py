"""Queries over the feedback tables, read out of ``events``.

A view is an answer, an error a report and a purchase a rating.  A report or
rating refers to the last answer its user was given before it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import messages as ms
from pagewright.operators import feedback as fb
from pagewright.operators import sessions as ss
from pagewright.registry.common import query, table
from pagewright.sources.tables import feedback_sheet

SQL_TABLES = """
    referred AS (
        SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
                      OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS about
        FROM events),
    answers AS (
        SELECT event_id AS answer_id, ts AS created_at, 'u' || user_id AS user_id,
               CASE WHEN event_id % 3 = 0 THEN 'name ' || event_id END AS display_name,
               user_id % 12 + 1 AS grade, CASE WHEN value > 5 THEN 1 ELSE 0 END AS grounded, props AS question
        FROM events WHERE event_type = 'view'),
    reports AS (
        SELECT event_id AS report_id, about AS answer_id, ts AS created_at, 'u' || user_id AS reporter_id,
               CASE WHEN event_id % 2 = 0 THEN props END AS note,
               CASE WHEN event_id % 4 = 1 THEN 'reporter ' || user_id END AS reporter_name
        FROM referred WHERE event_type = 'error' AND about IS NOT NULL),
    rated AS (
        SELECT about AS answer_id, 'u' || user_id AS user_id, ts AS created_at, event_id,
               CASE WHEN event_id % 7 > 0 THEN event_id % 6 END AS clarity, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS guidance
        FROM referred WHERE event_type = 'purchase'),
    ratings AS (
        SELECT * EXCLUDE (r) FROM (
            SELECT *, row_number() OVER (PARTITION BY answer_id, user_id ORDER BY event_id DESC) AS r
            FROM rated WHERE answer_id IS NOT NULL AND (clarity IS NULL OR clarity BETWEEN 1 AND 5)) WHERE r = 1),
    names AS (SELECT user_id, arg_max(display_name, answer_id) AS latest_name FROM answers WHERE display_name IS NOT NULL GROUP BY user_id)
"""


def _referred(spark, sf_dir):
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return ss.last_answer(table(spark, sf_dir, "events"), ["user_id"], "event_id", view, "about")


def _user():
    return F.concat(F.lit("u"), F.col("user_id").cast("string"))


def answer_log(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").select(
        F.col("event_id").alias("answer_id"),
        F.col("ts").alias("created_at"),
        F.lit("events").alias("channel"),
        _user().alias("user_id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("name "), "event_id")).alias("display_name"),
        (F.col("user_id") % 12 + 1).cast("int").alias("grade"),
        F.lit(None).cast("string").alias("subject"),
        F.col("props").alias("question"),
        F.concat(F.lit("Theo sách, trang "), (F.col("event_id") % 200).cast("string")).alias("answer"),
        F.concat(F.lit("Sách A, trang 1\nSách B, trang "), (F.col("event_id") % 200).cast("string")).alias("citations"),
        F.when(F.col("value") > 5, 1).otherwise(0).alias("grounded"),
    )
    return rows


def _reports(spark, sf_dir):
    old = _referred(spark, sf_dir).where("event_type = 'error'").select(
        F.col("event_id").alias("report_id"),
        F.col("about").alias("answer_id"),
        F.col("ts").alias("created_at"),
        _user().alias("reporter_id"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("note"),
        F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("reporter "), "user_id")).alias("reporter_name"),
    )
    return fb.accept_reports(fb.with_later_columns(old, "note", "reporter_name"), answer_log(spark, sf_dir))


def _ratings(spark, sf_dir):
    arrived = _referred(spark, sf_dir).where("event_type = 'purchase'").select(
        F.col("about").alias("answer_id"),
        _user().alias("user_id"),
        F.col("ts").alias("created_at"),
        "event_id",
        F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 6).cast("int").alias("clarity"),
        F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5).cast("int").alias("guidance"),
        F.lit(None).cast("string").alias("user_name"),
    )
    return fb.accept_ratings(arrived, answer_log(spark, sf_dir), ["event_id"])


@query(
    f"""WITH {SQL_TABLES}
    SELECT a.answers, grounded_answers::BIGINT AS grounded_answers, (answers - grounded_answers)::BIGINT AS refusals, reports, reporters,
           ratings, raters, round(clarity, 9) AS average_clarity, round(guidance, 9) AS average_guidance, round(reports / answers, 9) AS report_rate
    FROM (SELECT count(*) AS answers, coalesce(sum(grounded), 0) AS grounded_answers FROM answers) a,
         (SELECT count(*) AS reports, count(DISTINCT reporter_id) AS reporters FROM reports),
         (SELECT count(*) AS ratings, count(DISTINCT user_id) AS raters, avg(clarity) AS clarity, avg(guidance) AS guidance FROM ratings)"""
)
def feedback_summary(spark, sf_dir):
    totals = fb.summary(answer_log(spark, sf_dir), _reports(spark, sf_dir), _ratings(spark, sf_dir))
    rounded = {c: F.round(c, 9) for c in ("average_clarity", "average_guidance", "report_rate")}
    return totals.withColumns(rounded)


@query(f"WITH {SQL_TABLES} SELECT report_id, answer_id, reporter_id, note FROM reports")
def accepted_reports(spark, sf_dir):
    return _reports(spark, sf_dir).select("report_id", "answer_id", "reporter_id", "note")


@query(f"WITH {SQL_TABLES} SELECT answer_id, user_id, event_id AS arrival, clarity, guidance FROM ratings")
def rating_upsert(spark, sf_dir):
    return _ratings(spark, sf_dir).select("answer_id", "user_id", F.col("event_id").alias("arrival"), "clarity", "guidance")


@query(f"WITH {SQL_TABLES} SELECT user_id, latest_name FROM names")
def latest_names(spark, sf_dir):
    return fb.latest_names(answer_log(spark, sf_dir))


@query(
    f"""WITH {SQL_TABLES}
    SELECT report_id, coalesce(reporter_name, latest_name, '(mã ' || reporter_id || ')') AS reporter FROM reports LEFT JOIN names ON user_id = reporter_id"""
)
def report_names(spark, sf_dir):
    """Every report with a name for its reporter."""
    filled = fb.fill_names(
        _reports(spark, sf_dir), fb.latest_names(answer_log(spark, sf_dir)), "reporter_id", "reporter_name"
    )
    reporter = F.coalesce("reporter_name", F.concat(F.lit("(mã "), "reporter_id", F.lit(")")))
    return filled.select("report_id", reporter.alias("reporter"))


@query(
    f"""WITH {SQL_TABLES}
    SELECT report_id, r.answer_id, reporter_id, coalesce(reporter_name, n.latest_name, '(mã ' || reporter_id || ')') AS reporter,
           coalesce(display_name, m.latest_name) AS display_name, grade, question
    FROM (SELECT * FROM reports ORDER BY report_id DESC LIMIT 20) r JOIN answers a USING (answer_id)
    LEFT JOIN names n ON n.user_id = reporter_id LEFT JOIN names m ON m.user_id = a.user_id"""
)
def recent_reports(spark, sf_dir):
    """The twenty newest reports with their answers."""
    rows = fb.recent_reports(_reports(spark, sf_dir), answer_log(spark, sf_dir))
    return rows.select("report_id", "answer_id", "reporter_id", "reporter", "display_name", "grade", "question")


@query(
    f"""WITH {SQL_TABLES}
    SELECT report_id AS bao_sai_id, coalesce(reporter_name, n.latest_name, '(mã ' || reporter_id || ')') AS nguoi_bao, grade AS lop, question AS cau_hoi,
           coalesce(note, '') AS hoc_sinh_noi_sai_o_dau, 'Sách A, trang 1; Sách B, trang ' || (answer_id % 200) AS trang_sach,
           CASE WHEN grounded = 1 THEN 'có' ELSE 'không' END AS tra_loi_duoc_tu_sach, '' AS ket_luan_cua_thay_co
    FROM (SELECT * FROM reports ORDER BY report_id DESC LIMIT 500) r JOIN answers a USING (answer_id) LEFT JOIN names n ON n.user_id = reporter_id"""
)
def feedback_review_sheet(spark, sf_dir):
    """The review sheet of the 500 newest reports."""
    sheet = feedback_sheet(fb.recent_reports(_reports(spark, sf_dir), answer_log(spark, sf_dir), limit=500))
    return sheet.select(
        "bao_sai_id", "nguoi_bao", "lop", "cau_hoi", "hoc_sinh_noi_sai_o_dau", "trang_sach", "tra_loi_duoc_tu_sach", "ket_luan_cua_thay_co"
    )


@query(
    """SELECT event_id, user_id IN (1, 2, 3) AND event_type = 'view' AS admitted FROM events"""
)
def feedback_admission(spark, sf_dir):
    """Who would be shown the summary: listed accounts in private chats only."""
    gate = ms.may_read_feedback(F.col("user_id"), F.col("event_type") == "view", [1, 2, 3])
    return table(spark, sf_dir, "events").select("event_id", gate.alias("admitted"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '/baosai' ELSE '/chamdiem' END || ' #' || event_id ||
              CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || (event_id % 3) END || ' ' || event_type AS command FROM events"""
)
def interaction_commands(spark, sf_dir):
    """Button presses as the text commands they stand for."""
    kind = F.when(F.col("event_type") == "error", "report").otherwise("rate")
    score = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 3).cast("string"))
    command = ms.interaction_command(kind, F.col("event_id"), score, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", command.alias("command"))


@query(
    f"""WITH {SQL_TABLES},
    last AS (SELECT coalesce(max(answer_id), 0) AS id FROM answers WHERE answer_id % 2 = 0)
    SELECT last.id + row_number() OVER (ORDER BY answer_id) AS answer_id, created_at, 'events' AS channel, user_id,
           display_name, grade::INTEGER AS grade, question, grounded::INTEGER AS grounded
    FROM answers, last WHERE answer_id % 2 = 1"""
)
def recorded_answers(spark, sf_dir):
    """Every second answer is in the log already; the others arrive in the order of their events."""
    answers = answer_log(spark, sf_dir)
    known, incoming = answers.where("answer_id % 2 = 0"), answers.where("answer_id % 2 = 1")
    recorded = fb.record_answers(known, incoming.withColumn("arrival", F.col("answer_id")), "arrival")
    return recorded.select(
        "answer_id", "created_at", "channel", "user_id", "display_name", "grade", "question", "grounded"
    )
