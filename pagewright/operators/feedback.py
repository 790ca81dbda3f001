"""Answers, reports and ratings: recording, joining and summing up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.messages import rating_in_range
from pagewright.operators.index import latest
from pagewright.plans.ordered import gapless_rank

ANSWER_COLUMNS = (
    "answer_id bigint, created_at timestamp, channel string, user_id string, display_name string, "
    "grade int, subject string, question string, answer string, citations string, grounded int"
)


def with_later_columns(rows: DataFrame, *names: str) -> DataFrame:
    """Add text columns an older table does not have yet."""
    missing = [n for n in names if n not in rows.columns]
    return rows.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else rows


def with_answer_ids(known: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """``incoming`` with ``answer_id``: ids go on gaplessly from the largest of ``known`` in the order of arrival."""
    placed = gapless_rank(incoming, order, "__place")
    largest = known.agg(F.coalesce(F.max("answer_id"), F.lit(0)).alias("__largest"), F.lit(0).alias("__one"))
    # One row, looked up like any other.
    numbered = placed.withColumn("__one", F.lit(0)).join(largest, "__one")
    return numbered.withColumn("answer_id", F.col("__largest") + F.col("__place") + 1).drop("__one", "__largest", "__place")


def record_answers(known: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """``incoming`` as rows of the answer log: ids go on gaplessly from the largest known one.

    ``order`` (unique) is the order of arrival.  A NULL creation time becomes the
    present one; columns an answer lacks are NULL.
    """
    placed = with_answer_ids(known, incoming.drop("answer_id"), order)
    columns = dict(c.strip().split(" ") for c in ANSWER_COLUMNS.split(","))
    given = {c: F.col(c) if c in placed.columns else F.lit(None) for c in columns}
    given["created_at"] = F.coalesce(given["created_at"].cast("timestamp"), F.current_timestamp())
    return placed.select(*[given[c].cast(kind).alias(c) for c, kind in columns.items()])


def accept_reports(reports: DataFrame, answers: DataFrame) -> DataFrame:
    """Reports about answers that exist."""
    return reports.join(answers.select("answer_id"), "answer_id", "left_semi")


def accept_ratings(ratings: DataFrame, answers: DataFrame, arrival: list[str]) -> DataFrame:
    """Valid ratings of existing answers; a person's later rating replaces the earlier one whole."""
    valid = ratings.where(rating_in_range(F.col("clarity")) & rating_in_range(F.col("guidance")))
    known = valid.join(answers.select("answer_id"), "answer_id", "left_semi")
    return latest(known, ["answer_id", "user_id"], arrival)


def latest_names(answers: DataFrame) -> DataFrame:
    """user_id, latest_name: the last name each person was seen under."""
    named = answers.where(F.col("display_name").isNotNull())
    return named.groupBy("user_id").agg(
        F.max_by("display_name", F.struct("created_at", "answer_id")).alias("latest_name")
    )


def fill_names(rows: DataFrame, names: DataFrame, user: str, name: str) -> DataFrame:
    """Fill missing names from the latest one known for the same person."""
    known = names.withColumnRenamed("user_id", user)
    return (
        rows.join(known, [user], "left")
        .withColumn(name, F.coalesce(name, "latest_name"))
        .drop("latest_name")
    )


def summary(answers: DataFrame, reports: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row of totals over the three tables, in one aggregate."""
    events = (
        answers.select(F.lit("answer").alias("kind"), F.lit(None).cast("string").alias("who"),
                       F.col("grounded").cast("int").alias("grounded"),
                       F.lit(None).cast("int").alias("clarity"), F.lit(None).cast("int").alias("guidance"))
        .unionByName(
            reports.select(F.lit("report").alias("kind"), F.col("reporter_id").cast("string").alias("who")),
            allowMissingColumns=True,
        )
        .unionByName(
            ratings.select(F.lit("rating").alias("kind"), F.col("user_id").cast("string").alias("who"),
                           F.col("clarity").cast("int").alias("clarity"),
                           F.col("guidance").cast("int").alias("guidance")),
            allowMissingColumns=True,
        )
    )

    def people(kind: str):
        return F.count_distinct(F.when(F.col("kind") == kind, F.col("who")))

    totals = events.agg(
        F.count_if(F.col("kind") == "answer").alias("answers"),
        F.coalesce(F.sum("grounded"), F.lit(0)).alias("grounded_answers"),
        F.count_if(F.col("kind") == "report").alias("reports"),
        people("report").alias("reporters"),
        F.count_if(F.col("kind") == "rating").alias("ratings"),
        people("rating").alias("raters"),
        F.avg("clarity").alias("average_clarity"),
        F.avg("guidance").alias("average_guidance"),
    )
    return totals.withColumn("refusals", F.col("answers") - F.col("grounded_answers")).withColumn(
        "report_rate",
        F.when(F.col("answers") == 0, F.lit(0.0)).otherwise(
            F.try_divide(F.col("reports").cast("double"), F.col("answers"))
        ),
    )


def recent_reports(reports: DataFrame, answers: DataFrame, limit: int = 20) -> DataFrame:
    """The newest reports with their answers and the names of both people.

    The limit comes first (a report always has its answer, see
    :func:`accept_reports`), so only ``limit`` rows are ever broadcast, and names
    are looked up for those people alone.
    """
    newest = F.broadcast(reports.orderBy(F.desc("report_id")).limit(limit))
    about = answers.withColumnsRenamed({"created_at": "answered_at", "user_id": "asker_id"})
    joined = about.join(newest, "answer_id")
    people = joined.select(
        F.explode(F.array("asker_id", "reporter_id")).alias("user_id")
    ).distinct()
    names = latest_names(answers.join(F.broadcast(people), "user_id", "left_semi"))
    asker = names.select(F.col("user_id").alias("asker_id"), F.col("latest_name").alias("__asker"))
    reporter = names.select(F.col("user_id").alias("reporter_id"), F.col("latest_name").alias("__reporter"))
    return (
        joined.join(F.broadcast(asker), "asker_id", "left")
        .join(F.broadcast(reporter), "reporter_id", "left")
        .withColumn("display_name", F.coalesce("display_name", "__asker"))
        .withColumn("reporter_name", F.coalesce("reporter_name", "__reporter"))
        .drop("__asker", "__reporter")
        .withColumn(
            "reporter",
            F.coalesce("reporter_name", F.concat(F.lit("(mã "), "reporter_id", F.lit(")"))),
        )
    )


def ratings_for(ratings: DataFrame, answer_id: int) -> DataFrame:
    return ratings.where(F.col("answer_id") == answer_id).orderBy("created_at", "user_id")
