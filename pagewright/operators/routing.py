"""What each incoming message asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import messages as ms
from pagewright.functions import text as tx


def route(messages: DataFrame) -> DataFrame:
    """Adds the action of each message and what it carries.

    ``messages``: text and last_answer_id, the answer a bare report or rating
    means.  Adds action, valid (the argument can be used), grade, subject, clear,
    question, report and rating; columns that do not belong to the action are NULL.
    """
    parsed = messages.withColumn("__c", ms.parse_command(F.col("text"))).withColumn(
        "action", ms.command_action(F.col("__c.command"))
    )

    def only(action: str, value):
        return F.when(F.col("action") == action, value)

    argument = F.col("__c.argument")
    subject = tx.normalize_subject(argument)
    carried = parsed.select(
        *messages.columns,
        "action",
        only("set_grade", tx.validate_grade(argument)).alias("grade"),
        only("set_subject", F.when(tx.is_known_subject(subject), subject)).alias("subject"),
        (F.col("action") == "clear_history").alias("clear"),
        only("question", tx.strip(F.col("text"))).alias("question"),
        only("report", ms.parse_report(argument, F.col("last_answer_id"))).alias("report"),
        only("rate", ms.parse_rating(argument, F.col("last_answer_id"))).alias("rating"),
    )
    rated = (
        F.col("rating.answer_id").isNotNull()
        & F.col("rating.clarity").isNotNull()
        & ms.rating_in_range(F.col("rating.clarity"))
        & ms.rating_in_range(F.col("rating.guidance"))
    )
    valid = (
        F.when(F.col("action") == "set_grade", F.col("grade").isNotNull())
        .when(F.col("action") == "set_subject", F.col("subject").isNotNull())
        .when(F.col("action") == "question", F.col("question") != "")
        .when(F.col("action") == "report", F.col("report.answer_id").isNotNull())
        .when(F.col("action") == "rate", rated)
        .otherwise(F.col("action") != "unknown")
    )
    return carried.withColumn("valid", valid)
