"""Conversation state worked out from a message log, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.index import latest
from pagewright.plans.ordered import change_epochs, last_known


def last_messages(messages: DataFrame, keys: list[str], order: str, keep: int) -> DataFrame:
    """The last ``keep`` messages of each session, ``position`` 1 being the oldest kept.

    Spark limits each group before the shuffle for this shape, so a session with
    very many messages sends ``keep`` rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    kept = messages.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= keep)
    oldest = Window.partitionBy(*keys).orderBy(F.desc("__n"))
    return kept.withColumn("position", F.row_number().over(oldest)).drop("__n")


def history(messages: DataFrame, keys: list[str], order: str, role: str, content: str, keep: int) -> DataFrame:
    """One row per session: array<struct<role, content>>, oldest first."""
    kept = last_messages(messages, keys, order, keep)
    rows = F.array_sort(F.collect_list(F.struct("position", F.col(role).alias("role"), F.col(content).alias("content"))))
    return kept.groupBy(*keys).agg(rows.alias("__rows")).select(
        *keys,
        F.transform("__rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("history"),
    )


def scope_epochs(messages: DataFrame, keys: list[str], order: str, scope: Column) -> DataFrame:
    """Adds ``epoch``: history does not carry over a change of scope."""
    return change_epochs(messages, keys, order, scope, "epoch")


def last_answer(messages: DataFrame, keys: list[str], order: str, answer_id: Column, name: str = "last_answer_id") -> DataFrame:
    """Adds the most recent answer id, which a bare report or rating refers to."""
    return last_known(messages, keys, order, answer_id, name)


def save_profiles(profiles: DataFrame, changes: DataFrame, arrival: list[str]) -> DataFrame:
    """Profiles after upserts and resets; a change with ``reset`` set forgets the person."""
    keys = ["channel", "user_id"]
    newest = latest(changes, keys, arrival)
    kept = profiles.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest.where(~F.coalesce("reset", F.lit(False))).select(*profiles.columns))
