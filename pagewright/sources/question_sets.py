"""Labelled question sets for benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.plans.ordered import gapless_rank

QUESTIONS = "question string, grade int, subject string, keywords array<string>, in_textbook boolean"


def read_question_set(spark: SparkSession, path: str, in_textbook: bool | None = None) -> DataFrame:
    """Questions from JSON lines, in file order; ``in_textbook`` labels all of them where it is given.

    Rows without question, grade or subject cannot be asked and are left out.
    """
    rows = spark.read.schema(QUESTIONS).json(path)
    label = F.coalesce("in_textbook", F.lit(True)) if in_textbook is None else F.lit(in_textbook)
    usable = ~tx.is_blank(F.col("question")) & F.col("grade").isNotNull() & F.col("subject").isNotNull()
    return rows.where(F.coalesce(usable, F.lit(False))).select(
        "question", "grade", "subject",
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), label.alias("in_textbook"),
    )


def all_questions(*sets: DataFrame) -> DataFrame:
    """The union of question sets, one after another, with ``position`` from 1 and ``qid``."""
    united = None
    for number, questions in enumerate(sets):
        placed = questions.withColumn("__at", F.struct(F.lit(number).alias("set"), F.monotonically_increasing_id().alias("line")))
        united = placed if united is None else united.unionByName(placed)
    ranked = gapless_rank(united, "__at", "__rank")
    position = (F.col("__rank") + 1).cast("int")
    return ranked.withColumn("position", position).withColumn("qid", position.cast("string")).drop("__at", "__rank")
