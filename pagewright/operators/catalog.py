"""Grade, subject and title of a book from its path; what does not fit is rejected, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import text as tx

_PATH = r"([^/]+)/([^/]+)\.[pP][dD][fF]$"
_NAME = r"^([A-Za-z]+?)(\d+)(.*)$"


def split_camel_case(col: Column) -> Column:
    return tx.strip(F.regexp_replace(col, r"(?<!^)(?=[A-Z])", " "))


def describe_suffix(suffix: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in fv.VOLUME_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.lower(suffix)), split_camel_case(suffix))


def infer_books(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds source_file, grade, subject, book_title and reject_reason (NULL when accepted)."""
    stem = F.regexp_extract(path, _PATH, 2)
    bare = F.regexp_replace(stem, f"^{fv.FILE_PREFIX}", "")
    elective = F.startswith(bare, F.lit(fv.ELECTIVE_PREFIX))
    parts = files.select(
        "*",
        F.regexp_extract(path, r"([^/]+)$", 1).alias("source_file"),
        tx.validate_grade(F.regexp_extract(path, _PATH, 1)).alias("__folder"),
        elective.alias("__elective"),
        F.regexp_replace(bare, f"^{fv.ELECTIVE_PREFIX}", "").alias("__body"),
    ).select(
        "*",
        F.regexp_extract("__body", _NAME, 1).alias("__subject"),
        F.regexp_extract("__body", _NAME, 2).try_cast("int").alias("__named"),
        F.regexp_extract("__body", _NAME, 3).alias("__suffix"),
    )
    reason = (
        F.when(F.col("__folder").isNull(), "folder is not a grade")
        .when(F.col("__subject") == "", "file name does not match")
        .when(~F.col("__named").eqNullSafe(F.col("__folder")), "grade differs from folder")
    )
    subject = tx.normalize_subject(F.col("__subject"))
    title = F.concat(
        F.when(F.col("__elective"), fv.ELECTIVE_TITLE + " ").otherwise(""),
        F.concat_ws(" ", "subject", F.col("__folder").cast("string")),
        F.when(F.col("__suffix") == "", "").otherwise(
            F.concat(F.lit(" - "), describe_suffix(F.col("__suffix")))
        ),
    )
    accepted = F.col("reject_reason").isNull()
    return (
        parts.withColumn("reject_reason", reason)
        .withColumn("grade", F.when(accepted, F.col("__folder")))
        .withColumn("subject", F.when(accepted, subject))
        .withColumn("book_title", F.when(accepted, title))
        .drop("__folder", "__elective", "__body", "__subject", "__named", "__suffix")
    )


def accepted(books: DataFrame) -> DataFrame:
    return books.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(books: DataFrame) -> DataFrame:
    return books.where(F.col("reject_reason").isNotNull())
