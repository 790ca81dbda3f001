"""Running headers and footers: lines repeated on most pages of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import text as tx
from pagewright.plans.materialize import materialize
from pagewright.plans.once import with_once


def repeated_lines(
    pages: DataFrame, book: str, text: str, ratio: float = fv.REPEATED_LINE_RATIO
) -> DataFrame:
    """(book, line, pages_with_line) of the lines on at least ``ratio`` of a book's pages.

    One grouping counts pages and lines together: every page brings its lines and
    one mark without a line.  Counts are combined map-side, so a book with very
    many pages sends one partial count per line and task, not its pages, and
    only lines seen often enough in any book are looked at again.
    """
    marked = F.concat(F.array(F.lit(None).cast("string")), tx.header_candidates(F.col(text)))
    counts = materialize(
        pages.select(F.col(book), F.explode(marked).alias("line"))
        .groupBy(book, "line")
        .agg(F.count("*").alias("pages_with_line"))
        .where(F.col("line").isNull() | (F.col("pages_with_line") >= fv.MIN_REPEATED_LINE_COUNT)),
        "line-counts",
    )
    needed = F.greatest(F.lit(fv.MIN_REPEATED_LINE_COUNT), F.floor(F.col("pages_with_line") * F.lit(ratio)))
    books = counts.where(
        F.col("line").isNull() & (F.col("pages_with_line") >= fv.MIN_PAGES_FOR_BOILERPLATE)
    ).select(book, needed.alias("__needed"))
    return (
        counts.where(F.col("line").isNotNull())
        .join(books, [book])
        .where(F.col("pages_with_line") >= F.col("__needed"))
        .select(book, "line", "pages_with_line")
    )


def drop_boilerplate(
    pages: DataFrame, book: str, page: str, text: str, ratio: float = fv.REPEATED_LINE_RATIO
) -> DataFrame:
    """Pages without their book's repeated lines.

    A book's repeated lines fit one row: lines on at least ``ratio`` of the pages
    number at most (lines per page) / ``ratio`` however long the book is.
    """
    blocked = materialize(
        repeated_lines(pages, book, text, ratio)
        .groupBy(book)
        .agg(F.collect_list("line").alias("__blocked")),
        "boilerplate",
    )
    none = F.array().cast("array<string>")
    joined = pages.join(blocked, [book], "left")
    dropped = tx.drop_lines(F.col(text), F.coalesce("__blocked", none))
    return with_once(joined, text, dropped).drop("__blocked").select(*pages.columns)
