"""Printed page numbers, citations, and which retrieved passages an answer leans on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions.answers import page_mentions


def printed_page(page: Column, offset: Column) -> Column:
    """Page minus the book's offset, unless that is no page at all."""
    shifted = page - F.coalesce(F.when(offset >= 0, offset), F.lit(0))
    return F.when(shifted >= 1, shifted).otherwise(page)


def with_printed_pages(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Translate page_start and page_end; ``offsets``: source_file, offset."""
    valid = offsets.where(F.col("offset") >= 0).select("source_file", F.col("offset").alias("__offset"))
    joined = rows.join(valid, ["source_file"], "left")
    for column in ("page_start", "page_end"):
        joined = joined.withColumn(column, printed_page(F.col(column), F.col("__offset")))
    return joined.drop("__offset")


def citation(book_title: Column, start: Column, end: Column) -> Column:
    book = F.coalesce(book_title, F.lit(fv.DEFAULT_BOOK_TITLE))
    single = end.isNull() | (end == start)
    return (
        F.when(start.isNull(), book)
        .when(single, F.concat(book, F.lit(fv.CITATION_PAGE_SEPARATOR), start.cast("string")))
        .otherwise(
            F.concat(
                book,
                F.lit(fv.CITATION_PAGE_SEPARATOR),
                start.cast("string"),
                F.lit("-"),
                end.cast("string"),
            )
        )
    )


def gather_passages(hits: DataFrame, *columns: str) -> DataFrame:
    """One row per question with its passages in rank order.

    Retrieval returns at most its top-k per question, so the arrays are small.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    return hits.groupBy("qid").agg(ordered.alias("passages"))


def retrieved_pages(passages: Column) -> Column:
    """All page numbers of the passages (structs with page_start and page_end)."""
    placed = F.filter(passages, lambda p: p["page_start"].isNotNull())
    spans = F.transform(
        placed, lambda p: F.sequence(p["page_start"], F.coalesce(p["page_end"], p["page_start"]))
    )
    return F.array_distinct(F.flatten(spans))


def select_cited_sources(answer: Column, passages: Column, limit: int = fv.MAX_CITED_SOURCES) -> Column:
    """Citations of the passages holding the pages the answer mentions, in that order.

    For each page the best-ranked passage containing it; the top passage when
    no mentioned page was retrieved.
    """

    def holder(page: Column) -> Column:
        holds = F.filter(
            passages,
            lambda p: page.between(p["page_start"], F.coalesce(p["page_end"], p["page_start"])),
        )
        return F.get(holds, F.lit(0))["citation"]

    named = F.array_distinct(F.array_compact(F.transform(page_mentions(answer), holder)))
    top = F.array_compact(F.array(F.get(passages, F.lit(0))["citation"]))
    return F.slice(F.when(F.size(named) > 0, named).otherwise(top), 1, limit)
