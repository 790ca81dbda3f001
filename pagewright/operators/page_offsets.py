"""How far printed page numbers lag behind page positions, measured per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv


def sampled(page_index: Column, total: Column, samples: int = fv.DEFAULT_PAGE_SAMPLES) -> Column:
    """Whether a 0-based page of a book of ``total`` pages is among those looked at."""
    first = F.floor(total * F.lit(fv.SAMPLED_FROM))
    last = F.floor(total * F.lit(fv.SAMPLED_TO))
    step = F.greatest(F.lit(1), F.floor((last - first) / F.lit(samples)))
    return (
        (total >= fv.MIN_BOOK_PAGES)
        & (page_index >= first)
        & (page_index < last)
        & ((page_index - first) % step == 0)
    )


def number_candidates(strip_text: Column) -> Column:
    """Numbers of up to three digits read from the edge strips of a page."""
    return F.transform(
        F.regexp_extract_all(strip_text, F.lit(r"(\d{1,3})"), F.lit(1)), lambda n: n.cast("int")
    )


def page_offset(page_number: Column, candidates: Column) -> Column:
    """Smallest plausible offset of one page, or NULL."""
    offsets = F.transform(candidates, lambda printed: page_number - printed)
    return F.array_min(F.filter(offsets, lambda d: d.between(0, fv.MAX_PAGE_OFFSET)))


def measure_books(observed: DataFrame, book: str = "source_file") -> DataFrame:
    """Per book the most frequent offset, kept only when enough samples agree.

    ``observed``: book, page_number, offset (NULL rows are unusable).  On equal
    counts the offset seen on the earlier page wins.  Offsets run from 0 to 8,
    so after the first count a book has nine rows at most.
    """
    counts = (
        observed.where(F.col("offset").isNotNull())
        .groupBy(book, "offset")
        .agg(F.count("*").alias("n"), F.min("page_number").alias("first_page"))
    )
    best = F.max_by("offset", F.struct("n", -F.col("first_page")))
    agreeing, usable = F.max("n"), F.sum("n")
    confident = (agreeing >= fv.MIN_AGREEING_SAMPLES) & (
        agreeing / usable >= fv.MIN_AGREEMENT_SHARE
    )
    return counts.groupBy(book).agg(
        F.when(confident, best).alias("offset"),
        agreeing.alias("agreeing"),
        usable.alias("usable"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("offset", "n")))).alias("observed"),
    )


def merge_offsets(known: DataFrame, measured: DataFrame, book: str = "source_file") -> DataFrame:
    """Known offsets with confident new ones taking their place."""
    fresh = measured.where(F.col("offset").isNotNull()).select(book, F.col("offset").alias("__new"))
    return known.join(fresh, book, "full_outer").select(
        book, F.coalesce("__new", "offset").alias("offset")
    )


def unmeasured(known: DataFrame, measured: DataFrame, book: str = "source_file") -> DataFrame:
    """Books measured without a confident result and without a known offset."""
    return measured.where(F.col("offset").isNull()).select(book).join(known, book, "left_anti")


def offset_histogram(measured: DataFrame) -> DataFrame:
    """How many books have each measured offset; NULL stands for books without a confident one."""
    return measured.groupBy("offset").agg(F.count("*").alias("books"))


def both_strips(top: DataFrame, bottom: DataFrame, page: list[str], text: str) -> DataFrame:
    """Numbers read from the upper and the lower edge strip of each page, together."""
    strips = top.select(*page, text).unionByName(bottom.select(*page, text))
    found = strips.select(*page, F.explode_outer(number_candidates(F.col(text))).alias("__number"))
    return found.groupBy(*page).agg(F.sort_array(F.collect_set("__number")).alias("candidates"))
