"""Auditing recognised text: flags per page, totals, samples and the repair worklist."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import audit as au
from pagewright.functions import text as tx
from pagewright.plans.materialize import materialize
from pagewright.plans.once import with_once


def population(
    pages: DataFrame, text: str = "text", formulas_only: bool = False, grades: list[int] | None = None
) -> DataFrame:
    """Pages worth auditing."""
    rows = pages.where(au.long_enough(F.col(text)))
    if formulas_only:
        rows = rows.where(au.has_formula(F.col(text)))
    return rows.where(F.col("grade").isin(grades)) if grades else rows


def sample(pages: DataFrame, keys: list[Column], size: int, seed: int) -> DataFrame:
    """A repeatable sample: the ``size`` pages with the smallest seeded hash; 0 takes all."""
    if not size:
        return pages
    draw = F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))), 256)
    return pages.withColumn("__draw", draw).orderBy("__draw").limit(size).drop("__draw")


def audit_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds issues and has_formula."""
    return with_once(pages, "issues", au.scan_page(F.col(text))).withColumn(
        "has_formula", au.has_formula(F.col(text))
    )


def suspects(pages: DataFrame, kinds: list[str], text: str = "text") -> DataFrame:
    """Pages with an issue of one of ``kinds``, found by the detectors of those kinds alone."""
    found = [F.size(au.issues_of(F.col(text), kind)) > 0 for kind in kinds]
    return pages.where(au.long_enough(F.col(text)) & reduce(or_, found))


def mark_repaired(audits: DataFrame, repairs: DataFrame, keys: list[str]) -> DataFrame:
    done = repairs.select(*keys).distinct().withColumn("__done", F.lit(True))
    return audits.join(done, keys, "left").withColumn(
        "repaired", F.coalesce("__done", F.lit(False))
    ).drop("__done")


def kind_counts(audits: DataFrame) -> DataFrame:
    return audits.select(F.explode("issues.kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def totals(audits: DataFrame) -> DataFrame:
    """One row; expects ``repaired``."""
    flagged = F.size("issues") > 0
    return audits.agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("has_formula")).alias("formula_pages"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & F.col("repaired")).alias("repaired"),
        F.count_if(flagged & ~F.col("repaired")).alias("to_do"),
    )


def flagged_pages(audits: DataFrame, kinds: list[str]) -> DataFrame:
    """Pages with one of ``kinds``, with their number of issues to sort by."""
    wanted = F.arrays_overlap(F.col("issues.kind"), F.array(*map(F.lit, kinds)))
    return audits.where(wanted).withColumn("n_issues", F.size("issues")).withColumn(
        "kinds", F.array_sort(F.array_distinct("issues.kind"))
    )


def worklist(candidates: DataFrame, repairs: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Flagged pages not repaired yet, worst first."""
    todo = candidates.join(repairs.select(*keys), keys, "left_anti")
    # Sorting draws a sample first: without a table between, every page would be scanned twice.
    todo = materialize(todo, "worklist").orderBy(F.desc("n_issues"), *keys)
    return todo.limit(limit) if limit else todo


def accept_rereads(rereads: DataFrame, text: str = "text") -> DataFrame:
    """Readings long enough to trust."""
    return rereads.where(F.length(tx.strip(F.col(text))) >= fv.MIN_REREAD_LENGTH)
