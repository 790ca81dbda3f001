"""Scoring answers against a labelled question set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import answers as an
from pagewright.operators.citations import retrieved_pages


def in_scope(passages: Column, subject: Column, grade: Column) -> Column:
    """Every passage has the question's subject and a grade at or below its own."""
    return F.forall(
        passages,
        lambda p: p["subject"].eqNullSafe(subject) & (F.coalesce(p["grade"], F.lit(0)) <= grade),
    )


def score(answered: DataFrame) -> DataFrame:
    """Outcome columns for rows of question, grade, subject, in_textbook, keywords, answer, passages.

    ``passages``: structs with subject, grade, page_start, page_end, citation.
    """
    pages = retrieved_pages(F.col("passages"))
    return answered.select(
        "*",
        F.size("passages").alias("retrieved"),
        F.array_distinct("passages.citation").alias("retrieved_sources"),
        an.looks_like_refusal(F.col("answer")).alias("refused"),
        an.is_provider_error(F.col("answer")).alias("provider_error"),
        an.invented_pages(F.col("answer"), pages).alias("invented_pages"),
        (F.size(an.pages_named(F.col("answer"))) > 0).alias("cites_a_page"),
        an.keywords_found(F.col("answer"), F.col("keywords")).alias("keywords_found"),
        in_scope(F.col("passages"), F.col("subject"), F.col("grade")).alias("in_scope"),
    )


def handled_correctly(provider_error: Column, refused: Column, in_textbook: Column) -> Column:
    return ~provider_error & (refused != in_textbook)


def verdict(
    provider_error: Column,
    in_textbook: Column,
    refused: Column,
    has_invented: Column,
    keyword_missing: Column,
) -> Column:
    return (
        F.when(provider_error, fv.VERDICT_ERROR)
        .when(~in_textbook & refused, fv.VERDICT_REFUSED_RIGHTLY)
        .when(~in_textbook, fv.VERDICT_HALLUCINATION)
        .when(refused, fv.VERDICT_WRONG_REFUSAL)
        .when(has_invented, fv.VERDICT_WRONG_PAGE)
        .when(keyword_missing, fv.VERDICT_HUMAN)
        .otherwise(fv.VERDICT_PASS)
    )


def with_verdict(outcomes: DataFrame) -> DataFrame:
    missing = (F.size("keywords") > 0) & (F.size("keywords_found") == 0)
    flags = [F.col("provider_error"), F.col("in_textbook"), F.col("refused")]
    return outcomes.withColumn(
        "verdict", verdict(*flags, F.size("invented_pages") > 0, missing)
    ).withColumn(
        "handled_correctly",
        handled_correctly(F.col("provider_error"), F.col("refused"), F.col("in_textbook")),
    )


def report(outcomes: DataFrame) -> DataFrame:
    """One row of counts; rates leave out questions that never reached the provider."""
    asked = ~F.col("provider_error")
    inside, refused = F.col("in_textbook"), F.col("refused")
    answered = asked & inside & ~refused
    missing = (F.size("keywords") > 0) & (F.size("keywords_found") == 0)
    counts = {
        "questions": F.lit(True),
        "in_textbook": inside,
        "out_of_textbook": ~inside,
        "provider_errors": ~asked,
        "in_book_asked": asked & inside,
        "out_book_asked": asked & ~inside,
        "answered": answered,
        "wrong_refusals": asked & inside & refused,
        "hallucinations": asked & ~inside & ~refused,
        "refused_rightly": asked & ~inside & refused,
        "answers_citing_a_page": answered & F.col("cites_a_page"),
        "invented_citations": F.size("invented_pages") > 0,
        "out_of_scope": ~F.col("in_scope"),
        "needs_human_review": answered & missing,
    }
    return outcomes.agg(*[F.count_if(rule).alias(name) for name, rule in counts.items()])


#: Rates of a report: what is counted, out of what.
RATES = {
    "answer_rate": ("answered", "in_book_asked"),
    "wrong_refusal_rate": ("wrong_refusals", "in_book_asked"),
    "right_refusal_rate": ("refused_rightly", "out_book_asked"),
    "hallucination_rate": ("hallucinations", "out_book_asked"),
    "citation_rate": ("answers_citing_a_page", "answered"),
}


def rates(counts: DataFrame) -> DataFrame:
    """The counts of ``report`` as shares; 0 where nothing was asked."""
    return counts.select(
        *[F.coalesce(F.try_divide(part, whole), F.lit(0.0)).alias(name) for name, (part, whole) in RATES.items()]
    )
