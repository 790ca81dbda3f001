"""From questions to checked answers, for any number of questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import answers as an
from pagewright.operators.citations import (
    citation,
    gather_passages,
    retrieved_pages,
    select_cited_sources,
    with_printed_pages,
)
from pagewright.operators.evaluation import report, score, with_verdict
from pagewright.operators.generation import AnswerClient, OfflineClient, classify_subject, generate
from pagewright.operators.retrieval import (
    attach_passages,
    best_subject,
    list_subjects,
    retrieve,
    scope_to_every_subject,
)
from pagewright.plans.materialize import materialize
from pagewright.settings import Settings

_PASSAGES = (
    "array<struct<rank:int,text:string,citation:string,subject:string,grade:int,"
    "page_start:int,page_end:int>>"
)


def with_passages(
    questions: DataFrame, chunks: DataFrame, offsets: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """Questions with an array of their passages (empty when nothing is close enough)."""
    if "chunk_id" not in chunks.columns:
        chunks = chunks.withColumnRenamed("id", "chunk_id")
    hits = retrieve(questions, chunks, settings.top_k, settings.max_distance)
    found = attach_passages(
        hits.select("qid", "rank", "chunk_id"),
        chunks,
        ["text", "subject", "grade", "book_title", "source_file", "page_start", "page_end"],
    )
    printed = with_printed_pages(found, offsets).withColumn(
        "citation", citation(F.col("book_title"), F.col("page_start"), F.col("page_end"))
    )
    gathered = gather_passages(
        printed, "text", "citation", "subject", "grade", "page_start", "page_end"
    ).withColumn("passages", F.col("passages").cast(_PASSAGES))
    return questions.drop("embedding").join(gathered, "qid", "left").withColumn(
        "passages", F.coalesce("passages", F.array().cast(_PASSAGES))
    )


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    offsets: DataFrame,
    settings: Settings = Settings(),
    make_client: Callable[[], AnswerClient] = OfflineClient,
    history: str | None = None,
) -> DataFrame:
    """Adds answer (polished), grounded, citations and the message to send."""
    return answer_found(with_passages(questions, chunks, offsets, settings), settings, make_client, history)


def answer_found(
    found: DataFrame,
    settings: Settings = Settings(),
    make_client: Callable[[], AnswerClient] = OfflineClient,
    history: str | None = None,
) -> DataFrame:
    """:func:`answer_questions` for questions that have their passages already."""
    answered = generate(found, make_client, settings, history)
    polished = answered.withColumn(
        "answer", an.polish_answer(F.col("answer"), retrieved_pages(F.col("passages")))
    )
    none = F.array().cast("array<string>")
    cited = polished.withColumn(
        "citations",
        F.when(
            F.size("source_citations") > 0,
            select_cited_sources(F.col("answer"), F.col("passages")),
        ).otherwise(none),
    )
    reminder = an.page_check_reminder(F.col("citations"))
    return cited.withColumn(
        "message",
        F.when(reminder == "", F.col("answer")).otherwise(F.concat_ws("\n\n", "answer", reminder)),
    )


def detect_subjects(
    questions: DataFrame,
    chunks: DataFrame,
    make_client: Callable[[], AnswerClient],
    settings: Settings = Settings(),
) -> DataFrame:
    """Adds ``subject``: the classifier's, else the nearest one; NULL when neither finds any.

    Only the questions the classifier left open are retrieved for.
    """
    offered = list_subjects(chunks, questions).groupBy("grade").agg(
        F.sort_array(F.collect_list("subject")).alias("subjects")
    )
    none = F.array().cast("array<string>")
    asked = questions.join(F.broadcast(offered), "grade", "left").withColumn(
        "subjects", F.coalesce("subjects", none)
    )
    classified = materialize(classify_subject(asked, make_client, settings), "classified")
    unclear = classified.where(F.col("detected").isNull()).drop("detected", "subjects")
    if unclear.isEmpty():  # else every chunk would be searched for nothing
        return classified.drop("subjects").withColumnRenamed("detected", "subject")
    scoped = scope_to_every_subject(unclear, chunks)
    nearest = best_subject(scoped, retrieve(scoped, chunks, settings.top_k, settings.max_distance))
    return (
        classified.drop("subjects")
        .join(nearest.select(F.col("asked").alias("qid"), F.col("subject").alias("__nearest")), "qid", "left")
        .withColumn("subject", F.coalesce("detected", "__nearest"))
        .drop("detected", "__nearest")
    )


def run_benchmark(
    questions: DataFrame,
    chunks: DataFrame,
    offsets: DataFrame,
    settings: Settings = Settings(),
    make_client: Callable[[], AnswerClient] = OfflineClient,
    attempts: int = 2,
    ask_again: Callable[[], AnswerClient] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Outcomes and one row of totals for labelled questions (in_textbook, keywords).

    Passages are looked up once.  A question the service failed on is asked
    again, alone with the others it failed on, up to ``attempts`` times in all
    (by ``ask_again`` where that is given); ``attempt`` says which ask counts.
    """
    found = materialize(with_passages(questions, chunks, offsets, settings), "benchmark-passages")

    def asked(rows: DataFrame, client: Callable[[], AnswerClient], attempt: int) -> DataFrame:
        scored = with_verdict(score(answer_found(rows, settings, client)))
        return scored.withColumn("attempt", F.lit(attempt))

    outcomes = materialize(asked(found, make_client, 1), "outcomes")
    for attempt in range(2, attempts + 1):
        failed = outcomes.where("provider_error").select("qid")
        if failed.isEmpty():
            break
        again = asked(found.join(failed, "qid", "left_semi"), ask_again or make_client, attempt)
        outcomes = materialize(outcomes.where("NOT provider_error").unionByName(again), "outcomes")
    return outcomes, report(outcomes)
