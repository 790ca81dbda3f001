"""Command line: ``python -m pagewright COMMAND``; each command is one Spark job.

    ingest  BOOKS INDEX --manifest FOLDER --run N   bring the index up to date with a folder of books
    bench   INDEX OFFSETS QUESTIONS... --out FOLDER  ask labelled question sets, write outcomes and totals
    audit   PAGES OUT                               look for damage in the pages of a cache
    query   NAME TABLES OUT                         write the result of a registered query

On a cluster the session of ``spark-submit`` is used; elsewhere a local one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright.operators import audit
from pagewright.operators.embedding import embed
from pagewright.operators.generation import client_for
from pagewright.plans.answering import run_benchmark
from pagewright.plans.ingest import bulk_ingest
from pagewright.plans.ship import ship_package
from pagewright.session import local_session
from pagewright.settings import Settings
from pagewright.sources import books, tables
from pagewright.sources.index_table import IndexTable
from pagewright.sources.question_sets import all_questions, read_question_set


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    files = books.list_files(spark, args.books)
    done = bulk_ingest(files, IndexTable(spark, args.index), args.manifest, args.run, settings=Settings.from_env())
    done.groupBy("state").count().show()


def bench(spark: SparkSession, args: argparse.Namespace) -> None:
    settings = Settings.from_env()
    questions = all_questions(*[read_question_set(spark, path) for path in args.questions])
    outcomes, totals = run_benchmark(
        questions.withColumn("embedding", embed(F.col("question"))), IndexTable(spark, args.index).chunks(),
        tables.read_offsets(spark, args.offsets), settings, client_for(settings),
    )
    outcomes.write.mode("overwrite").parquet(f"{args.out}/outcomes")
    tables.write_csv(tables.benchmark_sheet(outcomes), f"{args.out}/sheet")
    totals.show(truncate=False)


def audit_pages(spark: SparkSession, args: argparse.Namespace) -> None:
    pages = tables.read_cached_pages(spark, args.pages).withColumnRenamed("page_number", "page")
    audits = audit.audit_pages(audit.population(pages))
    audits.write.mode("overwrite").parquet(args.out)
    audit.kind_counts(audits).show(truncate=False)


def query(spark: SparkSession, args: argparse.Namespace) -> None:
    from pagewright.registry import QUERIES

    QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)


COMMANDS = {
    "ingest": (ingest, ["books", "index"], {"--manifest": str, "--run": int}),
    "bench": (bench, ["index", "offsets"], {}),
    "audit": (audit_pages, ["pages", "out"], {}),
    "query": (query, ["name", "tables", "out"], {}),
}


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="pagewright", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    commands = main.add_subparsers(dest="command", required=True)
    for name, (_, places, options) in COMMANDS.items():
        one = commands.add_parser(name)
        for place in places:
            one.add_argument(place)
        if name == "bench":
            one.add_argument("questions", nargs="+")
            one.add_argument("--out", required=True)
        for option, kind in options.items():
            one.add_argument(option, type=kind, required=True)
    return main


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    ship_package(spark)
    COMMANDS[args.command][0](spark, args)


if __name__ == "__main__":
    run()
