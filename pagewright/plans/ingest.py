"""From page rows to an indexed chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.catalog import accepted, infer_books, rejected
from pagewright.operators.chunking import chunk_pages
from pagewright.operators.embedding import embed
from pagewright.operators.index import apply_corrections, not_indexed_yet, with_chunk_id
from pagewright.plans.materialize import materialize
from pagewright.settings import Settings
from pagewright.sources.books import (
    ImageReader,
    PageExtractor,
    PdfExtractor,
    clean_pages,
    extract_or_report,
    read_images,
)
from pagewright.sources.index_table import IndexTable


def plan_files(files: DataFrame, index: DataFrame | None, force: bool = False) -> DataFrame:
    """Accepted books, without those indexed already unless ``force``."""
    books = accepted(infer_books(files))
    if index is None or force:
        return books
    return not_indexed_yet(books, index, ["grade", "subject", "source_file"])


def ingest(
    pages: DataFrame,
    books: DataFrame,
    settings: Settings = Settings(),
    embedder=embed,
    corrections: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Chunks with ids and vectors, as retrieval reads them.

    ``pages``: cleaned rows of path, page_number, text.  ``books``: path, grade,
    subject, book_title, source_file, one row per file.  ``corrections``:
    patches, text fixes and repairs, applied in the same job.
    """
    known = pages.join(books.select("path"), ["path"], "left_semi")
    chunks = chunk_pages(
        known,
        ["path"],
        chunk_size=settings.chunk_size,
        chunk_overlap=settings.chunk_overlap,
    )
    described = chunks.join(
        books.select("path", "grade", "subject", "book_title", "source_file"), ["path"]
    ).drop("path")
    indexed = with_chunk_id(described).withColumn("embedding", embedder(F.col("text")))
    return indexed if corrections is None else apply_corrections(indexed, *corrections, embedder)


MANIFEST = "path string, fingerprint string, state string, reason string, run bigint"


def bulk_ingest(
    files: DataFrame,
    table: IndexTable,
    manifest: str,
    run: int,
    make_extractor: Callable[[], PageExtractor] = PdfExtractor,
    make_reader: Callable[[], ImageReader] | None = None,
    settings: Settings = Settings(),
    corrections: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Bring the index up to date with ``files`` (as ``list_files`` gives them); returns this run's manifest rows.

    The manifest at ``manifest``, a folder for each run, says of each file what
    became of it: ``done``, ``failed`` (it could not be read or gave no page; it
    is tried again by the next run) or ``rejected`` (its name says no book).  A
    file is read when no run has done it as it is now, by length and time of
    change.  One bad file is a row, and the others are indexed all the same.
    Chunks of a file that was read again replace all its earlier ones.
    """
    spark = files.sparkSession
    mark = F.concat_ws("/", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    listed = files.select("path", mark.alias("fingerprint"))
    earlier = read_manifest(spark, manifest)
    done = earlier.where("state = 'done'").select("path", "fingerprint").distinct()
    todo = materialize(listed.join(done, ["path", "fingerprint"], "left_anti"), "files-to-read")
    named = infer_books(todo)
    books = materialize(accepted(named), "books-to-read")
    wanted = files.join(books.select("path"), "path", "left_semi")
    read = materialize(extract_or_report(wanted, make_extractor), "extracted")
    whole = read.where(F.col("error").isNull()).drop("error")
    bad = read.where(F.col("error").isNotNull()).groupBy("path").agg(F.min("error").alias("reason"))
    # A file that broke off is not indexed in part.
    whole = whole.join(bad.select("path"), "path", "left_anti")
    pages = clean_pages(read_images(whole, make_reader) if make_reader else whole.drop("images"))
    chunks = materialize(ingest(pages, books, settings, table.embedder), "ingested")
    fresh = chunks.select("grade", "subject", "source_file").distinct()
    if table.exists():
        keys = ["grade", "subject", "source_file"]
        stale = table.chunks().select("id", *keys).join(fresh, keys, "left_semi")
        table.delete(stale.join(chunks.select("id"), "id", "left_anti"))
        table.upsert(chunks)
    else:
        table.create(chunks)
    if corrections is not None:
        table.correct(*corrections)
    indexed = books.join(fresh, ["grade", "subject", "source_file"], "left_semi").select("path", F.lit(True).alias("indexed"))
    state = (
        F.when(F.col("reject_reason").isNotNull(), "rejected")
        .when(F.col("reason").isNotNull() | F.col("indexed").isNull(), "failed")
        .otherwise("done")
    )
    rows = (
        todo.join(rejected(named).select("path", "reject_reason"), "path", "left")
        .join(bad, "path", "left")
        .join(indexed, "path", "left")
        .select(
            "path", "fingerprint", state.alias("state"),
            F.coalesce("reject_reason", "reason", F.when(F.col("indexed").isNull(), "no text on any page")).alias("reason"),
            F.lit(run).cast("bigint").alias("run"),
        )
    )
    rows.write.mode("overwrite").parquet(f"{manifest.rstrip('/')}/run-{run}")
    return spark.read.schema(MANIFEST).parquet(f"{manifest.rstrip('/')}/run-{run}")


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """What all runs did, empty before the first one."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{manifest.rstrip('/')}/run-*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], MANIFEST)
        raise
