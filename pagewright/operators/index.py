"""The chunk index as a table: ids, upserts, deletes and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.operators.embedding import embed
from pagewright.plans.materialize import materialize

ID_COLUMNS = ["grade", "subject", "source_file", "chunk_index", "text"]


def chunk_id(
    grade: Column, subject: Column, source_file: Column, chunk_index: Column, text: Column
) -> Column:
    """SHA-256 of the book, the position and the text; titles and pages do not count."""
    parts = [grade, subject, source_file, chunk_index, text]
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", chunk_id(*[F.col(c) for c in ID_COLUMNS]))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    An aggregate rather than a window: copies of one key are reduced map-side,
    so a key with very many copies is not collected in one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``table`` with the rows of ``incoming`` inserted or replaced by key.

    Only the incoming rows are deduplicated.  They are stored, so that their
    size is known when the anti join with the table is planned: few of them are
    broadcast, and the table is not shuffled.
    """
    fresh = materialize(latest(incoming, keys, order), "upserted")
    kept = table.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*table.columns))


def delete(table: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(ids.select(*keys), keys, "left_anti")


def not_indexed_yet(files: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Files with no row in the index, for a run that resumes."""
    return files.join(table.select(*keys).distinct(), keys, "left_anti")


def apply_text_fixes(chunks: DataFrame, fixes: DataFrame, embedder=embed) -> DataFrame:
    """Replace misread text in place and give the corrected chunks their new id.

    ``fixes``: source_file, chunk_index, position, wrong, right; several fixes of
    one chunk apply in the order of ``position``.  A fix that no longer matches
    changes nothing, so applying twice is the same as applying once.  Where chunks
    have vectors, those of changed texts are worked out again.  Fixes are stored
    first: a few of them are broadcast, and no text of a chunk is shuffled.
    """
    per_chunk = materialize(
        fixes.groupBy("source_file", "chunk_index").agg(
            F.sort_array(F.collect_list(F.struct("position", "wrong", "right"))).alias("__fixes")
        ),
        "fixes",
    )
    fixed = F.aggregate(
        "__fixes", F.col("text"), lambda text, fix: F.replace(text, fix["wrong"], fix["right"])
    )
    joined = chunks.join(per_chunk, ["source_file", "chunk_index"], "left")
    corrected = joined.withColumn("__old", F.col("text")).withColumn(
        "text", F.when(F.col("__fixes").isNull(), F.col("text")).otherwise(fixed)
    )
    if "embedding" in chunks.columns:
        changed = embedder(F.when(~F.col("text").eqNullSafe(F.col("__old")), F.col("text")))
        corrected = corrected.withColumn("embedding", F.coalesce(changed, "embedding"))
    return with_chunk_id(corrected).select(*chunks.columns)


def patch_chunks(patches: DataFrame) -> DataFrame:
    """Hand-written passages as chunks with indexes no natural chunk can have."""
    return _page_chunks(patches, fv.PATCH_INDEX_BASE)


def repair_chunks(repairs: DataFrame) -> DataFrame:
    """Re-read pages as chunks."""
    return _page_chunks(repairs, fv.REPAIR_INDEX_BASE)


def _page_chunks(pages: DataFrame, base: int) -> DataFrame:
    return with_chunk_id(
        pages.select(
            "grade",
            "subject",
            "book_title",
            "source_file",
            (F.col("page") + base).alias("chunk_index"),
            "text",
            F.col("page").alias("page_start"),
            F.col("page").alias("page_end"),
        )
    )


def latest_repairs(repairs: DataFrame, arrival: str) -> DataFrame:
    """Last reading of each page wins."""
    return latest(repairs, ["source_file", "page"], [arrival])


def apply_corrections(
    chunks: DataFrame, patches: DataFrame, fixes: DataFrame, repairs: DataFrame, embedder=embed
) -> DataFrame:
    """Patches, then text fixes, then repairs, after every ingest.

    Chunks: grade, subject, book_title, source_file, chunk_index, text,
    page_start, page_end, id and, as ingest gives them, embedding: every vector
    is then that of its text.
    """

    def alike(rows: DataFrame) -> DataFrame:
        if "embedding" in chunks.columns:
            return rows.withColumn("embedding", embedder(F.col("text")))
        return rows

    patched = upsert(chunks, alike(patch_chunks(patches)), ["id"], ["chunk_index"])
    fixed = apply_text_fixes(patched, fixes, embedder)
    return upsert(fixed, alike(repair_chunks(repairs)), ["id"], ["chunk_index"])
