"""The queries of the operators over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.copies import exact_dedup
from pagewright.llm.divergence import divergence_sql, source_divergence
from pagewright.llm.licenses import license_scan, license_scan_sql
from pagewright.llm.lloyd import cluster_vectors, lloyd_sql
from pagewright.llm.mixing import mix_sources
from pagewright.llm.mtree import nearest_embeddings
from pagewright.llm.near import near_duplicates
from pagewright.llm.packages import ARCHIVE_SQL, archived
from pagewright.llm.packing import checksums, write_blocks
from pagewright.llm.pieces import report_segmentations
from pagewright.llm.secrets import scan_secrets
from pagewright.llm.sharding import shard_documents
from pagewright.llm.toxicity import held_out, score_documents, train
from pagewright.plans.ship import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query(
    sql="""
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT::HUGEINT) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id, score
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """
)
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_embeddings(table(spark, sf_dir, "embeddings"))


@query(sql=license_scan_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query(
    sql=r"""
    WITH hashed AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS digest
        FROM documents
    ), best AS (
        SELECT digest, first(doc_id ORDER BY points DESC, doc_id) AS keep_id, count(*) AS group_size
        FROM hashed GROUP BY digest
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256
    FROM hashed JOIN best USING (digest)
    """
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), carry=False)


@query()
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), carry=False)


@query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "at", "offset", F.sha2("value", 256).alias("value_sha256"), "label", "held_out", "score", "secret"
    )


@query()
def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return checksums(write_blocks(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def piece_report(docs: DataFrame) -> DataFrame:
    """For each row its pieces' number, the scores and checksums of all its N best segmentations
    and whether its text comes back from each of them."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    found = report_segmentations(docs.select("doc_id", "text"), vocabulary)
    return found.select(
        "doc_id",
        F.get("all_sizes", F.lit(0)).alias("n_pieces"),
        F.size("scores").cast("long").alias("n_best"),
        F.get("scores", F.lit(0)).alias("best_score"),
        F.get("scores", F.lit(1)).alias("second_score"),
        F.get("scores", F.size("scores") - 1).alias("last_score"),
        "scores",
        F.get("all_crc32", F.lit(0)).alias("ids_crc32"),
        F.col("all_crc32").alias("all_ids_crc32"),
        F.col("all_back").alias("round_trip"),
    )


@query()
def op9_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(table(spark, sf_dir, "documents"))


@query()
def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), carry=False)


@query(sql=lloyd_sql())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), carry=False)


@query(sql=divergence_sql())
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


@query(sql=ARCHIVE_SQL)
def op13_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )
