"""A corpus from raw documents to token pieces, one operator after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.copies import exact_dedup
from pagewright.llm.frames import stored
from pagewright.llm.mixing import expand, mix_sources
from pagewright.llm.near import near_duplicates
from pagewright.llm.queries import piece_report, table
from pagewright.llm.toxicity import score_documents, train
from pagewright.plans.ship import ship_package


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    ship_package(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs).where("kept").select(*docs.columns)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship_package(spark)
    return near_duplicates(docs).where("kept").select(*docs.columns)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship_package(spark)
    return expand(mix_sources(docs), docs.columns)


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A report on the pieces of every row of the mix."""
    ship_package(spark)
    return piece_report(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("near_dedup", _near_dedup),
    ("mix_sources", _mix),
    ("piece_segmentation", _pieces),
]

#: Classification, rounding by chance and segmentation have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
