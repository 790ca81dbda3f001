"""The stored chunk index, changed in place one (grade, subject) partition at a time.

A change first finds the partitions it touches by reading keys alone.  Those
partitions are read, worked over and written to the shared scratch folder, and
then replace their old files by a dynamic partition overwrite, which Spark puts
into place when the job commits.  Files of all other partitions are neither read
nor written.  A partition that loses its last chunk keeps one row without id,
which readers leave out, since an overwrite cannot take a partition away.

The touched partitions are constants of the plan: there is one for each grade
and subject that has books, whatever the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.operators import index as ix
from pagewright.operators.embedding import embed
from pagewright.plans.materialize import materialize
from pagewright.sources.tables import write_chunks

SCOPE = ["grade", "subject"]
CHUNKS = (
    "id string, book_title string, source_file string, chunk_index int, text string, page_start int, page_end int, "
    "embedding array<float>, grade int, subject string"
)


class IndexTable:
    """Chunks at ``path``, laid out by grade and subject."""

    def __init__(self, spark: SparkSession, path: str, schema: str = CHUNKS, embedder=embed) -> None:
        self.spark, self.path, self.embedder = spark, path, embedder
        self.schema = StructType.fromDDL(schema)

    def create(self, chunks: DataFrame) -> None:
        write_chunks(self._alike(chunks), self.path)

    def chunks(self) -> DataFrame:
        """All chunks; fails when there is no table."""
        return self._stored().where(F.col("id").isNotNull())

    def exists(self) -> bool:
        try:
            self._stored()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise
        return True

    def upsert(self, incoming: DataFrame) -> None:
        """Insert chunks or replace those of the same id; of several, that with the greatest index stays."""
        fresh = materialize(ix.latest(self._alike(incoming), ["id"], ["chunk_index"]), "incoming-chunks")
        self._rewrite(fresh, lambda part: ix.upsert(part, fresh, ["id"], ["chunk_index"]))

    def delete(self, ids: DataFrame) -> None:
        """Remove the chunks with these ids (column ``id``)."""
        gone = materialize(ids.select("id").distinct(), "deleted-ids")
        touched = self.chunks().select("id", *SCOPE).join(gone, "id", "left_semi")
        self._rewrite(touched, lambda part: ix.delete(part, gone, ["id"]))

    def fix_texts(self, fixes: DataFrame) -> None:
        """Replace misread text; corrected chunks get their new id and vector."""
        fixes = materialize(fixes, "text-fixes")
        keys = ["source_file", "chunk_index"]
        touched = self.chunks().select(*keys, *SCOPE).join(fixes.select(*keys), keys, "left_semi")
        self._rewrite(touched, lambda part: ix.apply_text_fixes(part, fixes, self.embedder))

    def correct(self, patches: DataFrame, fixes: DataFrame, repairs: DataFrame) -> None:
        """Patches, then text fixes, then repairs, as after an ingest."""
        self.upsert(ix.patch_chunks(patches).withColumn("embedding", self.embedder(F.col("text"))))
        self.fix_texts(fixes)
        self.upsert(ix.repair_chunks(repairs).withColumn("embedding", self.embedder(F.col("text"))))

    def _alike(self, chunks: DataFrame) -> DataFrame:
        return chunks.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _rewrite(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        scopes = [tuple(r) for r in touched.select(*SCOPE).distinct().collect()]
        if not scopes:
            return
        inside = reduce(or_, [(F.col("grade") == g) & (F.col("subject") == s) for g, s in scopes])
        changed = materialize(self._alike(change(self.chunks().where(inside))), "changed-chunks")
        left = {tuple(r) for r in changed.select(*SCOPE).distinct().collect()}
        emptied = [s for s in scopes if s not in left]
        if emptied:
            names = self.schema.names
            rows = [tuple(dict(zip(SCOPE, s)).get(n) for n in names) for s in emptied]
            changed = changed.unionByName(self.spark.createDataFrame(rows, self.schema))
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SCOPE).parquet(self.path)
