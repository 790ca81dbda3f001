"""Centroid clustering: Lloyd's rounds sharded by dimension.

The components of all vectors stand in a Parquet table with one column for each
block of dimensions.  A task of a block scans that column alone and works out
the exact partial squared distances of its vectors to the centroids' slices of
those dimensions; the partial distances of a vector are added up by its key, and
the smallest sum (then the smallest number) is its cluster.  Back at the shards,
each block sums its own column by cluster, before anything is shuffled, which
gives the block's slice of the next centroids.  A key is given to each row once,
when the table is written, so equal vectors are spread like any others.

All arithmetic is on whole numbers.  Where products fit 53 bits numpy works on
doubles, which are exact there, else on 64-bit integers, else on Python's
integers and decimals; the largest component and the number of rows decide.
Components past 2^57 count as 2^57.  Distances and sums past 64 bits are null.

What passes the driver are the centroids, clusters x dimensions numbers, and one
sum for each cluster, whatever the number of vectors.

Vectors that are null, have another number of components or hold null or
non-finite ones take no part and have no row.  A null identifier is clustered
like any other but comes last among the first centroids; equal identifiers are
ordered by their components.  Fewer vectors than clusters give as many
centroids as vectors, an empty table an empty result.  Columns of the caller
that have the name of an output are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.llm.frames import ROW, stored, unboxed

#: Largest component that is told apart from larger ones.
FARTHEST = 2**57
#: Dimensions of a block.
BLOCK_DIMENSIONS = 32
OUTPUTS = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def lattice_vectors(
    vectors: DataFrame, dimensions: int, scale: int, vector: str, ident: str, block: int, carry: bool
) -> DataFrame:
    """The stored table of usable vectors: the caller's row, key, id, reach and a column for each block."""
    usable = (F.size(vector) == dimensions) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    near = lambda x: F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(float(FARTHEST))), F.lit(-float(FARTHEST)))
    cells = vectors.where(F.coalesce(usable, F.lit(False))).select(
        (F.struct("*") if carry else F.struct(F.col(ident))).alias(ROW),
        F.monotonically_increasing_id().alias("key"),
        F.col(ident).cast("string").alias("id"),
        F.explode(F.array(F.transform(vector, lambda x: F.floor(near(x)).cast("long")))).alias("cells"),
    )
    parts = [
        F.slice("cells", at + 1, min(block, dimensions - at)).alias(f"part{number}")
        for number, at in enumerate(range(0, dimensions, block))
    ]
    reach = F.array_max(F.transform("cells", lambda x: F.abs(x))).alias("reach")
    return stored(cells.select(ROW, "key", "id", reach, *parts), "lattice")


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = 16,
    rounds: int = 3,
    dimensions: int = 64,
    scale: int = 64,
    seed: int = 1,
    vector: str = "embedding",
    ident: str = "vec_id",
    block: int = BLOCK_DIMENSIONS,
    carry: bool = True,
) -> DataFrame:
    """``vectors`` with cluster, distance, cluster_inertia, inertia and centroid_sha256.

    With ``carry`` off the result has only the identifier and the new columns.
    """
    spark = vectors.sparkSession
    table = lattice_vectors(vectors, dimensions, scale, vector, ident, block, carry)
    blocks = [c for c in table.columns if c.startswith("part")]
    rows, reach = table.agg(F.count("*"), F.max("reach")).first()
    if not rows:
        kept = [f for f in table.schema[ROW].dataType.fields if f.name.lower() not in OUTPUTS.replace(",", " ").split()]
        return spark.createDataFrame([], StructType([*kept, *StructType.fromDDL(OUTPUTS).fields]))
    exact = _numbers(dimensions * (2 * reach) ** 2)
    sums = "long" if rows * reach < 2**62 else "decimal(38,0)"

    order = F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256).asc_nulls_last()
    first = table.select("id", "key", *blocks).orderBy(order, *blocks, "key").limit(clusters).collect()
    slices = [[list(r[b]) for r in first] for b in blocks]
    for _ in range(rounds):
        slices = _moved(table, blocks, _assigned(table, blocks, slices, exact), slices, sums)
    assigned = _assigned(table, blocks, slices, exact)

    # One row for each cluster.
    within = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    whole = _long(sum(int(v) for v in within.values()))
    named = [
        (c, _long(int(v)), whole, hashlib.sha256(",".join(str(x) for s in slices for x in s[c]).encode()).hexdigest())
        for c, v in within.items()
    ]
    totals = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = table.select(ROW, "key").join(assigned, "key").join(F.broadcast(totals), "cluster")
    fits = F.col("distance").cast("decimal(38,0)") < F.lit(2**63 - 1).cast("decimal(38,0)")
    outputs: dict[str, Column] = {n: F.col(n) for n in StructType.fromDDL(OUTPUTS).names}
    outputs["distance"] = F.when(fits, F.col("distance")).cast("long")
    return unboxed(found, outputs)


def _long(value: int) -> int | None:
    return value if value < 2**63 else None


def _numbers(largest: int) -> str:
    """What holds distances up to ``largest`` exactly."""
    return "float64" if largest < 2**53 else "int64" if largest < 2**63 else "object"


def _assigned(table: DataFrame, blocks: list[str], slices: list[list[list[int]]], exact: str) -> DataFrame:
    """key, cluster and squared distance of every vector: partial distances of the blocks added up."""
    names = [f"d{c}" for c in range(len(slices[0]))]
    kind = "decimal(38,0)" if exact == "object" else "long"
    schema = ", ".join(["key long", *[f"{n} {kind}" for n in names]])
    partial = None
    for name, centres in zip(blocks, slices):
        own = table.select("key", F.col(name).alias("cells")).mapInArrow(_partial(centres, names, exact), schema)
        partial = own if partial is None else partial.union(own)
    added = partial.groupBy("key").agg(*[F.sum(n).cast(kind).alias(n) for n in names])
    nearest = F.array_min(
        F.array(*[F.struct(F.col(n).alias("distance"), F.lit(c).alias("cluster")) for c, n in enumerate(names)])
    )
    best = added.select("key", F.explode(F.array(nearest)).alias("best"))
    return stored(best.select("key", "best.cluster", "best.distance"), "assigned")


def _partial(centres: list[list[int]], names: list[str], exact: str):
    """Squared distances of a block's slices to the centroids' slices of the same dimensions."""
    kind = {"float64": np.float64, "int64": np.int64, "object": object}[exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centres, dtype=kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("cells").flatten().to_numpy().reshape(batch.num_rows, -1).astype(kind)
            if exact == "object":
                away = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
                found = [pa.array(list(column), pa.decimal128(38, 0)) for column in away.T]
            else:
                away = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
                found = [pa.array(column) for column in away.T.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *found], ["key", *names])

    return run


def _moved(
    table: DataFrame, blocks: list[str], assigned: DataFrame, slices: list[list[list[int]]], sums: str
) -> list[list[list[int]]]:
    """Each block's slice of the next centroids; empty clusters keep theirs."""
    parts = None
    for number, name in enumerate(blocks):
        wide = [F.sum(F.get("cells", F.lit(i)).cast(sums)) for i in range(len(slices[number][0]))]
        own = (
            table.select("key", F.col(name).alias("cells"))
            .join(assigned.select("key", "cluster"), "key")
            .groupBy("cluster")
            .agg(F.count("*").alias("n"), F.array(*[w.cast("decimal(38,0)") for w in wide]).alias("total"))
            .select(F.lit(number).alias("block"), "cluster", "n", "total")
        )
        parts = own if parts is None else parts.union(own)
    moved = [[list(centre) for centre in centres] for centres in slices]
    for row in parts.collect():  # clusters x blocks rows
        moved[row["block"]][row["cluster"]] = [int(t) // row["n"] for t in row["total"]]
    return moved


def lloyd_sql(clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same by plain rounds over whole vectors, for DuckDB."""
    parts = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {dimensions}
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS cluster, v
            FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {clusters})
        )"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
                SELECT r, min(struct_pack(d := d, cluster := cluster)) AS best
                FROM (
                    SELECT r, cluster,
                           list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
                    FROM kept, c{n}
                ) GROUP BY r
            )"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (
                    SELECT c{n}.cluster, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN (
                        SELECT cluster, list(((s - ((s % n) + n) % n) // n)::HUGEINT ORDER BY i) AS v
                        FROM (
                            SELECT a{n}.best.cluster AS cluster, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
                            FROM kept JOIN a{n} USING (r), range(1, {dimensions + 1}) t(i) GROUP BY 1, 2
                        ) GROUP BY cluster
                    ) m USING (cluster)
                )"""
            )
    return f"""
    WITH {", ".join(parts)}, inertias AS (
        SELECT best.cluster AS cluster, sum(best.d) AS inside FROM a{rounds} GROUP BY 1
    )
    SELECT vec_id, i.cluster::INTEGER AS cluster, best.d::BIGINT AS distance, inside::BIGINT AS cluster_inertia,
           (SELECT sum(inside) FROM inertias)::BIGINT AS inertia,
           sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
    FROM kept JOIN a{rounds} USING (r) JOIN inertias i ON i.cluster = best.cluster JOIN c{rounds} USING (cluster)
    """
