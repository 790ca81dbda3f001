"""Running values over long ordered groups, without one task per group.

Each function works in two levels.  Rows of a key are cut into buckets of the
order column (``bucket_width`` consecutive values, so at most that many rows
because the order column is unique within a key).  A window runs inside each
bucket, a second window runs over one summary row per bucket, and the two are
joined on (key, bucket), which is how the rows are partitioned already.  A key
holding a third of the data is therefore spread over all of its buckets.
Keys and the order column must not be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagewright.plans.materialize import materialize

BUCKET_WIDTH = 65_536
_B = "__bucket"


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(_B, F.expr(f"`{order}` div {width}"))


def prefix_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = BUCKET_WIDTH
) -> DataFrame:
    """Sum of ``value`` over the rows strictly before each row of its key."""
    rows = _bucketed(df, order, width).withColumn("__value", value)
    inside = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*keys, _B)
        .agg(F.sum("__value").alias("__total"))
        .select(*keys, _B, F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__base"))
    )
    return (
        rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .join(totals, [*keys, _B])
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .drop(_B, "__value", "__inside", "__base")
    )


def last_known(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    include_current: bool = True,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """The latest non-null ``value`` up to each row of its key (or strictly before it)."""
    rows = _bucketed(df, order, width).withColumn("__value", value)
    inside = (
        Window.partitionBy(*keys, _B)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    # Every bucket has a row, also one without any value: it passes the carry on.
    known = F.when(F.col("__value").isNotNull(), F.col(order))
    carried = (
        rows.groupBy(*keys, _B)
        .agg(F.max_by("__value", known).alias("__last"))
        .select(*keys, _B, F.last("__last", ignorenulls=True).over(across).alias("__carry"))
    )
    return (
        rows.withColumn("__inside", F.last("__value", ignorenulls=True).over(inside))
        .join(carried, [*keys, _B])
        .withColumn(out, F.coalesce("__inside", "__carry"))
        .drop(_B, "__value", "__inside", "__carry")
    )


def change_epochs(
    df: DataFrame, keys: list[str], order: str, state: Column, out: str, width: int = BUCKET_WIDTH
) -> DataFrame:
    """How often ``state`` (not null) has changed by each row of its key, starting at 0."""
    rows = _bucketed(df, order, width).withColumn("__state", state)
    inside = Window.partitionBy(*keys, _B).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(_B)
    rows = rows.withColumn(
        "__change",
        F.coalesce((F.col("__state") != F.lag("__state").over(inside)).cast("int"), F.lit(0)),
    )
    buckets = (
        rows.groupBy(*keys, _B)
        .agg(
            F.sum("__change").alias("__changes"),
            F.min_by("__state", order).alias("__first"),
            F.max_by("__state", order).alias("__last"),
        )
        .withColumn(
            "__edge",
            F.coalesce((F.col("__first") != F.lag("__last").over(across)).cast("int"), F.lit(0)),
        )
        .select(
            *keys,
            _B,
            (
                F.sum(F.col("__changes") + F.col("__edge")).over(
                    across.rowsBetween(Window.unboundedPreceding, 0)
                )
                - F.col("__changes")
            ).alias("__base"),
        )
    )
    running = F.sum("__change").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("__inside", running)
        .join(buckets, [*keys, _B])
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .drop(_B, "__state", "__change", "__inside", "__base")
    )


def gapless_rank(df: DataFrame, order: str, out: str) -> DataFrame:
    """Each row's rank, from 0, by ``order`` (unique, of any sortable type) among all rows.

    Rows are dealt into ranges by sampled bounds, so their number in a range does
    not depend on how the values are spread; each range is ranked on its own and
    moved up by the rows of the ranges before, of which there are as many as
    shuffle partitions.
    """
    ranged = df.repartitionByRange(order).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")  # a range's number is drawn once
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("__range")
        .agg(F.count("*").alias("__n"))
        .select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return (
        ranged.withColumn("__inside", inside)
        .join(starts, "__range")
        .withColumn(out, F.col("__start") + F.col("__inside"))
        .drop("__range", "__inside", "__start")
    )
