"""Small helpers the operators share: whole rows in one column, scratch tables, gapless ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.plans.materialize import materialize

#: What separates words: ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: The caller's row inside an operator.  Names of the operator's own columns
#: stand beside it, so no column of the caller can clash with them.
ROW = "__row"


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``df``, each whole in column ``__row``, beside ``columns``."""
    return df.select(F.struct("*").alias(ROW), *[c.alias(n) for n, c in columns.items()])


def unboxed(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """The caller's columns and ``outputs``; an output replaces a caller's column of its name."""
    taken = {n.lower() for n in outputs}
    rest = [c for c in df.schema[ROW].dataType.names if c.lower() not in taken]
    return df.select(
        *[F.col(ROW).getField(c).alias(c) for c in rest], *[c.alias(n) for n, c in outputs.items()]
    )


def aside(df: DataFrame, **columns: Column) -> DataFrame:
    """Like ``boxed``, with each of the caller's columns as ``__0``, ``__1`` and so on."""
    own = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(df.columns)]
    return df.select(*own, *[c.alias(n) for n, c in columns.items()])


def restored(df: DataFrame, names: list[str], outputs: dict[str, Column]) -> DataFrame:
    """What ``aside`` put aside under its ``names``, and ``outputs``, which replace columns of their names."""
    taken = {n.lower() for n in outputs}
    rest = [F.col(f"__{i}").alias(c) for i, c in enumerate(names) if c.lower() not in taken]
    return df.select(*rest, *[c.alias(n) for n, c in outputs.items()])


def schema_of(rows: DataFrame, names: list[str], more: str) -> StructType:
    """The columns ``names`` of ``rows``, then those of ``more``, as a function's result."""
    return StructType([rows.schema[n] for n in names] + StructType.fromDDL(more).fields)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there."""
    return materialize(df, f"llm-{name}")


def known(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(known(text), F.lit(WORD)).cast("long")


def pieces_of(rows: int, per_piece: int) -> int:
    """How many pieces of about ``per_piece`` rows ``rows`` make; at least one."""
    return max(1, -(-rows // per_piece))


def rank_within(
    df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, per_bucket: int = 20_000
) -> DataFrame:
    """``df`` with ``out``: the gapless rank, from 0, of each row among those of its keys.

    Rows are cut into hashed buckets of about ``per_bucket`` rows, ranked inside
    them, and moved up by the rows of the buckets before, so a key that holds any
    share of all rows is still spread.  Rows come in the order of (bucket,
    ``order``).  Keys are not null; rows equal in ``order`` follow one another.
    """
    bucket = f"{out}__bucket"
    cut = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(pieces_of(rows, per_bucket))).cast("int"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, bucket)
        .agg(F.count("*").alias(f"{out}__n"))
        .select(*keys, bucket, F.coalesce(F.sum(f"{out}__n").over(before), F.lit(0)).alias(f"{out}__start"))
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        cut.withColumn(f"{out}__inside", F.row_number().over(inside) - 1)
        .join(starts, [*keys, bucket])
        .withColumn(out, (F.col(f"{out}__start") + F.col(f"{out}__inside")).cast("long"))
        .drop(bucket, f"{out}__start", f"{out}__inside")
    )
