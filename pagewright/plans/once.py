"""Working an expensive column out exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with column ``name`` set to ``value``.

    ``withColumn`` only names an expression: a filter and several projections on
    top of it would each evaluate it again.  Exploding a one-element array yields
    the same single row but fixes the value, so later operators only read it.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.explode_outer(F.array(value)).alias(name))
