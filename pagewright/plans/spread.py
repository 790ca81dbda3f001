"""Using all task slots when an input arrives in very few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame) -> DataFrame:
    """Repartition a table that has fewer files than there are task slots; leave all others alone.

    A single small file with one row group is read by one task however many
    slots there are.  Tables of as many files as slots, as any large one is, are
    returned unchanged and pay no shuffle.  Only the list of files is looked at.
    """
    slots = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(slots) if len(table.inputFiles()) < slots else table
