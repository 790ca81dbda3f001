"""Exact dedup: a tree of merges of sorted digest runs.

Each input partition makes one run: its documents' digests, sorted, with one
entry for each digest.  In round r, runs whose numbers agree after dropping r
digits (base ``FAN_IN``) are merged, as in a binomial tree; an entry keeps the
best document of its digest and the number of rows.  The shuffle of a round is
by (merged run, digest), so a run is spread over all tasks however large it
grows, and a digest that holds a third of all rows brings at most ``FAN_IN``
entries to one key.  On the way back the last run's entries are joined to the
runs of the round before, again at most ``FAN_IN`` rows a key, down to the rows.

An entry is verified: its key is the SHA-256 of the normalised text, that text's
length and a second, independent hash, so entries merge only if all three agree.

Null texts count as empty, and all empty texts are copies of each other.  A null
identifier comes after all others; of rows equal in text and identifier any one
stays.  An empty table gives an empty result.  Columns of the caller that have
the name of an output are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.frames import ROW, SPACE, known, stored, unboxed

#: Runs merged by one merge.
FAN_IN = 8
_KEY = ["digest", "length", "second"]


def normalised(text: str) -> Column:
    return F.regexp_replace(known(text), SPACE + "+", "")


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    ident: str = "doc_id",
    carry: bool = True,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.

    Of equal texts (white space left out) the row with the most code points
    stays, then the one with the smallest identifier.  With ``carry`` off, the
    result has only the identifier and the new columns, and no text is stored.
    """
    plain = normalised(text)
    whole = F.struct("*") if carry else F.struct(F.col(ident))
    rows = docs.select(
        whole.alias(ROW),
        F.col(ident).alias("id"),
        F.char_length(known(text)).alias("points"),
        F.explode(F.array(plain)).alias("plain"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("line"),
    ).select(
        ROW, "id", "points", "run", "line",
        F.unhex(F.sha2("plain", 256)).alias("digest"),
        F.char_length("plain").alias("length"),
        F.xxhash64("plain").alias("second"),
    )
    rows = stored(rows if carry else rows.sortWithinPartitions("digest"), "digests")

    # The best has the smallest of these: longest first, known identifiers first.
    place = F.struct(
        (-F.col("points")).alias("points"), F.col("id").isNull().alias("unknown"), "id", "line"
    )
    levels = [_merged(rows.select("run", *_KEY, place.alias("best"), F.lit(1).cast("long").alias("n")))]
    most = levels[0].agg(F.max("run")).first()[0] or 0
    while most > 0:
        most //= fan_in
        levels.append(_merged(levels[-1].withColumn("run", F.expr(f"run div {fan_in}").cast("int"))))

    answers = levels[-1]
    for below in reversed(levels[:-1]):
        up = answers.withColumnRenamed("run", "up")
        answers = (
            below.select("run", *_KEY, F.expr(f"run div {fan_in}").cast("int").alias("up"))
            .join(up, ["up", *_KEY])
            .drop("up")
        )
    found = rows.join(answers, ["run", *_KEY])
    return unboxed(
        found,
        {
            "keep_id": F.col("best.id"),
            "group_size": F.col("n"),
            "kept": F.col("line") == F.col("best.line"),
            "text_sha256": F.lower(F.hex("digest")),
        },
    )


def _merged(runs: DataFrame) -> DataFrame:
    merged = runs.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return stored(merged.sortWithinPartitions("run", "digest"), "run")
