"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents should have on average.  The whole part is given to all of them; the
fractions are rounded together.  Two documents meet, words are moved from one to
the other, in one of the two directions and by as much as makes one fraction
whole (0 or 1), at odds that leave both expectations as they were.  The one that
is still fractional meets the next.  Since what moves is words, not copies, the
words of a source stay exactly on target up to its very last residual, so a
source misses its target by less than the words of one document.  Documents meet
from the longest to the shortest: like sizes settle each other, and what is left
over at the end is short.

The meetings form a reduction tree: documents of a source are dealt by hash over
leaves of about ``LEAF`` documents, each leaf leaves at most one residual, and
residuals meet ``FAN_IN`` leaves at a time until one is left, which is drawn.  A
source that holds most of the rows has more leaves, not larger ones.  Draws are
seeded by source and leaf, and documents of one length meet in the order of a seeded hash, so
the same rows and seed give the same mix.

Rows with equal identifier, source and text are decided together.  Documents
without words are never taken: null and empty texts have size 0.  A null source
is a source of its own, after all others.  An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.frames import ROW, boxed, stored, unboxed, word_count

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the documents, and most copies of a source's words.
SHARE, MOST = 1.5, 2.0
LEAF, FAN_IN, SEED = 8_192, 64, 20


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row for each source of ``sizes`` (source, size): place, source_size, documents, target, rate.

    Sources are placed by code point, null last.  ``share`` of all words is dealt
    by weight; a target stops at ``most`` times its source's words and the excess
    is dealt again, until no target is above.  ``rate`` is copies per document.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())  # over one row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    sources = stored(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
        .withColumn("place", F.row_number().over(place) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * most),
        "sources",
    )
    words, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (words or 0)
    level, full = (budget / free if free else 0.0), -1
    while True:
        at_most = F.col("most") <= F.col("weight") * level
        held, rest, now = sources.agg(
            F.coalesce(F.sum(F.when(at_most, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_most, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(at_most, 1)),
        ).first()
        if now == full or not rest:
            break
        level, full = max(level, (budget - held) / rest), now
    at_most = F.col("most") <= F.col("weight") * level
    return sources.select(
        "source", "place", "source_size", "documents",
        F.when(at_most, F.col("most")).otherwise(F.col("weight") * level).alias("target"),
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .when(at_most, F.lit(float(most)))
        .otherwise(F.col("weight") * level / F.col("source_size"))
        .alias("rate"),
    )


def _settle(mass: np.ndarray, share: np.ndarray, draw: np.random.Generator, last: bool) -> np.ndarray:
    """Fractions after all have met in turn: 0 or 1, but for at most one of them."""
    share, kept = share.copy(), -1
    chances = draw.random(len(share) + 1)
    for i in range(len(share)):
        b, w = share[i], mass[i]
        if b <= 0.0 or b >= 1.0:
            continue
        if kept < 0:
            kept = i
            continue
        a, v = share[kept], mass[kept]
        up_a, up_b = (1.0 - a) * v, b * w  # words from b to a until one is whole
        down_a, down_b = a * v, (1.0 - b) * w
        up, down = min(up_a, up_b), min(down_a, down_b)
        if chances[i] * (up + down) < down:
            a, b = (1.0 if up_a <= up_b else a + up / v), (0.0 if up_b <= up_a else b - up / w)
        else:
            a, b = (0.0 if down_a <= down_b else a - down / v), (1.0 if down_b <= down_a else b + down / w)
        share[kept], share[i] = a, b
        kept = kept if 0.0 < a < 1.0 else i if 0.0 < b < 1.0 else -1
    if last and kept >= 0:
        share[kept] = float(chances[-1] < share[kept])
    return share


def _met(units: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """The units with ``share`` after the meetings of their (place, leaf)."""

    def meet(key, rows):
        by = [rows[c].to_numpy() for c in ("text_hash", "turn", "mass")]
        order = np.lexsort((by[0], by[1], -by[2]))
        rows = rows.take(pa.array(order))
        draw = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
        settled = _settle(rows["mass"].to_numpy().astype(float), rows["share"].to_numpy(), draw, last)
        return rows.set_column(rows.schema.get_field_index("share"), "share", pa.array(settled))

    return units.groupBy("place", "leaf").applyInArrow(meet, units.schema)


def pivotal_copies(units: DataFrame, leaves: int, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """``units`` with ``share`` rounded to 0 or 1 so that each place keeps its words.

    ``units`` has id, place, text_hash, turn, leaf, mass (above 0) and share.
    """
    done, level = [], 0
    while True:
        last = leaves <= 1
        now = stored(_met(units, seed, level, last), "met")
        open_ = (F.col("share") > 0) & (F.col("share") < 1)
        done.append(now.where(~open_))
        if last:
            break
        units = now.where(open_).withColumn("leaf", F.expr(f"leaf div {fan_in}"))
        leaves, level = -(-leaves // fan_in), level + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    ident: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies times size)."""
    whole = ["__id", "__source", "__hash"]
    rows = boxed(
        docs, __id=F.col(ident), __source=F.col(source), __hash=F.xxhash64(text), __size=word_count(text)
    )
    narrow = stored(
        rows.groupBy(*whole, "__size").agg(F.count("*").alias("repeats")).select(
            F.col("__id").alias("id"), F.col("__source").alias("source"), F.col("__hash").alias("text_hash"),
            F.col("__size").alias("size"), "repeats",
        ),
        "sizes",
    )
    each = narrow.select("source", F.explode(F.expr("array_repeat(size, cast(repeats as int))")).alias("size"))
    targets = stored(source_targets(each, weights, share, most), "targets")
    at = targets.select(F.col("source").alias("its"), "place", "source_size", "target", "rate", "documents")
    placed = narrow.join(at, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    units = placed.where("size > 0").select(
        "id", "place", "text_hash",
        F.xxhash64(F.lit(seed), "id", "text_hash").alias("turn"),
        F.pmod(F.xxhash64("text_hash", "id", F.lit(seed)), F.ceil(F.col("documents") / LEAF)).cast("long").alias("leaf"),
        (F.col("size") * F.col("repeats")).cast("double").alias("mass"),
        (F.col("rate") - F.floor("rate")).alias("share"),
    )
    leaves = targets.agg(F.ceil(F.max("documents") / LEAF)).first()[0] or 1
    rounded = pivotal_copies(units, int(leaves), seed).select(
        "id", "place", "text_hash", F.round("share").cast("int").alias("more")
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    settled = placed.alias("p").join(
        rounded.alias("r"),
        same("p.id", "r.id") & same("p.place", "r.place") & same("p.text_hash", "r.text_hash"),
        "left",
    ).select(
        "p.id", "p.source", "p.text_hash", "p.size", "p.source_size", "p.target",
        F.when(F.col("p.size") > 0, F.floor("p.rate").cast("int") + F.coalesce("r.more", F.lit(0)))
        .otherwise(0).alias("copies"),
    )
    found = rows.select(ROW, *whole).join(
        settled, same("__id", "id") & same("__source", "source") & same("__hash", "text_hash")
    )
    return unboxed(
        found,
        {
            "size": F.col("size"),
            "source_size": F.col("source_size"),
            "target": F.col("target"),
            "copies": F.col("copies"),
            "taken": (F.col("copies") * F.col("size")).cast("long"),
        },
    )


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row as often as it has copies, in ``columns``."""
    times = F.explode(F.expr("array_repeat(0, copies)"))
    return mixed.withColumn("__copy", times).select(*[F.col(f"`{c}`") for c in columns])
