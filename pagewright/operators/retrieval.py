"""Scoped hybrid retrieval of many questions in one blocked join with the chunks.

A question is only ever compared with chunks of its own subject at or below its
grade.  For each question there is one *vector* pass (nearest chunks) and, when
it carries a search term, *literal* passes (nearest chunks containing a given
text).

Questions and chunks both stay tables.  The questions of a subject, lowest grade
first, are cut into blocks of bounded size, its chunks into salted pieces of
bounded size, and each piece meets each block that holds a question of its grade
or a higher one.  A meeting is one group of a cogroup: a matrix product for the
vectors, one multi-pattern matcher for the terms.  What leaves it are the best
hits of each pass, never question-chunk pairs, and a subject of any size is
spread over as many tasks as it has meetings.  Nothing passes the driver.  Which
literal passes count, grade preference, merging and the cutoff are DataFrame
operations on those hits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright import fixed_values as fv
from pagewright.functions import text as tx

#: Questions of a block, chunks of a piece: what one group holds at once.
QUESTIONS_PER_BLOCK = 8192
CHUNKS_PER_PIECE = 4096
#: Questions of a block whose distances are held at once.
TOGETHER = 512
#: Distances are compared after rounding to this many digits, so that chunks with
#: equal vectors tie exactly and the tie goes to the smaller id.
DISTANCE_DIGITS = 8

TIER_PHRASE = 0
TIER_SHORTER = fv.MAX_NAME_VARIANTS + 1
SLOT_DEFINITION, SLOT_LITERAL, SLOT_VECTOR = 0, 1, 2

_HITS = "qid string, grade int, tier int, slot int, chunk_id {kind}, chunk_grade int, passage string, distance double"
_CELL = ["subject", "__block", "__piece"]


def passage_key(source_file: Column, chunk_index: Column, text: Column) -> Column:
    """What identifies a passage across passes: its place, or its text when unplaced."""
    return F.when(
        source_file.isNotNull() & chunk_index.isNotNull(),
        F.concat(F.lit("at:"), source_file, F.lit("#"), chunk_index.cast("string")),
    ).otherwise(F.concat(F.lit("text:"), F.sha2(text, 256)))


def literal_patterns(phrase: Column) -> Column:
    """array<struct<tier, slot, pattern>> of the texts to look for, most specific tier first."""

    def one(tier: Column, slot: int, pattern: Column) -> Column:
        return F.struct(
            tier.cast("int").alias("tier"), F.lit(slot).alias("slot"), pattern.alias("pattern")
        )

    def both(tier: Column, pattern: Column) -> Column:
        definition = F.concat(pattern, F.lit(fv.DEFINITION_SUFFIX))
        return F.array(one(tier, SLOT_DEFINITION, definition), one(tier, SLOT_LITERAL, pattern))

    variants = F.flatten(
        F.transform(tx.name_variants(phrase), lambda variant, i: both(i + 1, variant))
    )
    shorter = tx.last_two_words(phrase)
    last = F.when(shorter.isNull(), F.slice(both(F.lit(0), phrase), 1, 0)).otherwise(
        F.array(one(F.lit(TIER_SHORTER), SLOT_LITERAL, shorter))
    )
    return F.when(phrase.isNotNull(), F.concat(both(F.lit(TIER_PHRASE), phrase), variants, last))


def prepare_questions(questions: DataFrame, literal: bool = True) -> DataFrame:
    """Questions ready for scoring; blank ones are dropped.

    Input: qid, question, grade, subject, embedding.
    """
    phrase = tx.keyword_phrase(tx.strip(F.col("question"))) if literal else F.lit(None)
    patterns = tx.let(phrase.cast("string"), literal_patterns) if literal else F.lit(None)
    return questions.where(~tx.is_blank(F.col("question"))).select(
        F.col("qid").cast("string").alias("qid"),
        "grade",
        "subject",
        "embedding",
        patterns.cast("array<struct<tier:int,slot:int,pattern:string>>").alias("patterns"),
    )


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks as retrieval reads them: chunk_id, subject, grade, passage, text, embedding.

    What ``ingest`` writes is taken as it is: its id serves as chunk_id, and the
    passage is worked out from place or text where there is none.
    """
    if "chunk_id" not in chunks.columns:
        chunks = chunks.withColumnRenamed("id", "chunk_id")
    if "passage" not in chunks.columns:
        key = passage_key(F.col("source_file"), F.col("chunk_index"), F.col("text"))
        chunks = chunks.withColumn("passage", key)
    return chunks.select("chunk_id", "subject", "grade", "passage", "text", "embedding")


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.reshape(len(column), -1).astype(np.float64))


def _literal_hits(patterns: list, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``texts``, questions, tiers and slots of every literal hit, by one matcher."""
    import ahocorasick

    asked: dict[str, list[tuple[int, int, int]]] = {}
    for question, wanted in enumerate(patterns):
        for p in wanted or []:
            asked.setdefault(p["pattern"], []).append((question, p["tier"], p["slot"]))
    found = []
    if asked:
        matcher = ahocorasick.Automaton()
        for pattern in asked:
            matcher.add_word(pattern, pattern)
        matcher.make_automaton()
        for row, text in enumerate(texts):
            for pattern in {p for _, p in matcher.iter(text)} if text else ():
                found += [(row, *one) for one in asked[pattern]]
    hits = np.array(found, dtype=np.int64).reshape(-1, 4)
    return tuple(hits[np.argsort(hits[:, 1], kind="stable")].T)


def _nearest(groups: np.ndarray, distances: np.ndarray, rows: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` smallest (distance, row) of each group."""
    order = np.lexsort((rows, distances, groups))
    sorted_groups = groups[order]
    first = np.r_[True, sorted_groups[1:] != sorted_groups[:-1]]
    starts = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - starts < keep]


def _meeting(keep: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best hits of every pass of a block of questions in a piece of chunks."""

    def score(asked: pa.Table, chunks: pa.Table) -> pa.Table:
        asked = asked.filter(pa.compute.is_valid(asked["embedding"]))
        chunks = chunks.filter(pa.compute.is_valid(chunks["embedding"])).sort_by("chunk_id")
        if not len(asked) or not len(chunks):
            return _hits(chunks, asked, *[np.zeros(0, np.int64)] * 4, np.zeros(0), names)
        theirs, own = _vectors(chunks["embedding"]), _vectors(asked["embedding"])
        grades = chunks["grade"].to_numpy()
        highest = asked["grade"].to_numpy()
        rows, questions, tiers, slots = _literal_hits(asked["patterns"].to_pylist(), chunks["text"].to_pylist())
        found = []
        for at in range(0, len(asked), TOGETHER):
            # Adding zero turns a negative zero into a plain one.
            away = np.round(1.0 - theirs @ own[at : at + TOGETHER].T, DISTANCE_DIGITS) + 0.0
            away[grades[:, None] > highest[None, at : at + TOGETHER]] = np.inf
            last = min(keep, len(chunks)) - 1
            limit = np.partition(away, last, axis=0)[last]
            row, column = np.nonzero((away <= limit) & (away < np.inf))
            best = _nearest(column, away[row, column], row, keep)
            row, column = row[best], column[best]
            vector = np.full(len(row), SLOT_VECTOR)
            found.append((row, column + at, np.full(len(row), -1), vector, away[row, column]))
            begin, end = np.searchsorted(questions, [at, at + TOGETHER])
            row, column, tier, slot = rows[begin:end], questions[begin:end] - at, tiers[begin:end], slots[begin:end]
            near = away[row, column]
            inside = near < np.inf
            row, column, tier, slot, near = row[inside], column[inside], tier[inside], slot[inside], near[inside]
            best = _nearest((column * (TIER_SHORTER + 1) + tier) * 2 + slot, near, row, keep)
            found.append((row[best], column[best] + at, tier[best], slot[best], near[best]))
        return _hits(chunks, asked, *[np.concatenate(c) for c in zip(*found)], names)

    return score


def _hits(chunks, asked, rows, questions, tiers, slots, distances, names: list[str]) -> pa.Table:
    their, own = pa.array(rows), pa.array(questions)
    columns = [
        asked["qid"].take(own),
        asked["grade"].take(own).cast(pa.int32()),
        pa.array(tiers, pa.int32()),
        pa.array(slots, pa.int32()),
        chunks["chunk_id"].take(their),
        chunks["grade"].take(their).cast(pa.int32()),
        chunks["passage"].take(their),
        pa.array(distances, pa.float64()),
    ]
    return pa.table(columns, names)


def _within_range(grade: str) -> Column:
    """Grades for planning only: those outside the known ones count as the next to them."""
    return F.greatest(F.lit(1), F.least(F.col(grade), F.lit(fv.MAX_GRADE + 1))).cast("int")


def _block_plan(questions: DataFrame, per_block: int) -> DataFrame:
    """For each subject and grade: questions of lower grades, of this one and of all, and the subject's blocks."""
    counted = questions.groupBy("subject", _within_range("grade").alias("g")).agg(F.count("*").alias("n"))
    listed = counted.groupBy("subject").agg(
        F.collect_list(F.struct("g", "n")).alias("__grades"),  # at most one entry for each grade
        F.sum("n").alias("__asked"),
        F.ceil(F.sum("n") / per_block).cast("int").alias("__blocks"),
    )

    def questions_of(grades: Callable[[Column], Column]) -> Column:
        some = F.filter("__grades", lambda entry: grades(entry["g"]))
        return F.aggregate(some, F.lit(0).cast("long"), lambda total, entry: total + entry["n"])

    every = F.explode(F.sequence(F.lit(1), F.lit(fv.MAX_GRADE + 1)))
    return listed.withColumn("__grade", every).select(
        "subject", "__grade", "__asked", "__blocks",
        questions_of(lambda g: g < F.col("__grade")).alias("__before"),
        questions_of(lambda g: g == F.col("__grade")).alias("__here"),
    )


def nearest_per_pass(
    chunks: DataFrame,
    questions: DataFrame,
    keep: int,
    per_scan: int = QUESTIONS_PER_BLOCK,
    per_piece: int = CHUNKS_PER_PIECE,
) -> DataFrame:
    """The ``keep`` nearest chunks of every pass of every question.

    ``chunks``: as :func:`searchable` gives them (text may be NULL when no question
    has literal passes; chunks without vector are skipped, as empty passages
    are).  ``questions`` as returned by :func:`prepare_questions`, ``per_scan``
    of them in a block.
    """
    sizes = chunks.groupBy("subject").agg(F.ceil(F.count("*") / per_piece).cast("int").alias("__pieces"))
    plan = _block_plan(questions, per_scan).join(sizes, "subject")
    # A question's block: its place among those of its subject by grade, drawn inside the grade.
    place = F.col("__before") + F.pmod(F.xxhash64("qid"), F.col("__here"))
    asked = (
        questions.withColumn("__grade", _within_range("grade"))
        .join(plan.where("__here > 0"), ["subject", "__grade"])
        .withColumn("__block", F.floor(place * F.col("__blocks") / F.col("__asked")).cast("int"))
        .withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
        .select(*_CELL, "qid", "grade", "embedding", "patterns")
    )
    first = F.floor(F.col("__before") * F.col("__blocks") / F.col("__asked")).cast("int")
    offered = (
        chunks.withColumn("__grade", _within_range("grade"))
        .join(plan.where("__before < __asked"), ["subject", "__grade"])
        .withColumn("__piece", F.pmod(F.xxhash64("chunk_id"), F.col("__pieces")).cast("int"))
        .withColumn("__block", F.explode(F.sequence(first, F.col("__blocks") - 1)))
        .select(*_CELL, "chunk_id", "grade", "passage", "text", "embedding")
    )
    hits = StructType.fromDDL(_HITS.format(kind=chunks.schema["chunk_id"].dataType.simpleString()))
    out = (
        asked.groupBy(*_CELL)
        .cogroup(offered.groupBy(*_CELL))
        .applyInArrow(_meeting(keep, hits.names), hits)
    )
    ranked = Window.partitionBy("qid", "tier", "slot").orderBy("distance", "chunk_id")
    # One shuffle by question serves every later step, all of which work per question.
    return (
        out.repartition("qid")
        .withColumn("near_rank", F.row_number().over(ranked))
        .where(F.col("near_rank") <= keep)
    )


def prefer_own_grade(hits: DataFrame, limit: int) -> DataFrame:
    """Re-rank each pass by distance plus a small penalty per grade below the asker's."""
    adjusted = F.col("distance") + fv.LOWER_GRADE_PENALTY * F.greatest(
        F.lit(0), F.col("grade") - F.coalesce("chunk_grade", "grade")
    )
    order = Window.partitionBy("qid", "tier", "slot").orderBy("__adjusted", "near_rank")
    return (
        hits.withColumn("__adjusted", F.round(adjusted, DISTANCE_DIGITS))
        .withColumn("pass_rank", F.row_number().over(order))
        .where(F.col("pass_rank") <= limit)
        .drop("__adjusted")
    )


def first_answering_tier(hits: DataFrame) -> DataFrame:
    """Keep the vector pass and the first literal tier that found anything."""
    literal = F.col("slot") != SLOT_VECTOR
    first = F.min(F.when(literal, F.col("tier"))).over(Window.partitionBy("qid"))
    return hits.withColumn("__first", first).where(~literal | (F.col("tier") == F.col("__first"))).drop("__first")


def merge_passes(hits: DataFrame, limit: int) -> DataFrame:
    """Definitions, then literal hits, then nearest ones; a passage counts once."""
    place = ["slot", "pass_rank"]
    once = Window.partitionBy("qid", "passage").orderBy(*place)
    order = Window.partitionBy("qid").orderBy(*place)
    return (
        hits.withColumn("__seen", F.row_number().over(once))
        .where(F.col("__seen") == 1)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .drop("__seen")
    )


def within_distance(hits: DataFrame, cutoff: float) -> DataFrame:
    """Applied last, so literal hits are cut too."""
    return hits.where(F.col("distance") <= cutoff)


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    top_k: int = 10,
    cutoff: float = 1.1,
    literal: bool = True,
    per_scan: int = QUESTIONS_PER_BLOCK,
) -> DataFrame:
    """Passages for every question: qid, rank, chunk_id, passage, distance, tier, slot, ...

    ``chunks``: what ``ingest`` writes, or any table :func:`searchable` accepts.
    """
    prepared = prepare_questions(questions, literal)
    offered = searchable(chunks) if literal else searchable(chunks).withColumn("text", F.lit(None).cast("string"))
    hits = nearest_per_pass(offered, prepared, top_k * fv.OVERFETCH, per_scan)
    ranked = prefer_own_grade(hits, top_k)
    merged = merge_passes(first_answering_tier(ranked) if literal else ranked, top_k)
    return within_distance(merged, cutoff)


def list_subjects(chunks: DataFrame, grades: DataFrame) -> DataFrame:
    """Subjects with a chunk at or below each grade of ``grades`` (column ``grade``).

    A subject is seen from its lowest grade upwards, so each subject gives at
    most one row per grade and an equality join is enough.
    """
    lowest = chunks.where(F.col("subject") != "").groupBy("subject").agg(F.min("grade").alias("__low"))
    seen = lowest.select(
        F.explode(F.sequence(F.col("__low"), F.lit(fv.MAX_GRADE))).alias("grade"), "subject"
    )
    return seen.join(grades.select("grade").distinct(), "grade", "left_semi")


def scope_to_every_subject(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One scoped question per subject the asker's grade may see; qid becomes ``qid|subject``."""
    subjects = list_subjects(chunks, questions)
    offered = subjects.groupBy("grade").agg(F.sort_array(F.collect_list("subject")).alias("__subjects"))
    return (
        # One row per grade, twelve at most.
        questions.drop("subject")
        .join(F.broadcast(offered), "grade")
        .withColumn("subject", F.explode("__subjects"))
        .drop("__subjects")
        .withColumn("asked", F.col("qid").cast("string"))
        .withColumn("qid", F.concat_ws("|", "asked", "subject"))
    )


def best_subject(scoped: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question the subject whose first hit is nearest; the alphabetically first one on a tie."""
    first_rank = F.min("rank").over(Window.partitionBy("qid"))
    tops = (
        hits.withColumn("__first", first_rank)
        .where(F.col("rank") == F.col("__first"))
        .join(scoped.select("qid", "asked", "subject"), "qid")
    )
    return tops.groupBy("asked").agg(
        F.min_by("subject", F.struct("distance", "subject")).alias("subject"),
        F.min("distance").alias("distance"),
    )


def attach_passages(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Fetch the texts and metadata of the hits only, after ranking."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")
