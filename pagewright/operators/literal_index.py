"""An inverted index of word positions, and the chunks that contain a text.

A text contains a phrase of several words when some place has, one after
another, a word that ends with the phrase's first one, the words between, and a
word that begins with its last one; a phrase of one word is contained in a word.
Words are what stands between single blanks, so this is exactly ``contains``.

The index is two tables: postings (subject, word, chunk, position, and the words
before and after) and the vocabulary (subject, word, places).  Postings are
written where the chunk is, without a shuffle, and all lookups are joins of them
with what the phrases ask for, on a word or on its first or last letters:

* a phrase of one word with every run of one to three letters of a word;
* one of two words with the last letters of a word, the next one is looked at;
* one of three with its inner word, both neighbours are looked at;
* a longer one likewise with its rarest inner word, and the few places left with
  the postings at the other positions.

All are equality joins; no text is read.  Phrases are few beside the postings, so
they are broadcast and a chunk's many places for one phrase become one row
before anything is shuffled.  The runs of letters of frequent words, at most
``HOT_WORDS``, are worked out once from the vocabulary, not at each place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.plans.materialize import materialize

#: Letters by which outer words of a phrase are looked up, at most.
KEY_LETTERS = 3
#: Frequent words are those with more than one in so many places.
HOT_WORDS = 100_000


@dataclass(frozen=True)
class LiteralIndex:
    postings: DataFrame
    vocabulary: DataFrame


def build_index(chunks: DataFrame, path: str | None = None) -> LiteralIndex:
    """The index of chunks (chunk_id, subject, text), stored at ``path`` or in the scratch folder."""
    words = chunks.where(F.col("text").isNotNull()).select(
        "subject", "chunk_id", F.split("text", " ", -1).alias("words")
    )
    at = F.col("position")
    postings = (
        words.select("subject", "chunk_id", "words", F.posexplode("words").alias("position", "word"))
        .where("word <> ''")
        .select(
            "subject", "word", "chunk_id", "position",
            F.get("words", at - 1).alias("before"), F.get("words", at + 1).alias("after"),
        )
    )
    if path is None:
        postings = materialize(postings, "postings")
        return LiteralIndex(postings, materialize(_vocabulary(postings), "vocabulary"))
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    stored = chunks.sparkSession.read.parquet(f"{path}/postings")
    _vocabulary(stored).write.mode("overwrite").parquet(f"{path}/vocabulary")
    return read_index(chunks.sparkSession, path)


def _vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("subject", "word").agg(F.count("*").alias("places"))


def read_index(spark: SparkSession, path: str) -> LiteralIndex:
    return LiteralIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"))


def _last_letters(word: Column) -> Column:
    """The keys a word is listed under by its end: its last one to three letters."""
    size = F.length(word)
    return F.array(*[F.when(size >= n, F.substring(word, size - n + 1, F.lit(n))) for n in range(1, KEY_LETTERS + 1)])


def _runs(words: DataFrame) -> DataFrame:
    """``words`` with key, each run of one to three letters of the word."""
    at, size = F.col("__at"), F.length("word")
    runs = F.array(*[F.when(at + n - 1 <= size, F.substring("word", at, F.lit(n))) for n in range(1, KEY_LETTERS + 1)])
    placed = words.select("*", F.explode(F.sequence(F.lit(1), size)).alias("__at"))
    return placed.select("*", F.explode(runs).alias("key")).drop("__at")


def _words_holding(words: DataFrame, parts: DataFrame) -> DataFrame:
    """``words`` with number, for every one of ``parts`` the word contains; some repeatedly."""
    return _runs(words).join(parts, ["subject", "key"]).where(F.contains("word", "part")).drop("key", "part")


def _one_word(index: LiteralIndex, parts: DataFrame) -> DataFrame:
    """number, chunk_id of phrases of one word (number, subject, part)."""
    size = F.least(F.lit(KEY_LETTERS), F.length("part"))
    parts = materialize(parts.withColumn("key", F.substring(F.col("part"), F.lit(1), size)), "single-words")
    every = index.vocabulary.agg(F.sum("places")).first()[0] or 0
    hot = materialize(index.vocabulary.where(F.col("places") * HOT_WORDS > every).select("subject", "word"), "hot-words")
    known = materialize(_words_holding(hot, parts).distinct(), "hot-matches")
    keys = ["subject", "word"]
    places = index.postings.select(*keys, "chunk_id")
    often = places.join(known, keys)
    seldom = _words_holding(places.join(F.broadcast(hot), keys, "left_anti"), parts)
    return often.select("number", "chunk_id").unionByName(seldom.select("number", "chunk_id"))


def _two_words(index: LiteralIndex, phrases: DataFrame) -> DataFrame:
    """number, chunk_id of phrases of two words (number, subject, words)."""
    first, size = F.col("words")[0], F.least(F.lit(KEY_LETTERS), F.length(F.col("words")[0]))
    keyed = phrases.select(
        "number", "subject", first.alias("first"), F.col("words")[1].alias("second"),
        F.substring(first, F.length(first) - size + 1, size).alias("key"),
    )
    places = index.postings.where("after <> ''").select("subject", "chunk_id", "word", "after")
    listed = places.select("*", F.explode(_last_letters(F.col("word"))).alias("key"))
    fits = F.endswith("word", "first") & F.startswith("after", "second")
    return listed.join(materialize(keyed, "two-words"), ["subject", "key"]).where(fits).select("number", "chunk_id")


def _more_words(index: LiteralIndex, phrases: DataFrame) -> DataFrame:
    """number, chunk_id of phrases of three or more words (number, subject, words)."""
    n, at = F.col("n"), F.col("at")
    side = F.when(at == 0, "ends").when(at == n - 1, "begins").otherwise("whole")
    parts = phrases.select(
        "number", "subject", "words", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")
    ).withColumn("side", side)
    # The rarest inner word of each phrase all of whose inner words occur.
    phrase = Window.partitionBy("number")
    rarest = (
        parts.where("side = 'whole'")
        .join(index.vocabulary, ["subject", "word"])
        .withColumn("__parts", F.count("*").over(phrase))
        .withColumn("__turn", F.row_number().over(phrase.orderBy("places", "at")))
        .where("__parts = n - 2 AND __turn = 1")
    )
    anchors = rarest.select(
        "number", "subject", "word", "n", "at", F.col("words")[at - 1].alias("left"), F.col("words")[at + 1].alias("right")
    )
    fits = F.when(at == 1, F.endswith("before", "left")).otherwise(F.col("before") == F.col("left")) & F.when(
        at == n - 2, F.startswith("after", "right")
    ).otherwise(F.col("after") == F.col("right"))
    places = index.postings.join(materialize(anchors, "inner-words"), ["subject", "word"]).where(fits)
    # Of longer phrases: what stands where the words further away have to stand.
    start = (F.col("position") - at).alias("start")
    longer = places.where("n > 3").select("number", "n", F.col("at").alias("anchor"), "subject", "chunk_id", start)
    others = parts.select("number", "at", F.col("word").alias("part"), "side")
    needed = longer.distinct().join(others, "number").where("abs(at - anchor) > 1")
    needed = materialize(needed.withColumn("position", F.col("start") + at), "phrase-places")
    fits = (
        F.when(F.col("side") == "ends", F.endswith("word", "part"))
        .when(F.col("side") == "begins", F.startswith("word", "part"))
        .otherwise(F.col("word") == F.col("part"))
    )
    there = index.postings.select("subject", "chunk_id", "position", "word")
    standing = (
        needed.join(there, ["subject", "chunk_id", "position"])
        .where(fits)
        .groupBy("number", "chunk_id", "start", "n")
        .agg(F.count("*").alias("found"))
        .where("found = n - 3")
    )
    return places.where("n = 3").select("number", "chunk_id").unionByName(standing.select("number", "chunk_id"))


def containing(index: LiteralIndex, patterns: DataFrame) -> DataFrame:
    """pattern_id and chunk_id of every chunk whose text contains the pattern.

    ``patterns``: pattern_id, subject, pattern (not empty, single blanks between
    its words).
    """
    asked = patterns.where(F.col("pattern") != "").select(
        F.monotonically_increasing_id().alias("number"), "pattern_id", "subject",
        F.split("pattern", " ", -1).alias("words"),
    )
    asked = materialize(asked, "patterns")  # numbers are drawn once
    phrases = asked.drop("pattern_id")
    n = F.size("words")
    found = (
        _one_word(index, phrases.where(n == 1).select("number", "subject", F.col("words")[0].alias("part")))
        .unionByName(_two_words(index, phrases.where(n == 2)))
        .unionByName(_more_words(index, phrases.where(n > 2)))
        .distinct()
    )
    return found.join(asked.select("number", "pattern_id"), "number").select("pattern_id", "chunk_id")
