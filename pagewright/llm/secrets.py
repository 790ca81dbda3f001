"""Secret scans: candidates by pattern, a random forest to take out the false ones.

A candidate is a run of at least ``SHORTEST`` letters, digits or base64 signs inside a
word, or a value given to a name that is one of a password or token, of any length and
any signs, with and without blanks between; also the password of an address.  A word
can have several, each with its offset and the name nearest before it.  Its features are its length, its mix of characters and the changes
between their kinds, how much of its letters are words of the corpus, the path
of its document, and the words around it.  A random forest learns from labelled
findings which candidates are secrets; all candidates are then scored.

Labelled findings come with the call, as (value, label), or else from rules that
are sure by form alone: a key with a provider's fixed prefix, or a value given to
a name that is one of a password or token, with letters and digits, is a secret; a
placeholder or a digest that is named so is none, nor is, without such a name, a value
without any digit or without any letter or in an address.  A provider's form counts in
an address too.  What no
rule is sure of is left to the forest.  It learns from at most ``SAMPLE`` candidates
of each label, the first by hash, of the documents that are not held out.

The dictionary are the corpus's own words: every word of every document is
counted, and a part of a candidate counts as a word from ``COMMON`` on.

Null texts count as empty and have no candidates; repeated rows repeat theirs.  A
null path counts as an empty one.  Without labelled candidates of both kinds
every candidate gets the label there is, or score 0.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.frames import SPACE, known, stored
from pagewright.plans.once import with_once

SHORTEST, COMMON, SAMPLE, FOLDS = 14, 3, 10_000, 5
TREES, DEPTH, SEED = 20, 6, 7
_RUN = rf"[A-Za-z0-9+/_=\-]{{{SHORTEST},}}"

#: Names that secrets are given to, providers' forms, and marks of what is none.
NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|token|secret|api[-_]?key|access[-_]?key|auth|bearer|credential)s?"
FORMS = (
    r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    r"^gh[pousr]_[0-9A-Za-z]{36}$",
    r"^xox[abprs]-[0-9A-Za-z-]{10,}$",
    r"^sk_live_[0-9A-Za-z]{16,}$",
    r"^AIza[0-9A-Za-z_\-]{35}$",
    r"^glpat-[0-9A-Za-z_\-]{20}$",
)
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your[-_]|x{5,}|(.)\2{5,})"
DIGEST = r"(?i)^(sha[-_]?\d*|md5|commit|checksum|digest|hash|uuid|etag|revision)[:=]?$"
TRIAL_PATH = r"(?i)(test|example|sample|fixture|doc|demo|mock)"

FEATURES = [
    "length", "digits", "capitals", "hexadecimal", "variety", "changes", "consonants",
    "covered", "address", "slashes", "trial_path", "given_name", "assigned", "name_before",
    "digest_before", "plain_before", "plain_after",
]


#: A name of NAMES and what stands between it and its value, with and without blanks.
_NAME = "(?i:" + NAMES.replace("(?i)", "").replace("(", "(?:") + r")[A-Za-z0-9_.\-]{0,30}[\"'`\]]{0,2}"
_GIVEN = r"(?:[=:]{1,3}>?)"
_GIVES, _NAMED, _SIGN = rf"{_NAME}{_GIVEN}[\"'`]?$", rf"{_NAME}$", rf"^{_GIVEN}$"
#: An unquoted value ends where another assignment follows, or with its word.
_VALUE = r".+?(?=[\"'`]?[,;&|?][\"'`]?[A-Za-z_][A-Za-z0-9_.\-]{0,40}[\"'`]?[=:]|[\"'`,;.)\]}>]{0,8}$)"
_SET = (
    rf"({_NAME}{_GIVEN})(?![{{\[(]+[\"'`])(?:(\")([^\"]+)(?=\")|(')([^']+)(?=')|([\"'`]?)({_VALUE}))"
    r"|(://[^:/@]{0,80}:)([^/@]+)(?=@)"
)
#: A run inside a word, its name apart.
_ALONE = rf"(?=[A-Za-z0-9+/_=\-]{{{SHORTEST}}})([+/_=\-]*(?:[A-Za-z_\-]{{2,30}}=+)?)([A-Za-z0-9][A-Za-z0-9+/_=\-]*)"
_MARK, _PUT = "\x1f", "password="
_ASSIGNS = r"([A-Za-z_][A-Za-z0-9_.\-]{0,60})[\"'`\]]{0,2}[=:]{1,3}>?[\"'`]?$"


def candidates(docs: DataFrame, text: str, ident: str, path: str | None) -> DataFrame:
    """(doc, at, offset, word, name, value, before, earlier, after, path) of every candidate."""
    words = F.split(F.translate(known(text), _MARK, "\ufffd"), SPACE + "+")
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    rows = docs.select(F.col(ident).alias("doc"), where.alias("path"), words.alias("words"))
    rows = with_once(rows, "words", F.col("words"))
    near = lambda i, k: F.coalesce(F.when(i + k >= 0, F.get("words", i + k)), F.lit(""))
    given = lambda w, i: (
        (_signed(near(i, -1)) & near(i, -1).rlike(_GIVES))
        | (near(i, -1).rlike(_SIGN) & near(i, -2).rlike(_NAMED))
        | (w.rlike(rf"^{_GIVEN}.") & near(i, -1).rlike(_NAMED))
    ) & ~w.rlike(_SIGN)
    places = F.transform(
        "words",
        lambda w, i: F.when(given(w, i), F.struct(i.alias("i"), F.lit(True).alias("given"))).when(
            w.rlike(_RUN) | (_signed(w) & w.rlike(_SET)), F.struct(i.alias("i"), F.lit(False).alias("given"))
        ),
    )
    around = F.transform(F.filter(places, lambda x: x.isNotNull()), _around)
    found = rows.select("doc", "path", F.explode(around).alias("c")).select("doc", "path", "c.*")
    # The values of a word stand between marks: those given to a name first, then runs outside them.
    put = F.when(F.col("given"), F.lit(_PUT)).otherwise("")
    found = found.withColumn("put", F.length(put))
    first = F.split(F.regexp_replace(F.concat(put, "word"), _SET, rf"$1$2$4$6$8{_MARK}$3$5$7$9{_MARK}"), _MARK)
    marked = F.transform(
        first, lambda x, k: F.when(k % 2 == 1, x).otherwise(F.regexp_replace(x, _ALONE, rf"$1{_MARK}$2{_MARK}"))
    )
    pieces = F.split(F.array_join(marked, _MARK), _MARK)
    found = with_once(found.withColumn("pieces", pieces), "pieces", F.col("pieces"))
    ends = F.aggregate(
        "pieces", F.array(F.lit(0)), lambda e, x: F.concat(e, F.array(F.element_at(e, -1) + F.length(x)))
    )
    found = with_once(found.withColumn("ends", ends), "ends", F.col("ends"))
    found = found.select("*", F.posexplode("pieces").alias("k", "raw")).where("k % 2 = 1")
    name = F.regexp_extract(F.get("pieces", F.col("k") - 1), _ASSIGNS, 1)
    address = F.lower(F.substring_index(F.get("pieces", F.col("k") - 1), "/", -1)).rlike("^[^@]*:$") & F.get(
        "pieces", F.col("k") + 1
    ).startswith("@")
    return found.select(
        "doc", "path", "at", "word", "before", "earlier", "after",
        (F.get("ends", F.col("k")) - F.col("put")).cast("long").alias("offset"),
        F.when(F.col("given") & (F.col("k") == 1), F.coalesce(F.nullif(_name_before(), F.lit("")), name))
        .when(address, F.lit("password"))
        .otherwise(name)
        .alias("name"),
        F.col("raw").alias("value"),
    ).where("value != ''")


def _signed(word: Column) -> Column:
    """Whether a word has a sign that gives a value; names are looked for in no other."""
    return word.contains("=") | word.contains(":")


def _name_before() -> Column:
    """The name in the words before a value."""
    both = F.concat("earlier", F.lit(" "), "before")
    return F.regexp_extract(both, r"([A-Za-z_][A-Za-z0-9_.\-]{0,60})[\"'`\]]{0,2} ?(?:[=:]{1,3}>?)?[\"'`]?$", 1)


def _around(x: Column) -> Column:
    i = x["i"]
    near = lambda k: F.coalesce(F.when(i + k >= 0, F.get("words", i + k)), F.lit(""))
    return F.struct(
        i.cast("long").alias("at"), x["given"].alias("given"), near(0).alias("word"), near(-1).alias("before"),
        near(-2).alias("earlier"), near(1).alias("after"),
    )


def _parts(value: str) -> Column:
    """Runs of at least three letters, cut where capitals begin, in lower case."""
    return F.transform(
        F.regexp_extract_all(value, F.lit(r"[A-Z]?[a-z]{2,}[a-z]|[A-Z]{3,}"), F.lit(0)), lambda p: F.lower(p)
    )


def dictionary(docs: DataFrame, text: str, parts: DataFrame) -> DataFrame:
    """The ``parts`` (part) that are words of the corpus, from ``COMMON`` occurrences on."""
    words = F.explode(F.regexp_extract_all(F.lower(known(text)), F.lit("[a-z]{3,}"), F.lit(0)))
    counted = docs.select(words.alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= COMMON).join(parts.distinct(), "part", "left_semi").select("part")


def with_features(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Candidates with ``FEATURES``."""
    keyed = stored(found.withColumn("key", F.xxhash64("value")), "candidates")
    parts = keyed.select("key", "value").distinct().select("key", "value", F.explode(_parts("value")).alias("part"))
    parts = stored(parts, "parts")
    words = dictionary(docs, text, parts.select("part"))
    covered = parts.join(words, "part").groupBy("key", "value").agg(F.sum(F.length("part")).alias("letters"))
    rows = keyed.join(covered, ["key", "value"], "left").drop("key")
    long = F.greatest(F.length("value"), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / long
    kinds = (
        r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[+/_=-])"
    )
    names = F.col("before").rlike(NAMES) | F.col("earlier").rlike(NAMES)
    flag = lambda c: c.cast("double")
    plain = r"^[A-Za-z]+[.,;:!?]?$"
    return rows.select(
        *found.columns,
        F.length("value").cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"),
        share("[0-9a-fA-F]").alias("hexadecimal"),
        (F.size(F.array_distinct(F.split("value", ""))) / long).alias("variety"),
        share(kinds).alias("changes"),
        share("(?i)[bcdfghjklmnpqrstvwxz]{4}").alias("consonants"),
        (F.coalesce("letters", F.lit(0)) / long).alias("covered"),
        flag(F.col("word").rlike(r"@|://|www\.")).alias("address"),
        share("/").alias("slashes"),
        flag(F.col("path").rlike(TRIAL_PATH)).alias("trial_path"),
        flag(F.col("name").rlike(NAMES)).alias("given_name"),
        flag((F.col("name") != "") | F.col("before").rlike("[=:]$")).alias("assigned"),
        flag(names).alias("name_before"),
        flag(F.col("before").rlike(DIGEST) | F.col("earlier").rlike(DIGEST)).alias("digest_before"),
        flag(F.col("before").rlike(plain)).alias("plain_before"),
        flag(F.col("after").rlike(plain)).alias("plain_after"),
    )


def sure_label() -> Column:
    """1 or 0 where the form alone decides, else null."""
    formed = F.lit(False)
    for form in FORMS:
        formed = formed | F.col("value").rlike(form)
    named = (F.col("given_name") == 1) | ((F.col("name_before") == 1) & (F.col("assigned") == 1))
    never = F.col("value").rlike(PLACEHOLDER) | ((F.col("digest_before") == 1) & (F.col("hexadecimal") == 1))
    mixed = (F.col("digits") > 0) & F.col("value").rlike("[A-Za-z]")
    own_address = F.col("value").rlike(r"://|www\.|^[^@]+@[A-Za-z0-9\-]+\.[A-Za-z.]+$")
    return (
        F.when(never, 0.0)
        .when(formed, 1.0)
        .when(named, F.when(mixed & ~own_address, 1.0))
        .when(~mixed | (F.col("address") == 1), 0.0)
    )


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    text: str = "text",
    ident: str = "doc_id",
    path: str | None = "source",
    sample: int = SAMPLE,
) -> DataFrame:
    """Every candidate: the identifier, at (its place among the words, from 0), offset (in the word), word, value, label
    (of the labelled, else null), held_out, score (0 to 1) and secret (from 0.5 on)."""
    kept_out = F.coalesce(F.crc32(F.col("doc").cast("string")) % FOLDS == 0, F.lit(False))
    found = with_features(candidates(docs, text, ident, path), docs, text)
    if findings is None:
        found = found.withColumn("label", sure_label())
    else:
        given = findings.groupBy("value").agg(F.max("label").cast("double").alias("label"))
        found = found.join(given, "value", "left")
    found = stored(found.withColumn("held_out", kept_out), "features")
    turn = [F.xxhash64("value", "doc", "at", "offset"), F.col("value"), F.col("doc"), F.col("at"), F.col("offset")]
    of = lambda label: found.where(F.col("label") == label).where(~F.col("held_out")).orderBy(*turn).limit(sample)
    taken = stored(of(0.0).unionByName(of(1.0)).select("label", *FEATURES), "labelled")
    seen = sorted(r["label"] for r in taken.select("label").distinct().collect())
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="__features")
    if len(seen) < 2:
        scored = found.withColumn("score", F.lit(seen[0] if seen else 0.0))
    else:
        forest = RandomForestClassifier(
            labelCol="label", featuresCol="__features", numTrees=TREES, maxDepth=DEPTH, seed=SEED
        ).fit(assembled.transform(taken))
        forest.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__odds")
        scored = forest.transform(assembled.transform(found)).withColumn("score", vector_to_array("__odds")[1])
    return scored.select(
        F.col("doc").alias(ident), "at", "offset", "word", "value", F.col("label").cast("int").alias("label"), "held_out",
        "score", (F.col("score") >= 0.5).alias("secret"),
    )
