"""Documents with every odd case the operators have to stand."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use themselves, or return.
    "__row string, id string, size string, score string, kept string, line string, run string, n string, label string"
)
EXTRA = ("x",) * 9
LONG = "word " * 40_000 + "end"

ROWS = [
    (1, "the same text of six words", "en", "a", 26, *EXTRA),
    (2, "the same text of six words", "en", "a", 26, *EXTRA),
    (2, "the same text of six words", "en", "a", 26, *EXTRA),  # a repeated row
    (3, "the same  text\nof six words ", "en", "b", 28, *EXTRA),
    (None, "the same text of six words", None, None, None, *EXTRA),
    (4, None, "en", "b", 0, *EXTRA),
    (5, "", "en", "b", 0, *EXTRA),
    (6, " \t\n", None, "c", 3, *EXTRA),
    (7, LONG, "en", "c", len(LONG), *EXTRA),
    (8, "ÄÖÜ ß 日本語 \U0001f600 naïve", "de", None, 20, *EXTRA),
    (9, "one", "en", "c", 3, *EXTRA),
    (-5, "x" * 3_000, "en", "c", 3_000, *EXTRA),
]


def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
