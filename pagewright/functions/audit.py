"""Detectors for the damage text recognition leaves on a page."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions.text import collapse, let, strip

ISSUES_TYPE = "array<struct<kind:string,explanation:string,snippet:string>>"

EXPLANATIONS = {
    fv.KIND_SWAPPED_MINUS: "Phép trừ không giao hoán: dấu nhân có thể bị đọc thành dấu trừ.",
    fv.KIND_FRACTION: "Định nghĩa phân số nhưng không còn gạch ngang.",
    fv.KIND_DEFINITION_BOX: "Câu định nghĩa trong khung có thể đã bị bỏ qua.",
    fv.KIND_LOST_EXPONENT: "Nhiều chữ cái có ? hoặc * theo sau: số mũ có thể bị mất.",
    fv.KIND_DIGIT_WORD: "Nhiều từ bị lẫn chữ số.",
    fv.KIND_GARBLED: "Quá nhiều ký tự lạ trên trang.",
}


def has_formula(col: Column) -> Column:
    return col.rlike("(?U)" + fv.FORMULA_MARKERS)


def long_enough(col: Column) -> Column:
    return F.length(strip(col)) >= fv.MIN_PAGE_LENGTH


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Text between two 0-based offsets with some context, on one line."""
    left = F.greatest(F.lit(0), start - fv.SNIPPET_PADDING)
    right = F.least(F.length(text), end + fv.SNIPPET_PADDING)
    return collapse(F.substring(text, left + 1, right - left))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<from,to>> of 0-based match offsets.

    Spark has no function returning all match positions, so they are added up
    from the pieces between the matches and the matches themselves.
    """
    grouped = pattern if pattern.startswith("(?") else "(?U)" + pattern
    between = F.transform(F.split(text, grouped), F.length)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(grouped), F.lit(0)), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + pair["len"]
        return F.struct(
            end.alias("at"),
            F.array_append(
                state["spans"], F.struct(begin.alias("from"), end.alias("to"))
            ).alias("spans"),
        )

    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(lengths)),
        lengths,
        lambda gap, length: F.struct(gap.alias("gap"), length.alias("len")),
    )
    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def _issue(kind: str, shown: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(EXPLANATIONS[kind]).alias("explanation"), shown.alias("snippet")
    )


def _holds(text: Column, letters: str) -> Column:
    """Whether the text has one of ``letters`` (none: true), found without a regular expression."""
    return reduce(or_, [F.contains(text, F.lit(c)) for c in letters]) if letters else F.lit(True)


def _none() -> Column:
    return F.array().cast(ISSUES_TYPE)


def _one_per_match(text: Column, kind: str, pattern: str, letters: str = "") -> Column:
    """An issue for each match; every match has one of ``letters``, looked for before the pattern."""
    return F.when(
        _holds(text, letters) & text.rlike(pattern),
        F.transform(match_spans(text, pattern), lambda s: _issue(kind, snippet(text, s["from"], s["to"]))),
    ).otherwise(_none())


def digit_words(text: Column) -> Column:
    """Words with a digit wedged in, legitimate ones left out, repeats kept."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + fv.DIGIT_IN_WORD), F.lit(0))
    return F.when(
        text.rlike("[a-zA-ZÀ-ỹ][0-9]"),
        F.filter(found, lambda w: ~w.rlike("(?U)" + fv.DIGIT_IN_WORD_ALLOWED)),
    ).otherwise(F.array().cast("array<string>"))


def unexpected_share(text: Column) -> Column:
    # Whole runs of expected characters are removed at once.
    odd = F.length(F.regexp_replace(text, "(?U)" + fv.EXPECTED_CHARACTERS + "+", ""))
    return F.try_divide(odd.cast("double"), F.length(text))


def _lost_exponents(text: Column) -> Column:
    pattern = "(?U)" + fv.LOST_EXPONENT

    def issue(spans: Column) -> Column:
        shown = snippet(text, spans[0]["from"], F.element_at(spans, -1)["to"])
        return F.when(
            F.size(spans) >= fv.MIN_LOST_EXPONENTS, F.array(_issue(fv.KIND_LOST_EXPONENT, shown))
        ).otherwise(_none())

    return F.when(
        _holds(text, "?*") & text.rlike(pattern), let(match_spans(text, pattern), issue)
    ).otherwise(_none())


def _digit_words(text: Column) -> Column:
    def issue(found: Column) -> Column:
        shown = F.array_join(F.array_distinct(found), ", ")
        return F.when(
            F.size(found) >= fv.MIN_DIGIT_WORDS, F.array(_issue(fv.KIND_DIGIT_WORD, shown))
        ).otherwise(_none())

    return let(digit_words(text), issue)


def _garbled(text: Column) -> Column:
    return F.when(
        unexpected_share(text) > fv.GARBLED_SHARE,
        F.array(_issue(fv.KIND_GARBLED, snippet(text, F.lit(0), F.lit(80)))),
    ).otherwise(_none())


#: The detectors of a page by the kind of issue they find, in the order of its issues.
_DETECTORS = {
    fv.KIND_SWAPPED_MINUS: lambda t: _one_per_match(t, fv.KIND_SWAPPED_MINUS, "(?U)" + fv.SWAPPED_MINUS, "="),
    fv.KIND_FRACTION: lambda t: _one_per_match(t, fv.KIND_FRACTION, "(?iU)" + fv.FRACTION_WITHOUT_SLASH, "=~"),
    fv.KIND_DEFINITION_BOX: lambda t: _one_per_match(t, fv.KIND_DEFINITION_BOX, "(?iU)" + fv.LOST_DEFINITION_BOX),
    fv.KIND_LOST_EXPONENT: _lost_exponents,
    fv.KIND_DIGIT_WORD: _digit_words,
    fv.KIND_GARBLED: _garbled,
}


def issues_of(text: Column, kind: str) -> Column:
    """The issues of one kind of a page that is long enough."""
    return _DETECTORS[kind](text)


def scan_page(text: Column) -> Column:
    """Every suspicion about one page; empty for short pages."""
    return F.when(
        long_enough(text), F.concat(*[detector(text) for detector in _DETECTORS.values()])
    ).otherwise(_none())
