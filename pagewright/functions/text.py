"""Text expressions: every function takes and returns Spark columns.

Regexes run with ``(?U)`` so that word, space and digit classes and case
folding are Unicode-aware.  The only Python step in this module is the NFC
composition of the rows that need it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright import fixed_values as fv

#: White space as ``str.strip`` understands it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_WS = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def let(col: Column, body) -> Column:
    """``body(col)`` with ``col`` worked out once, however often ``body`` uses it."""
    return F.transform(F.array(col), body)[0]


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITE_SPACE))


def collapse(col: Column) -> Column:
    """One space between words, none at the ends."""
    return strip(F.regexp_replace(col, f"(?U){_WS}+", " "))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def words(col: Column) -> Column:
    collapsed = collapse(col)
    return F.when(collapsed == "", F.array().cast("array<string>")).otherwise(
        F.split(collapsed, " ")
    )


def upper_first(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 2**31 - 1))


# --- Unicode -------------------------------------------------------------------


def _ranges(points: list[int]) -> str:
    """A Java character class body for sorted code points."""
    out: list[str] = []
    start = prev = None
    for point in [*points, None]:
        if start is not None and point == prev + 1:
            prev = point
            continue
        if start is not None:
            out.append(f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
        start = prev = point
    return "".join(out)


@lru_cache(maxsize=1)
def _needs_nfc_pattern() -> str:
    """Characters whose presence means a text may not be in NFC already."""
    suspects = [
        point
        for point in range(0x300, sys.maxunicode + 1)
        if not 0xAC00 <= point <= 0xD7A3
        and not 0xD800 <= point <= 0xDFFF
        and (
            unicodedata.category(chr(point)).startswith("M")
            or 0x1161 <= point <= 0x11C2
            or unicodedata.normalize("NFC", chr(point)) != chr(point)
        )
    ]
    # Most text lies in a few wide blocks without any suspect; testing those first
    # spares nearly every character the long list of ranges.
    wide = [(0x0, 0x2FF), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
    assert not any(lo <= point <= hi for point in suspects for lo, hi in wide)
    common = "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in wide)
    return f"[[^{common}]&&[{_ranges(suspects)}]]"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(col: Column) -> Column:
    """Unicode NFC.  Only rows holding a composable character travel to Python."""
    return F.coalesce(_compose(F.when(col.rlike(_needs_nfc_pattern()), col)), col)


@lru_cache(maxsize=1)
def _diacritic_table() -> tuple[str, str, str]:
    """(accented characters, their bases, class of combining marks), by rule."""
    source, target, marks = [], [], []
    for point in range(0xC0, 0x3000):
        char = chr(point)
        if unicodedata.combining(char):
            marks.append(point)
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        base = {"đ": "d", "Đ": "D"}.get(base, base)
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    # The general class is one cheap test and spares other characters the list.
    return "".join(source), "".join(target), f"[\\p{{M}}&&[{_ranges(marks)}]]"


def strip_diacritics(col: Column) -> Column:
    source, target, marks = _diacritic_table()
    return F.regexp_replace(F.translate(col, source, target), marks, "")


# --- Page cleaning ---------------------------------------------------------------


def squeeze_blank_lines(col: Column) -> Column:
    return strip(F.regexp_replace(col, "\n{3,}", "\n\n"))


def clean_text(col: Column, compose: bool = True) -> Column:
    """Clean one page of extracted text.

    Whole-text multi-line regexes (``(?md)``: only LF ends a line) replace a
    split into lines, so the chain stays a plain string expression.
    """
    text = nfc(col) if compose else col
    text = F.regexp_replace(text, fv.CONTROL_CHARS, "")
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    text = F.regexp_replace(text, "[ \t\u00a0]{2,}", " ")
    text = F.regexp_replace(
        text, r"(?Umd)^[[\s\x1c-\x1f]&&[^\n]]+|[[\s\x1c-\x1f]&&[^\n]]+$", ""
    )
    text = F.regexp_replace(
        text, r"(?Umd)^[-–—|]*[\s&&[^\n]]*\d{1,4}[\s&&[^\n]]*[-–—|]*$(?:\n|\z)", ""
    )
    return squeeze_blank_lines(text)


def is_page_number_line(col: Column) -> Column:
    return col.rlike("(?U)" + fv.PAGE_NUMBER_LINE)


def is_contents_page(col: Column) -> Column:
    return F.contains(col, F.lit(fv.TABLE_OF_CONTENTS_MARKER))


def drop_lines(col: Column, blocked: Column) -> Column:
    """Remove the lines whose stripped form is in the ``blocked`` array."""
    kept = F.filter(F.split(col, "\n"), lambda line: ~F.array_contains(blocked, strip(line)))
    return F.when(F.size(blocked) > 0, squeeze_blank_lines(F.array_join(kept, "\n"))).otherwise(col)


def header_candidates(col: Column) -> Column:
    """Distinct short non-empty lines of one page."""
    lines = F.transform(F.split(col, "\n"), strip)
    return F.array_distinct(
        F.filter(lines, lambda s: (s != "") & (F.length(s) <= fv.MAX_HEADER_LENGTH))
    )


def strip_stray_latex(col: Column) -> Column:
    text = F.regexp_replace(col, fv.STRAY_DOLLAR, "$1")
    text = F.regexp_replace(text, fv.STRAY_FRACTION, "$1/$2")
    text = F.regexp_replace(text, "(?U)" + fv.STRAY_COMMAND, "")
    return F.replace(F.translate(text, "{}", ""), F.lit("**"), F.lit(""))


# --- Sentences and sections --------------------------------------------------------


def split_sentences(col: Column) -> Column:
    """Sentences in order: cut at blank lines and after end punctuation."""
    cut = rf"(?U)(?<=[{fv.SENTENCE_END}]){_WS}+|{_WS}*\n{_WS}*\n{_WS}*"
    return F.filter(F.transform(F.split(col, cut), collapse), lambda s: s != "")


def is_heading_line(col: Column) -> Column:
    line = strip(col)
    return (F.length(line) <= fv.MAX_HEADING_LENGTH) & line.rlike("(?U)" + fv.HEADING_LINE)


def split_into_sections(col: Column) -> Column:
    """Sections of one page; a heading opens one once the current one is long enough.

    Pages without a heading line skip the fold altogether.
    """
    lines = F.split(col, LINE_BREAK)
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast("array<string>").alias("open"),
    )

    def step(state: Column, line: Column) -> Column:
        opens = (
            is_heading_line(line)
            & (F.size(state["open"]) > 0)
            & (F.length(strip(F.array_join(state["open"], "\n"))) >= fv.MIN_SECTION_LENGTH)
        )
        return F.struct(
            F.when(
                opens, F.array_append(state["done"], F.array_join(state["open"], "\n"))
            ).otherwise(state["done"]).alias("done"),
            F.when(opens, F.array(line)).otherwise(F.array_append(state["open"], line)).alias("open"),
        )

    folded = F.aggregate(
        lines, start, step, lambda s: F.array_append(s["done"], F.array_join(s["open"], "\n"))
    )
    whole = F.array(F.array_join(lines, "\n"))
    has_heading = F.exists(lines, is_heading_line)
    return F.filter(F.when(has_heading, folded).otherwise(whole), lambda s: ~is_blank(s))


# --- Scope ---------------------------------------------------------------------------


def normalize_subject(col: Column) -> Column:
    """Canonical subject name; NULL for a blank one."""
    collapsed = collapse(col)
    key = F.replace(F.lower(strip_diacritics(collapsed)), F.lit(" "), F.lit(""))
    aliases = F.create_map(*[F.lit(x) for pair in fv.SUBJECT_ALIASES.items() for x in pair])
    return F.when(
        collapsed != "", F.coalesce(F.try_element_at(aliases, key), upper_first(collapsed))
    )


def is_known_subject(col: Column) -> Column:
    return col.isin(sorted(set(fv.SUBJECT_ALIASES.values())))


def validate_grade(col: Column) -> Column:
    """Grade as INT; NULL when it is not a whole number from 1 to 12."""
    text = strip(col.cast("string"))
    grade = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    return F.when(grade.between(fv.MIN_GRADE, fv.MAX_GRADE), grade)


# --- Search terms ----------------------------------------------------------------------


def _edge_strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE + fv.EDGE_NOISE_CHARS))


def keyword_phrase(question: Column) -> Column:
    """The term a definition question asks about, or NULL."""

    def from_bare(bare: Column) -> Column:
        opened = F.regexp_replace(bare, "^(?:" + "|".join(fv.QUESTION_PREFIXES) + ")", "")
        return let(let(opened, without_suffix), lambda phrase: F.when(usable(phrase, bare), phrase))

    def without_suffix(opened: Column) -> Column:
        endings = F.filter(
            F.array(*map(F.lit, fv.QUESTION_SUFFIXES)), lambda suffix: F.endswith(opened, suffix)
        )
        cut = F.coalesce(F.length(F.get(endings, F.lit(0))), F.lit(0))
        return _edge_strip(collapse(F.substring(opened, F.lit(1), F.length(opened) - cut)))

    def usable(phrase: Column, bare: Column) -> Column:
        return F.length(phrase).between(fv.MIN_KEYWORD_LENGTH, fv.MAX_KEYWORD_LENGTH) & (
            (phrase != bare) | (F.size(F.split(phrase, " ")) <= fv.MAX_BARE_TERM_WORDS)
        )

    return let(_edge_strip(F.lower(question)), from_bare)


def name_key(col: Column) -> Column:
    """Form in which spellings of a name are compared."""
    return collapse(F.replace(F.lower(strip_diacritics(col)), F.lit("-"), F.lit(" ")))


def _plain_name_key(text: str) -> str:
    base = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return " ".join(base.replace("đ", "d").replace("Đ", "D").lower().replace("-", " ").split())


def name_variants(phrase: Column) -> Column:
    """Other spellings of the foreign name in ``phrase``, most promising first."""
    spellings = F.array(
        *[
            F.struct(
                F.lit(_plain_name_key(found)).alias("key"),
                F.lit(found).alias("found"),
                F.array(*[F.lit(n) for n in group if n != found]).alias("others"),
                F.array(*[F.lit(n.capitalize()) for n in group if n != found]).alias("cased"),
            )
            for group in fv.NAME_SPELLINGS
            for found in group
        ]
    )

    def from_parts(parts: Column) -> Column:
        text, key = parts["text"], parts["key"]

        def spelled(entry: Column, names: Column) -> Column:
            literally = F.filter(names, lambda _: F.contains(text, entry["found"]))
            return F.transform(literally, lambda name: F.replace(text, entry["found"], name))

        named = F.slice(F.filter(spellings, lambda entry: F.contains(key, entry["key"])), 1, 1)
        return F.flatten(
            F.transform(
                named,
                lambda entry: F.concat(
                    spelled(entry, entry["cased"]),
                    entry["cased"],
                    spelled(entry, entry["others"]),
                    entry["others"],
                ),
            )
        )

    parts = F.struct(phrase.alias("text"), name_key(phrase).alias("key"))
    return F.slice(F.array_distinct(let(parts, from_parts)), 1, fv.MAX_NAME_VARIANTS)


def last_two_words(phrase: Column) -> Column:
    """The last two words of a phrase of three or more, else NULL."""
    return let(
        words(phrase), lambda w: F.when(F.size(w) >= 3, F.concat_ws(" ", F.slice(w, -2, 2)))
    )


# --- Small lists -------------------------------------------------------------------------


def parse_list(col: Column) -> Column:
    """Items of a comma-separated setting, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(col, ","), strip), lambda x: x != "")


def encode_lines(col: Column) -> Column:
    return F.array_join(col, "\n")


def decode_lines(col: Column) -> Column:
    return F.filter(F.split(col, "\n"), lambda x: x != "")


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("-")).otherwise(
        F.format_string("%.1f%%", F.try_divide(part.cast("double"), whole) * 100)
    )


def parse_page_specs(col: Column) -> Column:
    """``<grade>/<stem>:<page>`` items as structs; ``ok`` is false for a malformed one."""
    shape = r"^\s*([+-]?\d+)\s*/(.*):\s*([+-]?\d+)\s*$"

    def parse(item: Column) -> Column:
        return F.struct(
            item.alias("spec"),
            F.regexp_extract(item, shape, 1).try_cast("int").alias("grade"),
            F.regexp_extract(item, shape, 2).alias("book"),
            F.regexp_extract(item, shape, 3).try_cast("int").alias("page"),
            item.rlike(shape).alias("ok"),
        )

    return F.transform(parse_list(col), parse)
