"""Expressions over generated answers: refusals, page references, wording."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions.text import is_blank, let, strip, strip_diacritics, upper_first

_FOLD = "(?iU)"


def is_refusal(col: Column) -> Column:
    return col.rlike(_FOLD + "|".join(fv.REFUSAL_PATTERNS))


def names_a_page(col: Column) -> Column:
    return col.rlike(_FOLD + fv.PAGE_IN_ANSWER)


def looks_like_refusal(col: Column) -> Column:
    return is_refusal(col) | (strip(col) == fv.NO_CONTEXT_ANSWER.strip())


def is_provider_error(col: Column) -> Column:
    return strip(col).isin(fv.SERVICE_ERROR_ANSWER, fv.RATE_LIMIT_ANSWER)


def page_mentions(col: Column) -> Column:
    """Page numbers in the order the answer mentions them (repeats kept)."""
    found = F.regexp_extract_all(col, F.lit(_FOLD + fv.PAGE_IN_ANSWER), F.lit(1))
    return F.transform(found, lambda n: n.cast("int"))


def pages_named(col: Column) -> Column:
    """Distinct pages the answer cites, ranges expanded, ascending."""
    cited = F.regexp_extract_all(col, F.lit(_FOLD + fv.PAGE_RANGE_IN_ANSWER), F.lit(0))

    def expand(ends: Column) -> Column:
        first = ends[0]
        last = F.coalesce(F.get(ends, F.lit(1)), first)
        return F.when(
            last.between(first, first + fv.MAX_PAGE_RANGE), F.sequence(first, last)
        ).otherwise(F.array(first))

    def numbers(mention: Column) -> Column:
        return F.regexp_extract_all(mention, F.lit(r"(\d+)"), F.lit(1)).cast("array<int>")

    spans = F.transform(cited, lambda mention: let(numbers(mention), expand))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def invented_pages(answer: Column, retrieved: Column) -> Column:
    """Pages the answer names that are not among the ``retrieved`` ones, ascending."""
    return F.array_sort(F.array_except(pages_named(answer), retrieved))


def keywords_found(answer: Column, keywords: Column) -> Column:
    lowered = F.lower(answer)
    return F.filter(keywords, lambda k: F.contains(lowered, F.lower(k)))


def hide_internal_wording(col: Column) -> Column:
    def has_label(text: Column) -> Column:
        # The letters that every label has, found without a regular expression.
        return F.contains(text, F.lit("oạn")) | F.contains(text, F.lit("oan"))

    def hide_labels(text: Column) -> Column:
        bare = F.regexp_replace(text, "(?U)" + fv.BRACKETED_PASSAGE_LABEL, "")
        return let(bare, lambda t: F.when(has_label(t), hide_inline_labels(t)).otherwise(t))

    def hide_inline_labels(text: Column) -> Column:
        text = F.regexp_replace(text, "(?U)" + fv.INLINE_PASSAGE_LABEL, "$1o$2n này")
        # Sentence starts are handled first, with the text before the run kept in $1.
        at_start = r"(?U)((?:\A|[.!?:])[ \t*_\-•\n]*?)" + fv.REPEATED_PASSAGE_LABEL
        text = F.regexp_replace(text, at_start, "$1" + fv.REPEATED_LABEL_AT_START)
        return F.regexp_replace(text, "(?U)" + fv.REPEATED_PASSAGE_LABEL, fv.REPEATED_LABEL_INSIDE)

    def reword(wordings: tuple) -> Callable[[Column], Column]:
        def replaced(text: Column) -> Column:
            (internal, shown), *rest = wordings
            text = F.replace(text, F.lit(internal), F.lit(shown))
            text = F.replace(text, F.lit(internal.capitalize()), F.lit(shown.capitalize()))
            return let(text, reword(rest)) if rest else text

        # All wordings end alike or hold these letters; without them nothing is left to do.
        return lambda text: F.when(F.contains(text, F.lit("gữ cảnh")), replaced(text)).otherwise(text)

    # Most answers hold neither a label nor internal wording: test before rewriting.
    labelled = let(col, lambda t: F.when(has_label(t) & t.rlike(r"[ĐđDd]o[ạa]n\s"), hide_labels(t)).otherwise(t))
    return let(labelled, reword(fv.INTERNAL_WORDING))


def drop_invented_page_refs(answer: Column, pages: Column) -> Column:
    """Remove passing references to pages outside ``pages`` (array of INT).

    Works on the answer's own lines and sentences; lines without such a reference
    are passed through unchanged.
    """
    reference = _FOLD + fv.PASSING_PAGE_REFERENCE
    # Each reference is written as open, number, middle, its text, close; cutting at
    # the first mark then leaves one reference per piece.
    opened, middle, closed = "\ue000", "\ue001", "\ue002"
    marked_reference = f"{opened}$1{middle}$0{closed}"

    def keep_known(piece: Column) -> Column:
        number = F.substring_index(piece, middle, 1).try_cast("int")
        shown = F.translate(F.substring(piece, F.locate(middle, piece) + 1, F.length(piece)), closed, "")
        rest = F.substring_index(piece, closed, -1)
        return F.when(F.array_contains(pages, number), shown).otherwise(rest)

    def clean(sentence: Column, marked: Column) -> Column:
        pieces = F.split(marked, opened)
        rest = F.array_join(
            F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(keep_known(piece))), ""
        )
        cleaned = let(rest, lambda r: F.when((r != sentence) & (word_count(r) < fv.MIN_WORDS_LEFT), "").otherwise(r))
        return F.when(marked == sentence, sentence).otherwise(cleaned)

    def word_count(text: Column) -> Column:
        return F.regexp_count(text, F.lit(r"(?U)\w+"))

    def clean_line(line: Column) -> Column:
        def marked(sentences: Column) -> Column:
            # A reference never holds the end of a sentence, so marking finds those of the line, once.
            both = F.transform(sentences, lambda s: F.regexp_replace(s, reference, marked_reference))
            return let(both, lambda m: F.when(m != sentences, joined(sentences, m)).otherwise(line))

        def joined(sentences: Column, marks: Column) -> Column:
            return F.array_join(F.filter(F.zip_with(sentences, marks, clean), lambda s: ~is_blank(s)), " ")

        return F.when(mentions_page(line), let(F.split(line, r"(?U)(?<=[.!?])\s+"), marked)).otherwise(line)

    def mentions_page(text: Column) -> Column:
        # Cheap to test, and necessary for a reference.
        return text.rlike(r"(?i)trang\s")

    return let(
        answer,
        lambda text: F.when(
            mentions_page(text), F.array_join(F.transform(F.split(text, "\n"), clean_line), "\n")
        ).otherwise(text),
    )


def render_exponents(col: Column) -> Column:
    """``x^2`` to ``x²``: marks around each exponent, then every other piece translated."""

    def render(text: Column) -> Column:
        marked = F.regexp_replace(text, fv.CARET_EXPONENT, "\ue000$1\ue000")
        pieces = F.transform(
            F.split(marked, "\ue000"),
            lambda piece, i: F.when(
                i % 2 == 1, F.translate(piece, fv.SUPERSCRIPT_FROM, fv.SUPERSCRIPT_TO)
            ).otherwise(piece),
        )
        return F.when(F.contains(text, F.lit("^")), F.array_join(pieces, "")).otherwise(text)

    return let(col, render)


def polish_answer(answer: Column, pages: Column) -> Column:
    """Wording, then page references (kept as they were if nothing would be left), then exponents."""

    def check(worded: Column) -> Column:
        checked = drop_invented_page_refs(worded, pages)
        return let(checked, lambda c: render_exponents(F.when(is_blank(c), worded).otherwise(c)))

    return let(hide_internal_wording(answer), check)


def grounded(answer: Column) -> Column:
    """An answer leans on the book unless it refuses and names no page."""
    return ~(is_refusal(answer) & ~names_a_page(answer))


def match_subject(reply: Column, subjects: Column) -> Column:
    """The one candidate named in the reply; NULL when none or several are."""
    plain = F.lower(strip_diacritics(reply))
    named = F.filter(subjects, lambda s: F.contains(plain, F.lower(strip_diacritics(s))))
    return F.when(F.size(named) == 1, named[0])


def parse_classification(reply: Column, subjects: Column) -> Column:
    return F.when(
        F.upper(strip(reply)) == fv.NOT_SUBJECT_SPECIFIC_REPLY, F.lit(fv.NOT_SUBJECT_SPECIFIC)
    ).otherwise(match_subject(reply, subjects))


def same_book_as_best(citations: Column) -> Column:
    """Distinct non-blank citations of the first one's book, two at most."""
    unique = F.array_distinct(F.filter(citations, lambda c: ~is_blank(c)))

    def book(c: Column) -> Column:
        return F.substring_index(c, fv.CITATION_PAGE_SEPARATOR, 1)

    return F.slice(F.filter(unique, lambda c: book(c) == book(unique[0])), 1, fv.MAX_CITED_SOURCES)


def page_check_reminder(citations: Column) -> Column:
    """Line asking the reader to check the cited pages; empty without citations."""
    listed = F.array_join(same_book_as_best(citations), "; ")
    return F.when(
        listed != "",
        F.concat(
            F.lit("📖 Bạn mở sách "),
            listed,
            F.lit(
                " để kiểm tra lại nhé.\nNếu thấy mình trả lời chưa đúng, bạn bấm nút “🚩 Báo sai” "
                "(hoặc gõ /baosai) để mình ghi lại nha!"
            ),
        ),
    ).otherwise("")


def capability_message(grade: Column, subjects: Column) -> Column:
    listed = F.array_join(F.transform(subjects, lambda s: F.concat(F.lit("• "), s)), "\n")
    return F.when(
        F.size(subjects) == 0,
        F.concat(F.lit("Chưa có sách cho lớp "), grade.cast("string"), F.lit(".")),
    ).otherwise(
        F.concat(
            F.lit("Lớp "), grade.cast("string"), F.lit(" có sách của các môn:\n\n"), listed
        )
    )


def feedback_thanks(citations: Column, gave_reason: Column) -> Column:
    listed = F.array_join(same_book_as_best(citations), "; ")
    return F.concat(
        F.lit("Cảm ơn bạn đã báo! "),
        F.when(gave_reason, "Lý do của bạn đã được ghi lại. ").otherwise(""),
        F.when(listed == "", "Bạn thử hỏi lại bằng từ ngữ trong sách nhé.").otherwise(
            F.concat(F.lit("Bạn mở sách "), listed, F.lit(" đối chiếu nhé."))
        ),
    )


def capitalised(col: Column) -> Column:
    return upper_first(F.lower(col))
