"""Cutting books into overlapping, sentence-aligned chunks.

Where the chunk that begins at a sentence ends follows from the running sum of
the sentences' sizes by binary search, and where the next one begins by another.
Whole chunks are stepped over, so a book's cuts come from numbers alone: sizes,
section marks and pages.  Texts are written once, and joined once, at the end,
inside the JVM, with the ranges of sentences the cuts name.

A book is still never one task: its pages are cut into blocks of
``pages_per_block``, and every block is stepped over from an *assumed* open
chunk, which is then checked against what the block before it really left open.
Blocks whose assumption was wrong are cut again.  When nothing changes any more,
each block agrees with its predecessor and the first block of a book starts from
nothing, so the result equals one pass over the whole book.  Cuts fall back into
step within a few chunks, and at every section, so the first check nearly always
passes; each check reads numbers only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions import text as tx
from pagewright.plans.materialize import materialize
from pagewright.plans.once import with_once
from pagewright.plans.ordered import prefix_sum

PAGES_PER_BLOCK = 64
#: Sentences at the end of a block from which its open chunk is first guessed.
GUESS_SENTENCES = 160
#: Blocks per group when looking for the block before each block.
_BLOCK_GROUP = 4096

#: A sentence by its block and place; what is open at a block's end is a list of these.
_OPEN = "array<struct<block: bigint, place: int, size: int, page: int>>"
_CUT = (
    "chunks array<struct<page_start: int, page_end: int, parts: array<struct<block: bigint, first: int, n: int>>>>, "
    f"open {_OPEN}"
)


def page_sentences(text) -> "F.Column":
    """array<struct<text, opens>> of one page; ``opens`` marks a section's first sentence.

    The first section of a page continues the text before it, so it never opens.
    """
    return F.flatten(
        F.transform(
            tx.split_into_sections(text),
            lambda section, s: F.transform(
                tx.split_sentences(section),
                lambda sentence, i: F.struct(
                    sentence.alias("text"), ((s > 0) & (i == 0)).alias("opens")
                ),
            ),
        )
    )


def cut_points(
    sizes: list[int], opens: list[int], held: int, closed: bool, size: int, overlap: int
) -> tuple[list[tuple[int, int]], int]:
    """Chunks as (begin, end) over consecutive sentences, and where the open chunk begins.

    ``sizes`` are lengths with their separator, ``opens`` the places of sentences
    that begin a section, and the first ``held`` sentences are in the first chunk
    already.  The end of a chunk is the next section, or as far as ``size`` goes,
    but it takes one sentence beyond what it shares with the chunk before.  A
    chunk cut for size shares the sentences of its last ``overlap`` characters
    with the next one: one at least, and not all of several.  Unless ``closed``,
    a chunk that reaches the last sentence stays open.
    """
    count = len(sizes)
    reach = [0, *accumulate(sizes)]
    borders = [*opens, count]
    found: list[tuple[int, int]] = []
    begin, least = 0, max(held, 1)
    while begin < count:
        border = borders[bisect_right(borders, begin)]
        end = min(border, max(least, bisect_right(reach, reach[begin] + size) - 1))
        if end == count and not closed:
            break
        found.append((begin, end))
        shared = end
        if end < border and overlap > 0:
            shared = min(end - 1, bisect_left(reach, reach[end] - overlap))
            if shared <= begin:
                shared = begin if end - begin == 1 else begin + 1
        begin, least = shared, end + 1
    return found, begin


def _cutter(size: int, overlap: int):
    """Cuts of each block from what is open before it."""

    def parts(sentences: list[dict]) -> list[dict]:
        runs: list[dict] = []
        for s in sentences:
            if runs and runs[-1]["block"] == s["block"] and runs[-1]["first"] + runs[-1]["n"] == s["place"]:
                runs[-1]["n"] += 1
            else:
                runs.append({"block": s["block"], "first": s["place"], "n": 1})
        return runs

    def cut(row: dict) -> dict:
        held, block, skipped = row["__in"] or [], row["__block"], row["__skipped"]
        ahead = len(held)
        sizes = [s["size"] for s in held] + row["sizes"]
        pages = [s["page"] for s in held] + row["pages"]
        opens = [ahead + i for i, o in enumerate(row["opens"]) if o and ahead + i > 0]
        found, rest = cut_points(sizes, opens, ahead, row["__last"], size, overlap)

        def ranges(begin: int, end: int) -> list[dict]:
            """Sentences left open by earlier blocks, then a run of this block's own."""
            earlier = parts(held[begin:end]) if begin < ahead else []
            first = max(begin, ahead)
            own = [{"block": block, "first": skipped + first - ahead, "n": end - first}] if end > first else []
            return earlier + own

        chunks = [{"page_start": pages[a], "page_end": pages[b - 1], "parts": ranges(a, b)} for a, b in found]
        own = [
            {"block": block, "place": skipped + i - ahead, "size": sizes[i], "page": pages[i]}
            for i in range(max(rest, ahead), len(sizes))
        ]
        return {"chunks": chunks, "open": held[rest:] + own}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("chunks", _ARROW_CHUNKS), ("open", _ARROW_OPEN)])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                cuts = pa.RecordBatch.from_pylist([cut(row) for row in some.select(_READ).to_pylist()], kinds)
                yield pa.RecordBatch.from_arrays(
                    [some.column("__whole"), *cuts.columns], ["__whole", *cuts.schema.names]
                )

    return run


_READ = ["__block", "sizes", "pages", "opens", "__in", "__skipped", "__last"]
_ARROW_OPEN = pa.list_(
    pa.struct([("block", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("page", pa.int32())])
)
_ARROW_CHUNKS = pa.list_(
    pa.struct(
        [
            ("page_start", pa.int32()),
            ("page_end", pa.int32()),
            ("parts", pa.list_(pa.struct([("block", pa.int64()), ("first", pa.int32()), ("n", pa.int32())]))),
        ]
    )
)


def _blocks(pages: DataFrame, keys: list[str], page: str, text: str, width: int) -> DataFrame:
    """One row per (book, block) with its sentences in reading order."""
    kept = pages.where(~tx.is_contents_page(F.col(text))).select(
        *keys, F.col(page).cast("int").alias("__page"), F.col(text).alias("__text")
    )
    sentences = (
        with_once(kept, "__s", page_sentences(F.col("__text")))
        .drop("__text")
        .where(F.size("__s") > 0)
        .withColumn("__block", F.expr(f"bigint(__page div {width})"))
    )
    flat = F.flatten(
        F.transform(
            F.array_sort("__pages"),
            lambda p: F.transform(
                p["__s"], lambda s: F.struct(s["text"].alias("t"), p["__page"].alias("p"), s["opens"].alias("o"))
            ),
        )
    )
    grouped = sentences.groupBy(*keys, "__block").agg(
        F.collect_list(F.struct("__page", "__s")).alias("__pages")
    )
    return with_once(grouped, "__flat", flat).select(
        *keys,
        "__block",
        F.col("__flat.t").alias("texts"),
        F.col("__flat.p").alias("pages"),
        F.col("__flat.o").alias("opens"),
    )


def _neighbours(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Block number of the block before and after each block of a book.

    Looked up inside groups of block numbers first, then across the groups, so
    that no window holds all the blocks of one long book.
    """
    group = F.expr(f"__block div {_BLOCK_GROUP}")
    ids = blocks.select(*keys, "__block", group.alias("__group"))
    inside = Window.partitionBy(*keys, "__group").orderBy("__block")
    across = Window.partitionBy(*keys).orderBy("__group")
    ends = (
        ids.groupBy(*keys, "__group")
        .agg(F.min("__block").alias("__lo"), F.max("__block").alias("__hi"))
        .select(
            *keys,
            "__group",
            F.lag("__hi").over(across).alias("__before"),
            F.lead("__lo").over(across).alias("__after"),
        )
    )
    return (
        ids.withColumn("__p", F.lag("__block").over(inside))
        .withColumn("__n", F.lead("__block").over(inside))
        .join(ends, [*keys, "__group"])
        .select(
            *keys,
            "__block",
            F.coalesce("__p", "__before").alias("__prev"),
            F.coalesce("__n", "__after").alias("__next"),
        )
    )


def chunk_pages(
    pages: DataFrame,
    keys: list[str],
    page: str = "page_number",
    text: str = "text",
    chunk_size: int = 700,
    chunk_overlap: int = 100,
    pages_per_block: int = PAGES_PER_BLOCK,
) -> DataFrame:
    """Chunks of every book in ``pages``.

    ``keys`` identify a book and (keys, page) is unique.  Returns ``keys``,
    ``chunk_index`` (dense from 0 per book), ``text``, ``page_start``,
    ``page_end``.
    """
    if chunk_overlap >= chunk_size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")
    cutter = _cutter(chunk_size, chunk_overlap)
    book = [*keys, "__block"]

    def cut(todo: DataFrame) -> DataFrame:
        """``todo`` (a block's numbers and ``__in``) with its chunks and what it leaves open."""
        whole = F.struct(*book, "__prev", "__in").alias("__whole")
        rows = todo.select(whole, *_READ)
        schema = StructType([rows.schema["__whole"], *StructType.fromDDL(_CUT).fields])
        return rows.mapInArrow(cutter, schema).select("__whole.*", "chunks", "open")

    raw = materialize(_blocks(pages, keys, page, text, pages_per_block), "blocks")
    sizes = F.transform("texts", lambda t: (F.char_length(t) + 1).cast("int"))
    numbers = raw.select(*book, sizes.alias("sizes"), "pages", "opens")
    blocks = materialize(
        numbers.join(_neighbours(raw, keys), book).select(
            "*", F.lit(0).alias("__skipped"), F.col("__next").isNull().alias("__last")
        ),
        "block-numbers",
    )

    # What each block leaves open, guessed from its last sentences alone.
    def tail(name: str):
        return F.slice(name, -F.least(F.size(name), F.lit(GUESS_SENTENCES)), F.lit(GUESS_SENTENCES))

    tails = blocks.where(~F.col("__last")).withColumns(
        {
            "__skipped": F.greatest(F.size("sizes") - GUESS_SENTENCES, F.lit(0)),
            "__in": F.lit(None).cast(_OPEN),
            **{name: tail(name) for name in ("sizes", "pages", "opens")},
        }
    )
    guess = cut(tails).select(*keys, F.col("__block").alias("__prev"), F.col("open").alias("__in"))
    done = materialize(cut(blocks.join(guess, [*keys, "__prev"], "left")), "cuts")
    while True:
        left = done.select(*keys, F.col("__block").alias("__prev"), "open")
        wrong = (
            done.select(*book, "__prev", "__in")
            .where(F.col("__prev").isNotNull())
            .join(left, [*keys, "__prev"])
            .where(~F.col("__in").eqNullSafe(F.col("open")))
            .select(*book, F.col("open").alias("__in"))
        )
        wrong = materialize(wrong, "wrong-entries")
        if wrong.isEmpty():
            break
        again = cut(blocks.join(wrong, book))
        kept = done.join(wrong.select(*book), book, "left_anti")
        done = materialize(kept.unionByName(again), "cuts")
    return _joined(done, raw, keys)


def _joined(done: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """The texts of the chunks: ranges of each block's sentences, put together where a chunk crosses blocks."""
    book = [*keys, "__block"]
    counted = prefix_sum(
        done.select(*book, F.size("chunks").alias("__n")), keys, "__block", F.col("__n"), "__first_index",
        width=_BLOCK_GROUP,
    ).select(*book, "__first_index")
    chunks = done.join(counted, book).select(
        *keys, "__first_index", F.posexplode("chunks").alias("__pos", "__c")
    )
    parts = chunks.select(
        *keys,
        (F.col("__first_index") + F.col("__pos")).cast("int").alias("chunk_index"),
        "__c.page_start",
        "__c.page_end",
        F.size("__c.parts").alias("__parts"),
        F.posexplode("__c.parts").alias("__part", "__p"),
    )
    named = ["chunk_index", "page_start", "page_end", "__parts", "__part"]
    wanted = parts.groupBy(*keys, F.col("__p.block").alias("__block")).agg(
        F.collect_list(F.struct(*named, F.col("__p.first").alias("first"), F.col("__p.n").alias("n"))).alias("__want")
    )
    cut = F.transform(
        "__want",
        lambda w: F.struct(
            *[w[n].alias(n) for n in named],
            F.array_join(F.slice("texts", w["first"] + 1, w["n"]), " ").alias("text"),
        ),
    )
    pieces = (
        raw.select(*book, "texts").join(wanted, book).select(*keys, F.explode(cut).alias("__t")).select(*keys, "__t.*")
    )
    columns = [*keys, "chunk_index", "text", "page_start", "page_end"]
    pieces = materialize(pieces, "pieces")
    crossing = (
        pieces.where("__parts > 1")
        .groupBy(*keys, "chunk_index", "page_start", "page_end")
        .agg(F.sort_array(F.collect_list(F.struct("__part", "text"))).alias("__texts"))
        .withColumn("text", F.array_join(F.col("__texts.text"), " "))
    )
    return pieces.where("__parts = 1").select(*columns).unionByName(crossing.select(*columns))
