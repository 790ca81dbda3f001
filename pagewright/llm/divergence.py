"""Source divergence audit: how the word use of the sources of a language differs.

Terms are runs of letters and of all characters outside ASCII; only A-Z are
lower-cased.  A language keeps the V terms that occur in at least ``least`` of
its documents.  A group (language and source, or a whole language) gives a kept
term that it uses n times p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N being its
uses of all kept terms, and two groups differ in a term by
f = floor((p - q)^2 / (p + q)), in whole numbers throughout.

Two sources differ by the sum of f over all kept terms.  Most are used by few
sources, so the sum is begun as if neither source used any term (V times one
value), corrected for the terms that each of them uses, and corrected once more
for those both use.  The last part comes from a frequent-pattern tree: the row
of a term, its sources in order with their counts, is a path; equal rows are one
path with a multiplicity, and terms whose rows begin alike share nodes.  A node
carries the number of terms below it, so each node and each of its ancestors
give one correction, times that number.

The tree is spread by ranges of its paths.  A task sees its paths in order and
holds only the branch it is on: what a path does not share with the next one is
closed, which settles its multiplicity.  A node cut by a range's end counts in
both tasks with what each has seen, and the corrections add up.  Ranges are cut
by hashes of the path's nodes, so what is sampled for them is small.  Documents
are counted by numpy, some megabytes at once; counts are combined again before
they are shuffled.

Null text, language and source count as empty.  A repeated document counts each
time.  Groups without terms have pair rows (value 0 where V is 0).  Texts are
read whole; an empty table gives an empty result.  Columns besides those named
are not read, so none can clash.  At most ``least_rank`` ranks of part ``term``
are given, by value, then by the term's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.frames import known, stored

#: Documents of its language a kept term occurs in, at least.
LEAST = 10
RANKS = 10
BILLION = 1_000_000_000
#: Bytes of text a task counts at once, unless a single text is longer.
PIECE_BYTES = 8 << 20
#: Combinations of a node and an ancestor a task works out at once.
HELD_COMBINATIONS = 200_000

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms as they are or in lower case, all others as blanks.
_PLAIN = bytes(b if b >= 0x80 or b in _LOWER else _LOWER[b - 65] if b in _UPPER else 0x20 for b in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"
CORRECTED = "lang string, source string, item string, value long"


def terms_in(texts: pa.Array) -> pa.ListArray:
    """The terms of texts in UTF-8, in order, with empty ones at the ends of some."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    plain = bytes(memoryview(data)[ends[0] : ends[-1]]).translate(_PLAIN) if data is not None else b""
    buffers = [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(plain)]
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), buffers))


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, uses and documents with it; a term may come in several rows of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            reached = np.cumsum(sizes, dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                before = reached[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(reached, before + PIECE_BYTES, "right")))
                yield _counted(batch.slice(at, end - at))
                at = end

    return docs.select(
        known("lang").alias("lang"), known("source").alias("source"), known("text").alias("text")
    ).mapInArrow(run, COUNTED)


def _counted(piece: pa.RecordBatch) -> pa.RecordBatch:
    numbers: dict[tuple[str, str], int] = {}
    pairs = zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist())
    group = np.array([numbers.setdefault(pair, len(numbers)) for pair in pairs], np.int64)
    lists = terms_in(piece.column("text"))
    coded = lists.flatten().dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:
        doc, code = doc[code != blank], code[code != blank]
    key, uses = np.unique(group[doc] * size + code, return_counts=True)
    once = np.unique(doc * size + code)
    # Each use is in a document, so both have the same keys.
    _, docs = np.unique(group[once // size] * size + once % size, return_counts=True)
    lang, source = (pa.array([pair[i] for pair in numbers], pa.string()) for i in (0, 1))
    at = pa.array(key // size)
    columns = [lang.take(at), source.take(at), coded.dictionary.take(pa.array(key % size)), pa.array(uses), pa.array(docs)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def share(n: str, size: str) -> Column:
    """p of a group of ``size`` = N + 2 V for a term it uses ``n`` times."""
    return F.expr(f"1 + (cast({BILLION} as decimal(10,0)) * cast({n} + 2 as decimal(20,0)) div {size})")


def apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def source_divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: sources by their distance, terms by their excess."""
    counts = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # At most one entry for each source of a language.
    kept = stored(
        counts.groupBy("lang", "term")
        .agg(
            F.sort_array(F.collect_list(F.struct("source", "n"))).alias("uses"),
            F.sum("n").alias("total"),
            F.sum("docs").alias("docs"),
        )
        .where(F.col("docs") >= least)
        .drop("docs"),
        "kept-terms",
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("uses"))
    langs = stored(
        langs.select("lang", "terms", (F.col("uses") + 2 * F.col("terms")).alias("lang_size")), "languages"
    )
    each = kept.select("lang", "term", "total", F.explode("uses").alias("use")).select(
        "lang", "term", "total", "use.source", "use.n"
    )
    used = each.groupBy("lang", "source").agg(F.sum("n").alias("uses"))
    groups = stored(
        docs.select(known("lang").alias("lang"), known("source").alias("source"))
        .distinct()
        .join(used, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), "lang_size",
            (F.coalesce("uses", F.lit(0)) + 2 * F.col("terms")).alias("size"),
        )
        .withColumn("none", F.when(F.col("terms") > 0, share("0", "size"))),
        "groups",
    )
    valued = stored(
        each.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "none", share("n", "size").alias("p"), share("total", "lang_size").alias("q")
        ),
        "valued-terms",
    )
    return _distances(valued, groups).unionByName(_excesses(valued, ranks))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _excesses(valued: DataFrame, ranks: int) -> DataFrame:
    over = valued.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value")
    )
    return _ranked(over).where(F.col("rank") <= ranks)


def _distances(valued: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each source and each other one of its language: as many as the result has."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    pairs = groups.join(other, "lang").where("source <> item")
    base = pairs.select(
        "lang", "source", "item",
        F.coalesce(F.col("terms") * apart("none", "item_none"), F.lit(0)).alias("value"),
    )
    # A term that the source uses n times and the other one never; few n occur.
    alone = valued.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("m")).join(other, "lang")
    alone = (
        alone.where("source <> item")
        .withColumn("value", F.col("m") * (apart("p", "item_none") - apart("none", "item_none")))
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    both = shared_corrections(valued)
    turned = [
        part.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        for part in (alone, both)
    ]
    whole = base
    for part in (alone, both, *turned):
        whole = whole.unionByName(part)
    return _ranked(
        whole.groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )


def shared_corrections(valued: DataFrame) -> DataFrame:
    """lang, source, item and value: corrections of the terms that both sources use, each pair one way round."""
    node = F.struct("source", "p", "none")
    paths = (
        valued.groupBy("lang", "term")
        .agg(F.sort_array(F.collect_list(node)).alias("path"))
        .groupBy("lang", "path")
        .agg(F.count("*").alias("m"))
        .where(F.size("path") > 1)
    )
    # Any order in which paths that begin alike are neighbours will do.
    marked = paths.withColumn("mark", F.transform("path", lambda x: F.xxhash64(x["source"], x["p"])))
    ranges = marked.repartitionByRange("lang", "mark").sortWithinPartitions("lang", "mark")
    return ranges.mapInArrow(_tree, CORRECTED).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corrections of the tree of neighbouring paths, one branch at a time."""
    lang: str | None = None
    names: dict[str, int] = {}  # of this language's sources
    branch: list[tuple[int, int, int]] = []
    below: list[int] = []
    room = np.zeros((3, 64), np.int64)  # the branch as columns: source, p, p of no use
    closed: list[tuple[int, int, int, int, int]] = []
    above: list[np.ndarray] = []
    held = 0

    def corrections() -> pa.RecordBatch:
        nonlocal held
        source, p, p0, m, depth = np.array(closed, np.int64).T
        other, q, q0 = np.concatenate(above, axis=1)
        source, p, p0, m = (np.repeat(column, depth) for column in (source, p, p0, m))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        value = m * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
        pair, place = np.unique(other * len(names) + source, return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, place, value)
        named = pa.array(list(names), pa.string())
        closed.clear()
        above.clear()
        held = 0
        columns = [
            pa.array([lang] * len(pair), pa.string()),
            named.take(pa.array(pair // len(names))),
            named.take(pa.array(pair % len(names))),
            pa.array(total),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])

    def close(depth: int) -> None:
        nonlocal held
        while len(branch) > depth:
            node, m = branch.pop(), below.pop()
            if branch:
                closed.append((*node, m, len(branch)))
                above.append(room[:, : len(branch)].copy())
                held += len(branch)

    for batch in batches:
        for at in range(0, batch.num_rows, 1_000):
            for row in batch.slice(at, 1_000).to_pylist():
                if row["lang"] != lang:
                    close(0)
                    if held:
                        yield corrections()
                    lang = row["lang"]
                    names.clear()
                path = [(names.setdefault(n["source"], len(names)), n["p"], n["none"]) for n in row["path"]]
                alike = next((i for i, (a, b) in enumerate(zip(branch, path)) if a != b), min(len(branch), len(path)))
                close(alike)
                if held > HELD_COMBINATIONS:
                    yield corrections()
                while room.shape[1] < len(path):
                    room = np.concatenate([room, np.zeros_like(room)], axis=1)
                if len(path) > alike:
                    room[:, alike : len(path)] = np.array(path[alike:], np.int64).T
                branch += path[alike:]
                below += [0] * (len(path) - alike)
                for i in range(len(path)):
                    below[i] += row["m"]
    close(0)
    if held:
        yield corrections()


def divergence_sql(least: int = LEAST, ranks: int = RANKS) -> str:
    """The same by comparing all kept terms of all pairs of sources, for DuckDB."""
    return rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents
    ), terms AS (
        SELECT r, lang, source, translate(unnest(words), '{_UPPER.decode()}', '{_LOWER.decode()}') AS term FROM docs
    ), kept AS MATERIALIZED (
        SELECT lang, term, count(*) AS total FROM terms GROUP BY 1, 2 HAVING count(DISTINCT r) >= {least}
    ), counts AS MATERIALIZED (
        SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY 1, 2, 3
    ), groups AS MATERIALIZED (
        SELECT lang, source, coalesce(any_value(v), 0) AS v, (coalesce(sum(n), 0) + 2 * coalesce(any_value(v), 0))::BIGINT AS size
        FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source)
        LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY 1) USING (lang) GROUP BY 1, 2
    ), langs AS (
        SELECT lang, sum(total)::BIGINT + 2 * count(*) AS size FROM kept GROUP BY 1
    ), ps AS MATERIALIZED (
        SELECT lang, source, term, coalesce(n, 0) AS n, (1 + ({BILLION}::HUGEINT * (coalesce(n, 0) + 2)) // size)::HUGEINT AS p
        FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
    ), qs AS (
        SELECT lang, term, (1 + ({BILLION}::HUGEINT * (total + 2)) // size)::HUGEINT AS q FROM kept JOIN langs USING (lang)
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (
            SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))::BIGINT AS value
            FROM ps x JOIN ps y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
        ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    ), excesses AS (
        SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
        FROM ps JOIN qs USING (lang, term) WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT lang, source, part, item, value,
               row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
        FROM (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term' AS part, item, value FROM excesses
        )
    )
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= {ranks}
    """
