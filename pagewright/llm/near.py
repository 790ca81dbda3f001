"""Near-duplicates: BagMinHash signatures, bands, verified multiset overlap, classes.

Texts are bags of five-word shingles.  Two are near-duplicates if the sum of
their shingles' smaller counts is at least 0.8 of the sum of the larger ones.

1. Every row gets its fingerprints (of its words) and its signature.  Rows with
   equal words are one node from here on, so copies make no links.
2. ``BANDS`` bands of ``ROWS`` slots make buckets.  Pairs at 0.8 miss every bucket with
   odds of 1 in 20,000.  In each bucket a node is compared with one leader of its
   length class only, which links a group of any size by as many pairs as nodes.
3. Pairs are verified by their exact overlap, and linked nodes form components.
4. What the leaders missed is compared in full: in buckets that still hold more than
   one component, every node outside the bucket's largest component with the nodes
   of the other components, block of nodes against block of nodes, so that only
   verified links leave a task.  No bucket is capped.  Left out are pairs whose
   lengths alone rule 0.8 out (exact) and those whose signatures agree in fewer
   than ``AGREE`` of all slots (odds of 1 in 100,000 at 0.8).

The row with the smallest identifier (null last) of a class stays.  Texts without
words, null ones among them, are one class; texts of fewer than five words have
one shingle, all their words.  Case and the kind of white space do not matter.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.frames import ROW, boxed, known, schema_of, stored, unboxed
from pagewright.llm.shingles import bag_min_hashes, bags, fingerprints, mixed, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Slots in which signatures have to agree; 100 of 125 are expected at 0.8.
AGREE = 80
#: Nodes of a block in full comparisons.
BLOCK = 2_048
#: A sketch has eight bits of each slot, seven slots to a number.
LANES = 7
_ONES, _TOPS = 0x007F7F7F7F7F7F7F, 0x0080808080808080


def _signed(rows: DataFrame) -> DataFrame:
    """Rows with their fingerprints one and two, shingles n, bands and sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = BANDS * ROWS
        salts = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                piece = batch.slice(at, 1_024)
                n = piece.num_rows
                words, per_text = word_hashes(piece.column("text"))
                one, two = fingerprints(words, per_text)
                text, shingle, count = bags(words, per_text, WORDS)
                signature = bag_min_hashes(text, shingle, count, n, slots)
                values = mixed(signature.view(np.uint64))
                bands = np.repeat(salts[None, :], n, axis=0)
                for k in range(ROWS):
                    bands = mixed(bands * np.uint64(31) + values[:, k::ROWS])
                low = np.pad(values & np.uint64(255), ((0, 0), (0, -slots % LANES))).reshape(n, -1, LANES)
                sketch = (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(8))).sum(axis=2, dtype=np.uint64)
                total = np.bincount(text, count, n).astype(np.int64)
                columns = [one, two, total, _lists(bands), _lists(sketch)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(ROW), piece.column("id"), piece.column("line")]
                    + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                    [ROW, "id", "line", "one", "two", "n", "bands", "sketch"],
                )

    more = "one long, two long, n long, bands array<long>, sketch array<long>"
    return rows.mapInArrow(sign, schema_of(rows, [ROW, "id", "line"], more))


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64).ravel()))


def _bags_of(nodes: DataFrame) -> DataFrame:
    """(node, shingles) of nodes with their text; a repeated shingle has a hash for each time."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                words, per_text = word_hashes(piece.column("text"))
                text, shingle, count = bags(words, per_text, WORDS)
                time = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                text, shingle = np.repeat(text, count), np.repeat(shingle, count)
                again = mixed(shingle.astype(np.uint64) * np.uint64(2 * BANDS + 1) + time.astype(np.uint64))
                shingle = np.where(time > 0, again.view(np.int64), shingle)
                order = np.lexsort((shingle, text))
                ends = pa.array(np.searchsorted(text, np.arange(piece.num_rows + 1)).astype(np.int32))
                listed = pa.ListArray.from_arrays(ends, pa.array(shingle[order]))
                yield pa.RecordBatch.from_arrays([piece.column("node"), listed], ["node", "shingles"])

    return nodes.mapInArrow(make, "node long, shingles array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of nodes whose bags overlap enough."""
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    found = stored(_bags_of(texts.join(wanted, "node", "left_semi")), "bags")
    side = lambda k: found.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}"))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy()) for k in ("sx", "sy")]
            alike = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (values[ends[i] : ends[i + 1]] for ends, values in lists)
                where = np.searchsorted(b, a)
                where[where == len(b)] = 0
                both = int((b[where] == a).sum()) if len(b) else 0
                alike[i] = both >= similarity * (len(a) + len(b) - both) - 1e-9
            yield pa.RecordBatch.from_arrays(
                [batch.column("x").filter(pa.array(alike)), batch.column("y").filter(pa.array(alike))], ["x", "y"]
            )

    return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(overlap, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (x, y); the label is the smallest node linked.

    Large and small stars in turn: each hangs the neighbours of every node on the
    smallest of them, until nothing changes.
    """
    edges = stored(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("least"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("least").alias("y"))
        large = stored(large.where("x <> y").distinct(), "stars")
        least = large.groupBy("x").agg(F.min("y").alias("least"))
        hung = large.join(least, "x")
        small = hung.select(F.col("y").alias("x"), F.col("least").alias("y")).union(hung.select("x", "least"))
        edges = stored(small.where("x <> y").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.groupBy("x").agg(F.min("y").alias("label")).select(F.col("x").alias("node"), "label")
    return ends.union(ends.select(F.col("label").alias("node"), "label").distinct())


def _near_enough(x: str, y: str, similarity: float):
    """Lengths that allow the similarity, and signatures that do not speak against it."""
    shorter = F.least(f"{x}.n", f"{y}.n")
    longer = F.greatest(f"{x}.n", f"{y}.n")
    lanes = -(-BANDS * ROWS // LANES)
    agree = F.lit(-(-BANDS * ROWS % LANES))  # lanes without a slot agree always
    for i in range(lanes):
        t = F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))
        # The top bit of each lane is set unless the lane of t is zero.
        some = (t.bitwiseAND(F.lit(_ONES)) + F.lit(_ONES)).bitwiseOR(t).bitwiseAND(F.lit(_TOPS))
        agree = agree + F.lit(LANES) - F.bit_count(some)
    return (shorter >= longer * similarity - 1e-9) & (agree >= AGREE)


def _compared(rows: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """Comparison of the nodes outside each bucket's largest component with all others.

    With ``exact``, the links (x, y) by shingles; else (bucket, node) of the nodes
    that signatures do not rule out.  A large bucket is cut into blocks, and every
    two blocks meet in a task of their own.  A pair counts in its first common bucket.
    """
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = (
        rows.join(blocks, "bucket")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(*rows.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def compare(key, table):
        bucket, i, j = (k.as_py() for k in key)
        table = table.combine_chunks()
        n, node, label, block = (table[c].to_numpy() for c in ("n", "node", "label", "own"))
        outside = label != table["largest"].to_numpy()
        lists = lambda c: table[c].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        sketch, bands = np.ascontiguousarray(lists("sketch")).view(np.uint8), lists("bands")
        here = int(np.flatnonzero(bands[0] == bucket)[0])
        before = bands[:, :here]
        if exact:
            shingles = table["shingles"].combine_chunks()
            values, ends = shingles.flatten().to_numpy(), np.cumsum(np.append(0, n))
        needed = AGREE + sketch.shape[1] - BANDS * ROWS
        found, seen = [], np.zeros(len(node), bool)
        for x in np.flatnonzero(outside).tolist():
            may = (label != label[x]) & (~outside | (node > node[x]))
            may &= (np.minimum(n, n[x]) >= np.maximum(n, n[x]) * similarity - 1e-9)
            if i != j:
                may &= block != block[x]
            some = np.flatnonzero(may)
            some = some[(sketch[some] == sketch[x]).sum(axis=1) >= needed]
            some = some[~(before[some] == before[x]).any(axis=1)]
            if not len(some):
                continue
            if not exact:
                seen[some] = seen[x] = True
                continue
            mine = values[ends[x] : ends[x + 1]]
            sizes = n[some]
            starts = np.cumsum(sizes) - sizes
            theirs = values[np.repeat(ends[some] - starts, sizes) + np.arange(sizes.sum())]
            where = np.searchsorted(mine, theirs)
            where[where == len(mine)] = 0
            both = np.add.reduceat((mine[where] == theirs).astype(np.int64), starts)
            alike = both >= similarity * (n[x] + sizes - both) - 1e-9
            found += [(node[x], y) for y in node[some[alike]]]
        if exact:
            return pa.table({k: pa.array([f[c] for f in found], pa.int64()) for c, k in enumerate("xy")})
        nodes = node[seen]
        return pa.table({"bucket": pa.array(np.full(len(nodes), bucket)), "node": pa.array(nodes)})

    kind = "x long, y long" if exact else "bucket long, node long"
    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, kind).distinct()


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of components after more links (x, y) between nodes."""
    side = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    between = links.join(side("x"), "x", "left").join(side("y"), "y", "left").select(
        F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y")
    )
    # A node without a label so far is its own component.
    now = components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(now, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = now.select(F.col("label").alias("node"), F.col("to").alias("label")).join(labels, "node", "left_anti")
    return stored(old.unionByName(new), "labels")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    ident: str = "doc_id",
    carry: bool = True,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with class_id (identifier of the row that stays), class_size and kept.

    With ``carry`` off, the result has only the identifier and the new columns.
    """
    kept_columns = docs if carry else docs.select(ident, text)
    rows = boxed(kept_columns, id=F.col(ident), text=known(text), line=F.monotonically_increasing_id())
    signed = stored(_signed(rows), "signed")
    key = ["one", "two"]
    nodes = stored(signed.groupBy(*key).agg(F.min("line").alias("node")), "nodes")
    # The row that stands for its node: fingerprints, lengths and bands of all others are the same.
    heads = signed.join(nodes.select(F.col("node").alias("line")), "line", "left_semi")
    texts = heads.select(F.col("line").alias("node"), known(F.col(ROW).getField(text)).alias("text"))
    kinds = heads.where("n > 0").select(
        F.col("line").alias("node"), "n", "sketch",
        F.floor(F.log("n") / F.log(F.lit(1 / similarity))).cast("int").alias("class"), "bands",
    )
    banded = stored(kinds.select("node", F.explode("bands").alias("bucket")), "bands")
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("nodes")).where("nodes > 1").select("bucket")
    members = banded.join(crowded, "bucket")
    shared = stored(members.join(kinds.drop("bands"), "node"), "shared")

    leader = F.min_by(F.struct("node", "n", "sketch"), "node").alias("y")
    leaders = shared.groupBy("bucket", "class").agg(leader)
    # A leader is met by its own length class and by the next one.
    meet = leaders.select("bucket", F.explode(F.array("class", F.col("class") + 1)).alias("class"), "y")
    stars = stored(
        shared.alias("x").join(meet, ["bucket", "class"])
        .where((F.col("x.node") != F.col("y.node")) & _near_enough("x", "y", similarity))
        .select(F.least("x.node", "y.node").alias("x"), F.greatest("x.node", "y.node").alias("y"))
        .distinct(),
        "stars",
    )
    labels = stored(components(_verified(stars, texts, similarity)), "labels")

    parted = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = parted.groupBy("bucket", "label").agg(F.count("*").alias("nodes"))
    largest = (
        sizes.groupBy("bucket")
        .agg(F.max_by("label", F.struct("nodes", "label")).alias("largest"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("bucket", "largest")
    )
    apart = stored(parted.join(largest, "bucket"), "apart")
    full = apart.join(kinds.select("node", "bands"), "node").drop("class")
    involved = stored(_compared(full, similarity, exact=False), "involved")
    left = full.join(involved, ["bucket", "node"], "left_semi")
    bags_ = stored(_bags_of(texts.join(involved.select("node").distinct(), "node", "left_semi")), "bags")
    links = stored(_compared(left.join(bags_, "node"), similarity, exact=True), "links")
    labels = _relabelled(labels, links)

    # What becomes of each row is worked out without the rows, which move once, by their lines.
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "line")
    each = signed.groupBy(*key).agg(F.min(place).alias("best"), F.count("*").alias("size"))
    each = each.join(nodes, key).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = stored(each.select(*key, "label", "best", "size"), "each")
    classes = each.groupBy("label").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    named = stored(each.select(*key, "label").join(classes, "label").drop("label"), "named")
    decided = stored(signed.select("line", *key).join(named, key).select("line", "best", "size"), "decided")
    caller = ROW if carry else F.struct(F.col("id").alias(ident)).alias(ROW)
    return unboxed(
        signed.select("line", caller).join(decided, "line"),
        {
            "class_id": F.col("best.id"),
            "class_size": F.col("size"),
            "kept": F.col("line") == F.col("best.line"),
        },
    )
