"""Exact top-k search by inner product over M-trees.

Inner products become distances by one more component: with M the longest
vector, v' = (v, sqrt(M^2 - v.v)) and q' = (q, 0), the distance of q' and v' falls
as q.v rises.  Vectors are dealt over trees by their nearest of at most
``PIVOTS`` sampled pivots; no tree holds more than a share of its pivot's vectors.
A tree is a table of pages.  A page of an inner node has routing objects, their
covering radii, their distances to the routing object above, and child pages; a
page of a leaf has vectors, their distances to the routing object above and ids.

A search takes the pages of a tree from a queue by the least distance their ball
allows.  Within a page, an entry whose stored distance to the routing object
above differs too much from the query's distance to it cannot come close enough
by the triangle inequality, and its distance is not computed.  The search ends
when the nearest ball left is farther than the k-th best found.  Every query
first searches the tree of its own vector; with the k-th score it has then, it
goes on to those trees only whose ball is near enough.

Equal vectors are one entry with its k + 1 smallest identifiers, for no other can
be among anyone's best k, so a vector that many rows hold costs one entry.
Results are exact: scores are integers and pruning leaves room for rounding.

Vectors that are null, or hold null or non-finite components, and rows without
an identifier take no part.  Shorter vectors count as filled up with zeros.
Empty tables give empty results.  Components may be as large as 64 bits hold;
lengths and distances are doubles, with room for their rounding.  The score of
a pair has to fit 64 bits, but for that of a row with itself, which is not asked
for; pairs past that are ranked by what is left of their score in 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.frames import stored

#: Sampled pivots, and trees at most: both are sent to all tasks.
PIVOTS, MOST_TREES = 128, 4_096
#: Vectors of a tree, unless there would be too many trees; entries of a leaf and of an inner page.
TREE, LEAF, FAN = 16_384, 256, 64
#: Queries that search a tree in one task.
BLOCK = 4_096

_PAGES = (
    "tree long, page int, leaf boolean, vectors array<long>, radii array<double>, "
    "above array<double>, children array<int>, ids array<array<long>>"
)


def scaled(vector: str, factor: float = 256.0) -> Column:
    """Components times ``factor``, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def _usable(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


class _Metric:
    """Distances between vectors that have one more component, as their norms say."""

    def __init__(self, longest: float):
        self.longest = float(longest)

    def more(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (vectors.astype(float) ** 2).sum(axis=-1), 0.0))

    def between(self, vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
        flat = ((vectors - one).astype(float) ** 2).sum(axis=-1)
        return np.sqrt(flat + (self.more(vectors) - self.more(one)) ** 2)


def build_tree(vectors: np.ndarray, ids: list, metric: _Metric, seed: int = 2) -> list[dict]:
    """The pages of an M-tree, loaded from the top down; page 0 is the root."""
    draw = np.random.default_rng(seed)
    pages: list[dict] = []

    def place(some: np.ndarray, center: np.ndarray | None) -> int:
        number = len(pages)
        pages.append({})
        to_center = lambda v: np.zeros(len(v)) if center is None else metric.between(v, center)
        if len(some) <= LEAF:
            pages[number] = {
                "leaf": True, "vectors": vectors[some], "radii": np.zeros(len(some)),
                "above": to_center(vectors[some]), "children": [], "ids": [ids[i] for i in some],
            }
            return number
        chosen = some[draw.choice(len(some), min(FAN, -(-len(some) // LEAF) + 1), replace=False)]
        nearest, least = np.zeros(len(some), int), np.full(len(some), np.inf)
        for k, c in enumerate(chosen):
            distance = metric.between(vectors[some], vectors[c])
            closer = distance < least
            nearest[closer], least[closer] = k, distance[closer]
        groups = [some[nearest == k] for k in range(len(chosen))]
        if max(map(len, groups)) == len(some):  # all at one place
            groups = np.array_split(some, len(chosen))
        groups = [g for g in groups if len(g)]
        centers = np.array([g[0] for g in groups])
        radii = [float(metric.between(vectors[g], vectors[g[0]]).max()) for g in groups]
        children = [place(g, vectors[c]) for g, c in zip(groups, centers)]
        pages[number] = {
            "leaf": False, "vectors": vectors[centers], "radii": np.array(radii),
            "above": to_center(vectors[centers]), "children": children, "ids": [],
        }
        return number

    place(np.arange(len(vectors)), None)
    return pages


def search_tree(pages: list[dict], query: np.ndarray, k: int, metric: _Metric, floor: float) -> list[tuple[int, int]]:
    """The ``k`` best (score, id) of a tree, those with scores under ``floor`` left out."""
    square = float((query.astype(float) ** 2).sum())
    total = square + metric.longest
    slack = 1e-9 * max(total, 1.0)
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
    bar = floor

    def reach() -> float:
        """The distance beyond which nothing can have a score of ``bar``."""
        return np.inf if bar == -np.inf else np.sqrt(max(total - 2 * bar, 0.0) + slack) + 1e-9

    queue, turn = [(0.0, 0, 0, None)], 0
    while queue:
        least, _, number, to_above = heapq.heappop(queue)
        limit = reach()
        if least > limit:
            break
        page = pages[number]
        vectors, radii = page["vectors"], page["radii"]
        if to_above is not None and limit < np.inf:
            near = np.flatnonzero(np.abs(to_above - page["above"]) - radii <= limit)
        else:
            near = np.arange(len(vectors))
        scores = vectors[near] @ query
        if page["leaf"]:
            for i in np.flatnonzero(scores >= bar) if bar > -np.inf else range(len(near)):
                score = int(scores[i])
                for ident in page["ids"][near[i]]:
                    if len(best) < k:
                        heapq.heappush(best, (score, -ident))
                    elif (score, -ident) > best[0]:
                        heapq.heapreplace(best, (score, -ident))
                    else:
                        break
                if len(best) == k:
                    bar = max(floor, best[0][0])
            continue
        # Products with routing objects may not fit 64 bits, those with answers do.
        products = vectors[near].astype(float) @ query.astype(float)
        distances = np.sqrt(np.maximum(total - 2.0 * products, 0.0))
        for i, distance in zip(near.tolist(), distances.tolist()):
            least = max(0.0, distance - radii[i])
            if least <= limit:
                turn += 1
                heapq.heappush(queue, (least, turn, page["children"][i], distance))
    return [(score, -ident) for score, ident in best]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, vector: str = "vector", ident: str = "id"
) -> DataFrame:
    """For each row of ``queries`` its ``k`` best rows of ``vectors`` other than those of its own id.

    Both have ``ident`` and ``vector`` (array of integers); every query's vector is
    also a row of ``vectors``.  Gives query_id, rank, vec_id, score.
    """
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vector"))
    first = Window.partitionBy("vector").orderBy("id")
    grouped = rows.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= k + 1)
    dimensions = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size("vector"))
    entries = stored(
        grouped.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("ids", F.col("vector").alias("own"), F.concat("vector", zeros).alias("vector"))
        .withColumn("entry", F.monotonically_increasing_id()),
        "entries",
    )
    asked = queries.select(F.col(ident).cast("long").alias("query_id"), F.col(vector).alias("own"))
    asked = stored(asked.join(entries.select("own", "entry"), "own").select("query_id", "entry"), "queries")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, longest = entries.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0))).first()
    metric = _Metric(longest)

    # Trees: by the nearest pivot, cut further where a pivot has too many.
    sample = entries.orderBy(F.xxhash64("vector"), "entry").limit(max(1, min(PIVOTS, count // TREE)))
    pivots = np.array([r["vector"] for r in sample.select("vector").collect()], np.int64).reshape(-1, dimensions)
    most = max(TREE, -(-count // (MOST_TREES - PIVOTS)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("vector"), dimensions)
            distances = np.stack([metric.between(points, p) for p in pivots])
            nearest = distances.argmin(axis=0).astype(np.int64)
            columns = [batch.column("entry"), batch.column("vector"), batch.column("ids"), pa.array(nearest)]
            yield pa.RecordBatch.from_arrays(columns, ["entry", "vector", "ids", "pivot"])

    dealt = stored(
        entries.select("entry", "vector", "ids").mapInArrow(
            assign, "entry long, vector array<long>, ids array<long>, pivot long"
        ),
        "dealt",
    )
    held = {r["pivot"]: r["count"] for r in dealt.groupBy("pivot").count().collect()}
    cuts = F.create_map(*[F.lit(x) for p, n in held.items() for x in (p, -(-n // most))]) if held else F.lit(None)
    dealt = dealt.withColumn(
        "tree", F.col("pivot") * MOST_TREES + F.pmod(F.xxhash64("entry"), F.element_at(cuts, F.col("pivot")))
    ) if held else dealt.withColumn("tree", F.col("pivot"))

    def build(key, table):
        points = _matrix(table["vector"].combine_chunks(), dimensions)
        pages = build_tree(points, table["ids"].to_pylist(), metric)
        return pa.table(
            {
                "tree": pa.array([key[0].as_py()] * len(pages), pa.int64()),
                "page": pa.array(range(len(pages)), pa.int32()),
                "leaf": pa.array([p["leaf"] for p in pages]),
                "vectors": pa.array([p["vectors"].ravel() for p in pages], pa.list_(pa.int64())),
                "radii": pa.array([p["radii"] for p in pages], pa.list_(pa.float64())),
                "above": pa.array([p["above"] for p in pages], pa.list_(pa.float64())),
                "children": pa.array([p["children"] for p in pages], pa.list_(pa.int32())),
                "ids": pa.array([p["ids"] for p in pages], pa.list_(pa.list_(pa.int64()))),
            }
        )

    pages = stored(dealt.groupBy("tree").applyInArrow(build, _PAGES), "pages")

    def search(key, wanted, table):
        if not wanted.num_rows or not table.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("entry", "vec_id", "score")})
        opened: list[dict] = [{}] * table.num_rows
        for row in table.to_pylist():
            opened[row["page"]] = {
                **row,
                "vectors": np.array(row["vectors"], np.int64).reshape(-1, dimensions),
                "radii": np.array(row["radii"]),
                "above": np.array(row["above"]),
            }
        found: list[tuple[int, int, int]] = []
        asking = _matrix(wanted["vector"].combine_chunks(), dimensions)
        for entry, floor, query in zip(wanted["entry"].to_pylist(), wanted["bar"].to_pylist(), asking):
            bar = -np.inf if floor is None else floor
            found += [(entry, i, s) for s, i in search_tree(opened, query, k + 1, metric, bar)]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("entry", "vec_id", "score"), columns)})

    def searched(pairs: DataFrame) -> DataFrame:
        """The best of each pair of a query and a tree, the queries of a tree in blocks."""
        blocks = pairs.groupBy("tree").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        left = pairs.join(blocks, "tree").withColumn("block", F.pmod(F.xxhash64("entry"), "blocks").cast("int"))
        right = pages.join(blocks, "tree").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        return (
            left.drop("blocks").groupBy("tree", "block")
            .cogroup(right.drop("blocks").groupBy("tree", "block"))
            .applyInArrow(search, "entry long, vec_id long, score long")
        )

    at_home = asked.select("entry").distinct().join(dealt.select("entry", "vector", "tree"), "entry")
    home = stored(at_home.withColumn("bar", F.lit(None).cast("long")), "home")
    near = stored(searched(home), "near")
    bars = near.groupBy("entry").agg(F.when(F.count("*") > k, F.min("score")).alias("bar"))

    # Root balls: one routing object and radius for each tree, at most MOST_TREES of them.
    def ball(key, table):
        points = _matrix(table["vector"].combine_chunks(), dimensions)
        center = points[0]
        radius = float(metric.between(points, center).max())
        return pa.table(
            {
                "tree": pa.array([key[0].as_py()], pa.int64()),
                "center": pa.array([center], pa.list_(pa.int64())),
                "radius": pa.array([radius], pa.float64()),
            }
        )

    balls = dealt.groupBy("tree").applyInArrow(ball, "tree long, center array<long>, radius double").toArrow()
    trees = balls["tree"].to_numpy()
    centers = np.array(balls["center"].to_pylist(), np.int64).reshape(len(trees), dimensions)
    radii = balls["radius"].to_numpy()

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("vector"), dimensions)
            squares = (points.astype(float) ** 2).sum(axis=1)
            total = squares[:, None] + metric.longest
            products = points.astype(float) @ centers.T.astype(float)
            distance = np.sqrt(np.maximum(total - 2.0 * products, 0.0))
            bar = batch.column("bar").to_numpy(zero_copy_only=False).astype(float)
            reach = np.sqrt(np.maximum(total[:, 0] - 2 * bar, 0.0) + 1e-9 * np.maximum(total[:, 0], 1)) + 1e-9
            reach[np.isnan(bar)] = np.inf
            own = batch.column("tree").to_numpy()
            which, tree = np.nonzero((distance - radii[None, :] <= reach[:, None]) & (own[:, None] != trees[None, :]))
            taken = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [taken.column("entry"), taken.column("vector"), taken.column("bar"), pa.array(trees[tree])],
                ["entry", "vector", "bar", "tree"],
            )

    pairs = stored(
        home.drop("bar").join(bars, "entry", "left").select("entry", "vector", "bar", "tree").mapInArrow(
            others, "entry long, vector array<long>, bar long, tree long"
        ),
        "pairs",
    )
    found = near.unionByName(searched(pairs))
    by = Window.partitionBy("entry").orderBy(F.col("score").desc(), "vec_id")
    best = stored(
        found.withColumn("turn", F.row_number().over(by)).where(F.col("turn") <= k + 1).drop("turn"), "best"
    )
    own = asked.join(best, "entry").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return own.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def nearest_embeddings(
    embeddings: DataFrame, k: int = 5, every: int = 50, factor: float = 256.0,
    vector: str = "embedding", ident: str = "vec_id",
) -> DataFrame:
    """``top_k`` of the rows whose id is divisible by ``every`` among all rows."""
    usable = embeddings.where(F.col(ident).isNotNull() & _usable(vector))
    rows = stored(
        usable.select(F.col(ident).cast("long").alias("id"), scaled(vector, factor).alias("vector")), "vectors"
    )
    return top_k(rows, rows.where(F.col("id") % every == 0), k)
