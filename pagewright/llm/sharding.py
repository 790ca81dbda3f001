"""Sharding by balanced label propagation: equal texts share a shard, row counts differ by at most one.

Documents with equal texts are linked.  A document's first label is a shard by
hash.  In each round the documents of a group propose to move to the shard where
most of their neighbours are, or to the few such shards that together hold the group.
Groups larger than a shard fill shards one after another before.  Proposals from shard to shard are matched with those the other
way and around cycles, which changes no load; the rest is accepted as the quotas of
rows and the departures allow.  Exactly so many move, drawn by seeded hash.  Each move
brings a group closer together, and rounds end when nothing moves, neither when any
shard may be proposed nor when only those with room may.  The neighbours of a document are counted by (group, shard), and
documents of a group that began and are in the same shard are alike, so rounds
join and sum one small row for each (group, first shard, shard), however many
documents it stands for.  A group with a third of all rows has at most
shards x shards such rows.

Groups that are then still split, though a shard would hold them, are dealt whole, one
after another, to the rows left open, so that only one of them for each border of two
shards stays split.  At the end the counts are made exact: rows above a shard's quota and documents
without links, which cost no edge anywhere, fill what room is left.  Slots are
gapless ranks, made from hashed buckets and their counts.

Null texts count as empty; all empty texts are one group.  Repeated rows are
separate rows.  Fewer rows than shards leave the last shards empty; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.frames import ROW, known, pieces_of, rank_within, stored, unboxed

SHARDS = 24
#: Most rounds of label propagation; None: until nothing moves.
ROUNDS = None
SEED = 10
#: Bytes a stored document has besides its text.
OVERHEAD = 8


def _per_shard(values: dict[int, int], shard: str = "shard"):
    """A constant for each shard, as a column."""
    return F.element_at(
        F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k), int(v))]), F.col(shard)
    )


def matched(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the documents that ask to go from shard to shard may go.

    What leaves a shard makes room there: flows there and back are matched first, then
    longer cycles, neither of which changes a load.  What is left has no cycle, and is
    let in from its ends backwards, as far as ``room`` (quota minus load, which may be
    negative) and the departures settled before allow.
    """
    left: dict[int, dict[int, int]] = {s: {} for s in room}
    for (i, j), n in sorted(asked.items()):
        left[i][j] = n
    taken: dict[tuple[int, int], int] = {}

    def take(i: int, j: int, n: int) -> None:
        taken[i, j] = taken.get((i, j), 0) + n
        left[i][j] -= n
        if not left[i][j]:
            del left[i][j]

    for i, j in sorted(asked):
        both = min(asked[i, j], asked.get((j, i), 0))
        if i < j and both:
            take(i, j, both)
            take(j, i, both)
    ends: dict[int, None] = {}  # shards whose flows lead to earlier ones only
    for start in room:
        path = [] if start in ends else [start]
        while path:
            to = next((j for j in left[path[-1]] if j not in ends), None)
            if to is None:
                ends[path.pop()] = None
            elif to in path:
                cycle = path[path.index(to) :]
                arcs = list(zip(cycle, [*cycle[1:], to]))
                n = min(left[i][j] for i, j in arcs)
                for i, j in arcs:
                    take(i, j, n)
                del path[path.index(to) + 1 :]
            else:
                path.append(to)
    free = dict(room)
    for j in ends:
        for i in room:
            n = min(free[j], left[i].get(j, 0))
            if n > 0:
                take(i, j, n)
                free[i] += n
                free[j] -= n
    return taken


def _wishes(flows: DataFrame, capacity: dict[int, int], held: bool, seed: int) -> DataFrame:
    """``flows`` with to, the shard their documents ask to go to, or null.

    The homes of a group are its largest shards among those with a ``capacity``, as many
    as hold it; ``held``: besides what the group has there.
    """
    at = flows.repartition("group").groupBy("group", "origin", "shard").agg(F.sum("n").alias("n"))
    own = F.sum("n").over(Window.partitionBy("group", "shard"))
    weight = F.struct(F.col("own").alias("n"), F.xxhash64(F.lit(seed), "group", "shard").alias("turn"), "shard")
    every = Window.partitionBy("group")
    at = at.withColumn("own", own).select(
        "*", F.sum("n").over(every).alias("all"), F.sort_array(F.collect_set(weight).over(every), False).alias("tallies")
    )
    if not capacity:
        return at.select("group", "origin", "shard", "n", F.lit(None).cast("int").alias("to"))
    fits = lambda x: F.element_at(
        F.create_map(*[F.lit(v) for s, c in capacity.items() for v in (s, int(c))]), x["shard"]
    ).cast("long") + (x["n"] if held else F.lit(0))
    at = at.withColumn("open", F.filter("tallies", lambda x: x["shard"].isin(*map(int, capacity))))
    before = lambda i: F.aggregate(F.slice("open", 1, i), F.lit(0).cast("long"), lambda s, x: s + fits(x))
    homes = F.when(fits(F.get("open", F.lit(0))) >= F.col("all"), F.slice("open", 1, 1)).otherwise(
        F.filter("open", lambda x, i: before(i) < F.col("all"))
    )
    at = at.withColumn("homes", homes)
    draw = F.pmod(F.xxhash64(F.lit(seed), "group", "origin", "shard"), F.greatest(F.size("homes"), F.lit(1)).cast("long"))
    at = at.withColumn("home", F.get("homes", draw.cast("int")))
    stays = F.exists("homes", lambda x: x["shard"] == F.col("shard"))
    to = F.when(~stays & (F.col("home.n") >= F.col("own")), F.col("home.shard"))
    return at.select("group", "origin", "shard", "n", to.alias("to"))


def _running(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """``df`` with begin: the sum of n over the rows of the same keys before, in hashed buckets by the
    first column of ``order``."""
    cut = df.withColumn("bucket", F.pmod(F.xxhash64(order[0]), F.lit(pieces_of(rows, 20_000))).cast("int"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("m"))
        .select(*keys, "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(starts, [*keys, "bucket"])
    return cut.withColumn("begin", F.col("start") + F.col("inside")).drop("bucket", "start", "inside")


def _dealt(cells: DataFrame, rooms: dict[int, int], rows: int) -> DataFrame:
    """(group, origin, shard, n): the groups of ``cells`` (group, origin, n) one after another in the rooms."""
    pieces, opens = [], 0
    for s, room in rooms.items():
        first, last = F.lit(opens).cast("long"), F.lit(opens + max(0, room)).cast("long")
        n = F.least(F.col("begin") + F.col("n"), last) - F.greatest("begin", first)
        pieces.append(F.struct(F.lit(s).alias("shard"), n.alias("n")))
        opens += max(0, room)
    line = _running(cells.withColumn("one", F.lit(0)), ["one"], ["group", "origin"], rows)
    line = line.select("group", "origin", F.explode(F.array(*pieces)).alias("x"))
    return line.select("group", "origin", "x.shard", "x.n").where("n > 0")


def _closed_up(flows: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """``flows`` with the groups that are still split, though a shard would hold them, dealt one after
    another to the open rows of all shards; only those on the border of two shards are split again."""
    every = Window.partitionBy("group")
    at = flows.repartition("group").groupBy("group", "origin", "shard").agg(F.sum("n").alias("n"))
    fits = (F.size(F.collect_set("shard").over(every)) > 1) & (F.sum("n").over(every) <= max(quotas.values()))
    at = stored(at.withColumn("again", fits), "labels")
    sums = at.groupBy("shard", "again").agg(F.sum("n").alias("n")).collect()
    again = sum(r["n"] for r in sums if r["again"])
    kept = at.where("NOT again").select("group", "origin", "shard", "n")
    if not again:
        return kept
    held = {r["shard"]: r["n"] for r in sums if not r["again"]}
    cells = at.where("again").groupBy("group", "origin").agg(F.sum("n").alias("n"))
    return kept.unionByName(_dealt(cells, {s: q - held.get(s, 0) for s, q in quotas.items()}, again))


def _moved(wishes: DataFrame, moves: dict[tuple[int, int], int], rows: int, seed: int, step: int) -> DataFrame:
    """The flows after exactly ``moves`` of the documents went where they asked to, drawn by hash."""
    move = F.create_map(*[F.lit(x) for (i, j), n in moves.items() for x in (f"{i} {j}", int(n))])
    most = F.coalesce(F.element_at(move, F.concat_ws(" ", "shard", "to")).cast("long"), F.lit(0).cast("long"))
    draw = F.xxhash64(F.lit(seed), F.lit(step), "group", "origin", "shard")
    asking = wishes.where("to IS NOT NULL").withColumn("draw", draw)
    asking = _running(asking, ["shard", "to"], ["draw", "group", "origin"], rows)
    going = F.least(F.greatest(most - F.col("begin"), F.lit(0)), F.col("n"))
    both = F.explode(
        F.array(
            F.struct("shard", (F.col("n") - F.col("going")).alias("n")),
            F.struct(F.col("to").alias("shard"), F.col("going").alias("n")),
        )
    )
    asking = asking.withColumn("going", going).select("group", "origin", both.alias("x"))
    asking = asking.select("group", "origin", "x.shard", "x.n").where("n > 0")
    return wishes.where("to IS NULL").select("group", "origin", "shard", "n").unionByName(asking)


def propagate(
    docs: DataFrame, quotas: dict[int, int], rounds: int | None = ROUNDS, seed: int = SEED
) -> DataFrame:
    """(group, origin, shard, n): where the linked documents of ``docs`` (group, origin) go."""
    cells = docs.groupBy("group", "origin").agg(F.count("*").alias("n"))
    linked = F.sum("n").over(Window.partitionBy("group"))  # one row for each first shard
    flows = stored(
        cells.withColumn("all", linked).where("all > 1").select("group", "origin", F.col("origin").alias("shard"), "n"),
        "labels",
    )
    # Any shard may be asked for, then, where that moves nothing, only those with room, and so in turn.
    room, any_shard, idle, step = dict(quotas), True, 0, 0
    while idle < 2 and (rounds is None or step < rounds):
        capacity = quotas if any_shard else {s: r for s, r in room.items() if r > 0}
        wishes = stored(_wishes(flows, capacity, not any_shard, seed), "wishes")
        sums = wishes.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()
        room = {s: q - sum(r["n"] for r in sums if r["shard"] == s) for s, q in quotas.items()}
        moves = matched({(r["shard"], r["to"]): r["n"] for r in sums if r["to"] is not None}, room)
        if moves:
            total = sum(quotas.values())
            flows = stored(_moved(wishes, moves, total, seed, step), "labels")
            for (i, j), n in moves.items():
                room[i] += n
                room[j] -= n
            idle = 0
        else:
            any_shard = not any_shard
            idle += 1
        step += 1
    return _closed_up(flows, quotas)


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    text: str = "text",
    ident: str = "doc_id",
    carry: bool = True,
    rounds: int | None = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    With ``carry`` off, the result has only the identifier and the new columns,
    and no text is stored.
    """
    plain = known(text)
    rows = stored(
        docs.select(
            (F.struct("*") if carry else F.struct(F.col(ident))).alias(ROW),
            F.col(ident).alias("id"),
            (F.octet_length(plain) + OVERHEAD).cast("long").alias("size"),
            F.crc32(plain).alias("crc"),
            F.unhex(F.sha2(plain, 256)).alias("group"),
            F.monotonically_increasing_id().alias("line"),
        ),
        "documents",
    )
    total = rows.count()
    quotas = {s: total // shards + (s < total % shards) for s in range(shards)}
    # Groups larger than a shard, which are fewer than shards, fill shards one after another.
    counts = rows.groupBy("group").agg(F.count("*").alias("n"))
    large = counts.where((F.col("n") > 1) & (F.col("n") > min(quotas.values()))).collect()
    rooms, begin = {}, sum(r["n"] for r in large)
    for s, quota in quotas.items():
        rooms[s] = quota - min(begin, quota)
        begin -= quota - rooms[s]
    draw = F.xxhash64(F.lit(seed), "id", "line")
    narrow = rows.drop(ROW).withColumn("origin", F.pmod(draw, F.lit(shards)).cast("int"))
    if large:
        is_large = F.col("group").isin(*[bytes(r["group"]) for r in large])
        among, at, first = F.pmod(draw, F.lit(max(1, sum(rooms.values())))), 0, F.lit(None).cast("int")
        for s, room in rooms.items():
            first, at = F.when(among >= at, s).otherwise(first) if room else first, at + room
        narrow = narrow.withColumn("origin", F.when(is_large, F.col("origin")).otherwise(F.coalesce(first, "origin")))
        cells = narrow.where(is_large).groupBy("group", "origin").agg(F.count("*").alias("n"))
        flows = propagate(narrow.where(~is_large), rooms, rounds, seed).unionByName(_dealt(cells, quotas, 1))
    else:
        flows = propagate(narrow, quotas, rounds, seed)

    # The documents of a (group, first shard), in the order of their ids, are dealt to its flows.
    own = Window.partitionBy("group", "origin")
    ends = F.sum("n").over(own.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    places = F.size(F.collect_set("shard").over(Window.partitionBy("group")))  # at most one for each shard
    flows = (
        flows.withColumn("end", ends).withColumn("begin", F.col("end") - F.col("n")).withColumn("split", places > 1)
    )
    turn = narrow.withColumn("turn", F.row_number().over(own.orderBy("id", "line")) - 1)
    dealt = turn.alias("d").join(
        flows.alias("f"),
        (F.col("d.group") == F.col("f.group"))
        & (F.col("d.origin") == F.col("f.origin"))
        & (F.col("turn") >= F.col("begin"))
        & (F.col("turn") < F.col("end")),
        "left",
    )
    placed = stored(
        dealt.select("id", "size", "crc", "line", F.col("f.shard").alias("shard"), "split"), "placed"
    )

    # Groups that are in one shard come first, so that they are not the ones above the quota.
    linked = placed.where("shard IS NOT NULL")
    whole = {r["shard"]: r["n"] for r in linked.where("NOT split").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    after = F.when(F.col("split"), _per_shard({s: whole.get(s, 0) for s in quotas})).otherwise(0)
    ranked = rank_within(linked, ["shard", "split"], ["id", "line"], "turn", total)
    ranked = stored(ranked.withColumn("slot", (F.col("turn") + after).cast("long")).drop("turn", "split"), "linked")
    stay = F.col("slot") < _per_shard(quotas)
    kept = ranked.where(stay)
    held = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    columns = ["id", "size", "crc", "line"]
    rest = placed.where("shard IS NULL").select(*columns).unionByName(ranked.where(~stay).select(*columns))
    rest = rank_within(rest.withColumn("all", F.lit(0)), ["all"], ["id", "line"], "rank", total)
    opens, at = [], 0
    for s, quota in quotas.items():
        opens.append((s, at, held.get(s, 0)))
        at += quota - held.get(s, 0)
    # The last shard whose open slots begin at or before the rank.
    choice = F.filter(
        F.array(*[F.struct(F.lit(s).alias("s"), F.lit(b).cast("long").alias("b"), F.lit(h).cast("long").alias("h")) for s, b, h in opens]),
        lambda o: o["b"] <= F.col("rank"),
    )
    rest = rest.withColumn("open", F.element_at(choice, -1)).select(
        *columns, F.col("open.s").alias("shard"), (F.col("rank") - F.col("open.b") + F.col("open.h")).alias("slot")
    )
    result = kept.select(*columns, "shard", "slot").unionByName(rest)
    outputs = {
        "size": F.col("size"),
        "text_crc32": F.col("crc"),
        "law": F.lit("rows"),
        "shard": F.col("shard"),
        "slot": F.col("slot"),
        "grown_shard": F.lit(None).cast("int"),
    }
    if carry:
        return unboxed(rows.select(ROW, "line").join(result, "line"), outputs)
    return unboxed(result.withColumn(ROW, F.struct(F.col("id").alias(ident))), outputs)
