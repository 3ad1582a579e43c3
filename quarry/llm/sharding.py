"""Sharding by balanced label propagation.

Linked documents start scattered evenly by a hash, wherever their neighbours are; only groups larger than a quarter of a shard,
four a shard at most, start in shards of their own choice, as no row can see how much room all of such a group needs.
In each round a join brings every document the shards of its neighbours, and it asks to move to the one that holds most of them,
if that is more than its own shard holds. What is asked is counted by pair of shards, and a shard admits what its capacity
leaves room for and as many as leave it in the same round.
The first two rounds look along links in one direction each, which gathers stars at once; later rounds look at all neighbours
and let a half of the documents move, dealt anew each time, so that neighbours do not swap. Two rounds in a row that move few
rows are the last; what counts as few rises by a two-thousandth of the linked rows a round, so that there is an end.
Among those that ask, the larger gain goes first, then a hash of the smallest neighbour decides, which is the same at every size.
Groups that quotas have left in more shards than one, though they would fit, are last packed into the room that whole groups leave.
Documents without links fill up what is left, until counts differ by one at most (the law `rows`).

Equal texts are linked as stars around their smallest member. A group larger than a quarter of a shard is dealt into several
stars, so that no key holds more than a bounded share of the rows, and their hubs are linked, so that the group stands together:
in one shard where it fits, else in as few as hold it, if others leave room.

Defined results: shards depend on ids and texts alone, not on the order of rows or files; null texts have no bytes and no links; ids
may be null or repeat, each row is placed; ties go to the
smaller shard; with fewer rows than shards some shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bucket_of, discard, kept, ranked, scratch, written

#: Rows that one task sorts when ranks are made.
PER_BUCKET = 50_000
#: Groups of more than this part of a shard are packed one by one in the repair.
FINE = 64
#: Groups of more than this part of a shard are packed before the first round.
QUARTER = 4


def equal_text_links(nodes: DataFrame, key: str, most: int) -> DataFrame:
    """(a, b), a > b: stars over the rows of equal key, of `most` rows or so each, and the hubs of one key in a star around their smallest. nodes: uid and key, written."""
    rows = nodes.filter(F.col(key).isNotNull()).select("uid", F.col(key).alias("key"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)  # all rows over `most` of them at most
    dealt = rows.join(F.broadcast(large), "key", "left").select("uid", "key", F.coalesce(F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / most)), F.lit(0)).alias("part"))
    hubs = written(dealt.groupBy("key", "part").agg(F.min("uid").alias("hub"), F.count(F.lit(1)).alias("n")), "shard-hubs")
    leaves = dealt.join(hubs.filter("n > 1").drop("n"), ["key", "part"]).filter("uid <> hub").select(F.col("uid").alias("a"), F.col("hub").alias("b"))
    first = hubs.groupBy("key").agg(F.min("hub").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")  # as many as `large` at most
    return leaves.unionByName(hubs.join(F.broadcast(first), "key").filter("hub <> first").select(F.col("hub").alias("a"), F.col("first").alias("b")))


def packed(sizes: list[tuple[int, int]], shards: int, capacity: int, room: list[int] | None = None) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """(group, from, to, shard) for groups given as (group, rows), largest first, and the room left by shard.

    room: what shards have left to begin with, else `capacity` each. What fills a shard takes one of its own; a rest goes whole to the first shard with room, and in parts only where there is none.
    """
    capacity = max(1, capacity)
    room, out, rests = [capacity] * shards if room is None else [max(0, x) for x in room], [], []
    for group, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = 0
        while n - at >= capacity and capacity in room:
            s = room.index(capacity)
            out.append((group, at, at + capacity, s))
            room[s], at = 0, at + capacity
        if at < n:
            rests.append((n - at, group, at))
    for n, group, at in sorted(rests, key=lambda x: (-x[0], x[1])):
        end = at + n
        while at < end:
            fits = [s for s in range(shards) if room[s] >= end - at]
            s = fits[0] if fits else max(range(shards), key=lambda x: (room[x], -x))
            most = min(end - at, room[s]) or end - at  # nowhere any room: fewer rows than shards are left over
            out.append((group, at, at + most, s))
            room[s], at = max(0, room[s] - most), at + most
    return out, room


def admitted(asked: dict[tuple[int, int], int], full: list[int], capacity: int) -> dict[tuple[int, int], int]:
    """How many of the moves asked by pair of shards are made: each shard takes what it has room for and what leaves it."""
    made = dict(asked)
    into, out = [0] * len(full), [0] * len(full)
    for (s, t), n in made.items():
        into[t] += n
        out[s] += n
    over = True
    while over:
        over = False
        for t in range(len(full)):
            excess = into[t] - out[t] - max(0, capacity - full[t])
            total = into[t]
            for s in range(len(full)):
                if excess <= 0:
                    break
                if n := made.get((s, t), 0):
                    cut = min(n, -(-n * excess // total))
                    total, excess, over = total - n, excess - cut, True
                    made[s, t], into[t], out[s] = n - cut, into[t] - cut, out[s] - cut
    return made


def _groups(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (uid, near): stars (root, near, n) by near, and groups (root, n); the root is the near of near. Written."""
    stars = state.groupBy("near").agg(F.count(F.lit(1)).alias("n"))
    roots = state.select(F.col("uid").alias("near"), F.col("near").alias("root"))
    stars = written(stars.join(roots, "near").select("root", "near", "n"), "shard-stars")  # a near is linked, so it has a row
    return stars, written(stars.groupBy("root").agg(F.sum("n").alias("n")), "shard-groups")


def _pieces(state: DataFrame, stars: DataFrame, found: list[tuple[int, int, int, int]]) -> DataFrame:
    """(uid, shard, near) for the rows of the groups that `packed` has placed."""
    kind = state.schema["uid"].dataType.simpleString()
    pieces = state.sparkSession.createDataFrame(found, f"_root {kind}, _from long, _to long, shard int")
    before = Window.partitionBy("root").orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    mine = stars.join(F.broadcast(pieces.select(F.col("_root").alias("root")).distinct()), "root", "left_semi").withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    row = F.col("_at") + F.row_number().over(Window.partitionBy("near").orderBy("uid")) - 1  # rows, not stars, so that no shard takes more than its piece
    rows = state.select("uid", "near").join(mine.drop("n"), "near").withColumn("_at", row)
    return rows.join(F.broadcast(pieces), (F.col("root") == F.col("_root")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).select("uid", "shard", "near")


def _spread(at: str, rows: int, room: list[int]) -> Column:
    """The shard of the one numbered `at` of `rows`, dealt in order over the room of the shards."""
    room = room if sum(room) else [1] * len(room)
    ends = [sum(room[: s + 1]) for s in range(len(room))]
    place = F.floor(F.col(at) * F.lit(ends[-1]) / F.lit(rows))
    return F.size(F.filter(F.array(*[F.lit(x) for x in ends[:-1]]), lambda e: e <= place)).alias("shard")


def _started(state: DataFrame, shards: int, capacity: int) -> DataFrame:
    """state (uid, near) with the shard in which each row starts: scattered by a hash of uid, but for groups over a quarter of a shard."""
    stars, groups = _groups(state)
    large = groups.filter(F.col("n") > max(1, capacity // QUARTER))
    found, room = packed([(r["root"], r["n"]) for r in large.collect()], shards, capacity)  # under QUARTER groups a shard of linked rows
    rest = state.join(stars.join(F.broadcast(large.select("root")), "root", "left_anti").select("near"), "near")
    n = rest.count()
    scattered = ranked(rest, [], ["uid"], [], max(1, -(-n // PER_BUCKET))).select("uid", _spread("rank", max(1, n), room), "near")
    return _pieces(state, stars, found).unionByName(scattered)


def repaired(state: DataFrame, shards: int, capacity: int) -> DataFrame:
    """state (uid, shard, near) in which groups that lie in several shards, though one could hold them, are packed into the room of all others.

    The larger are packed one by one, the smaller follow one another in the order of their roots, so that each shard's end cuts one at most.
    """
    stars, groups = _groups(state)
    lies = state.join(stars.select("near", "root"), "near").groupBy("root").agg(F.countDistinct("shard").alias("k"))
    cut = written(groups.join(lies, "root").filter((F.col("k") > 1) & (F.col("n") <= capacity)).select("root", "n"), "shard-cut")
    if cut.isEmpty():
        return state
    moving = stars.join(cut.select("root"), "root", "left_semi")
    stays = written(state.join(moving.select("near"), "near", "left_anti").select("uid", "shard", "near"), "shard-whole")
    full = {r["shard"]: r["count"] for r in stays.groupBy("shard").count().collect()}  # a number per shard
    large = F.col("n") > max(1, capacity // FINE)
    found, room = packed([(r["root"], r["n"]) for r in cut.filter(large).collect()], shards, capacity, [capacity - full.get(s, 0) for s in range(shards)])  # under FINE groups a shard
    again = _pieces(state, moving, found)
    small = cut.filter(~large)
    rest = small.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if rest:
        small = small.withColumn("_b", bucket_of("root", n=max(1, -(-rest // PER_BUCKET))))
        starts = small.groupBy("_b").agg(F.sum("n").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        at = F.col("_start") + F.coalesce(F.sum("n").over(Window.partitionBy("_b").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        small = small.join(F.broadcast(starts.drop("_n")), "_b").withColumn("_at", at).select("root", _spread("_at", rest, room))
        again = again.unionByName(state.select("uid", "near").join(moving.join(small, "root").select("near", "shard"), "near").select("uid", "shard", "near"))
    return written(stays.unionByName(again), "shard-state")


def propagated(links: DataFrame, shards: int, capacity: int, rounds: int | None = None, buckets: int = 1, report: list[tuple[int, int]] | None = None) -> DataFrame:
    """(uid, shard, near) for every linked row; near: its smallest neighbour or itself, which keeps neighbours in rank together.

    report: takes the rows moved and the links still cut, by round. links: (a, b) with a > b, written. No shard admits more than leaves it with `capacity` linked rows. Without `rounds`, two rounds
    in a row that move few rows are the last; what counts as few rises by a two-thousandth of the rows a round, so there is an end.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = written(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.col("a")).alias("near")), "shard-near")
    linked = state.count()
    near = state
    state = written(_started(near, shards, capacity), "shard-state")
    discard(near)
    if report is not None:
        report.append((0, cut_links(links, state).first()["cut"]))
    still = 0
    for i in count() if rounds is None else range(rounds):
        down, up = links.select(F.col("a").alias("uid"), F.col("b").alias("by")), links.select(F.col("b").alias("uid"), F.col("a").alias("by"))
        way = (down, up)[i] if i < 2 else down.unionByName(up).filter(F.pmod(F.xxhash64("uid", F.lit(i)), F.lit(2)) == 0)
        seen = way.join(state.select(F.col("uid").alias("by"), F.col("shard").alias("to")), "by")
        votes = seen.groupBy("uid", "to").agg(F.count(F.lit(1)).alias("n"))
        asked = votes.join(state, "uid").groupBy("uid", "shard", "near").agg(F.max(F.struct("n", (-F.col("to")).alias("to"))).alias("best"), F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("n"))), F.lit(0)).alias("own"))
        asked = written(asked.filter("best.n > own").select("uid", "near", "shard", (-F.col("best.to")).alias("to"), (F.col("best.n") - F.col("own")).alias("gain")), "shard-asked")
        pairs = {(r["shard"], r["to"]): r["count"] for r in asked.groupBy("shard", "to").count().collect()}  # a number per pair of shards
        moved = 0
        if pairs:
            full = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}  # a number per shard
            made = admitted(pairs, [full.get(s, 0) for s in range(shards)], capacity)
            moved = sum(made.values())
        if moved:
            most = F.broadcast(spark.createDataFrame([(*k, n) for k, n in made.items()], "_s int, _t int, most long"))
            moves = ranked(asked, ["shard", "to"], ["near"], ["uid"], buckets, lead=[-F.col("gain")])
            moves = moves.join(most, (F.col("shard") == F.col("_s")) & (F.col("to") == F.col("_t"))).filter(F.col("rank") < F.col("most"))
            moves = written(moves.select("uid", "to"), "shard-moves")
            before, state = state, written(state.join(moves, "uid", "left").select("uid", F.coalesce("to", "shard").alias("shard"), "near"), "shard-state")
            discard(before, moves)
        discard(asked)
        if report is not None:
            report.append((moved, cut_links(links, state).first()["cut"]))
        still = still + 1 if moved <= (0 if rounds is not None else linked * i // 2000) else 0
        if still == 2:
            break
    return state


def balanced(nodes: DataFrame, state: DataFrame, shards: int, total: int, order: list[str]) -> DataFrame:
    """nodes with shard: linked rows keep theirs up to its size, all others fill the gaps. Sizes differ by one at most."""
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    per = max(1, -(-total // shards // PER_BUCKET))
    linked = ranked(state, ["shard"], ["near"], ["uid"], per)
    size = F.array(*[F.lit(x) for x in sizes])
    stays = written(linked.filter(F.col("rank") < F.get(size, F.col("shard"))).select("uid", "shard"), "shard-stays")
    kept = {r["shard"]: r["count"] for r in stays.groupBy("shard").count().collect()}  # a number per shard
    ends, at = [], 0
    for s in range(shards):
        at += sizes[s] - kept.get(s, 0)
        ends.append(at)
    pool = nodes.join(stays, "uid", "left_anti")
    dealt = ranked(pool, [], order, [], max(1, -(-total // PER_BUCKET)))
    placed = dealt.withColumn("shard", F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda e: e <= F.col("rank")))).select("uid", "shard")
    return nodes.join(stays.unionByName(placed), "uid")


def assign(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", rounds: int | None = None, report: list[tuple[int, int]] | None = None) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes and 16), text_crc32, shard, slot (gapless in its shard, from 0)."""
    t = F.col(text)
    with scratch() as made:
        own = docs.select(F.col(id), (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("key"))
        own = written(own, "shard-rows")
        total = own.count()
        per = max(1, -(-total // shards // PER_BUCKET))
        # a number by id and text, which does not depend on files: rows equal in both may change places
        nodes = written(ranked(own, [], [id, "key"], [], max(1, -(-total // PER_BUCKET)), "uid"), "shard-nodes")
        links = written(equal_text_links(nodes, "key", max(2, total // (4 * shards))), "shard-links")
        state = repaired(propagated(links, shards, total // shards, rounds, per, report), shards, total // shards)
        placed = kept(made, written(balanced(nodes.drop("key"), state, shards, total, [id, "uid"]), "shard-placed"))
    return ranked(placed, ["shard"], [id, "uid"], [], per, "slot").select(id, "size", "text_crc32", "shard", "slot")


def cut_links(links: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: how many links there are, and how many join different shards."""
    a, b = placed.select(F.col("uid").alias("a"), F.col("shard").alias("s")), placed.select(F.col("uid").alias("b"), F.col("shard").alias("t"))
    return links.join(a, "a").join(b, "b").agg(F.count(F.lit(1)).alias("links"), F.sum((F.col("s") != F.col("t")).cast("long")).alias("cut"))


def group_spread(groups: DataFrame, placed: DataFrame, key: str = "key") -> DataFrame:
    """By key with several rows: rows, shards, and cut: rows outside the shard that holds most of them. groups: uid and key, undealt."""
    per = groups.filter(F.col(key).isNotNull()).join(placed.select("uid", "shard"), "uid").groupBy(key, "shard").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("shards"), (F.sum("n") - F.max("n")).alias("cut")).filter("rows > 1")
