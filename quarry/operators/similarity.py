"""Exact and near duplicates of claims, cosine retrieval, evidence quality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quarry.operators.components import components
from quarry.operators.products import search
from quarry.storage import discard, written


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0.0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def classes(rows: DataFrame, id: str, claim: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per different claim and group: rep (its smallest id), n, sha. Claims are compared by the digest of their normalised text, so texts are not shuffled."""
    return rows.filter(F.col(claim) != "").groupBy(*group, F.sha2(claim, 256).alias("sha")).agg(F.min(id).alias("rep"), F.count(F.lit(1)).alias("n"))


def _sets(rows: DataFrame, id: str, tokens: str, group: Sequence[str]) -> DataFrame:
    """(group, id, sha, set): the digest of a row's tokens in their order and their 64-bit hashes, each once. Tokens are made once a row."""
    both = F.get(F.transform(F.array(tokens), lambda t: F.struct(F.unhex(F.sha2(F.array_join(t, " "), 256)).alias("sha"), F.array_distinct(F.transform(t, lambda w: F.xxhash64(w))).alias("set"))), 0)
    return rows.select(*group, F.col(id).alias("id"), both.alias("_of")).select(*group, "id", "_of.sha", "_of.set")


def _bounds(most: int, threshold: float, least: int) -> np.ndarray:
    """The smallest sizes of the classes of sets, from `least` to beyond `most`: a class and the next hold all sizes that two similar sets can have."""
    found = [least]
    while len(found) < 3 or found[-2] <= most:  # a set's class, and the next with its end
        found.append(int(found[-1] / threshold**3 + 1e-9) + 1)
    return np.array(found, np.int64)


def _hashed(x: np.ndarray) -> np.ndarray:
    """The last step of SplitMix64, on unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _marks(sets: DataFrame, group: Sequence[str], threshold: float, least: int) -> DataFrame:
    """sets (group, id, sha, set), but for empty ones, with n and marks in place of set: two similar sets of a group, of `least` tokens or more, share a mark.

    Sets of n and m tokens at the threshold differ in (1 - t) / (1 + t) * (n + m) of them at most. Tokens are dealt by their hash into one part
    more than that, so that one part holds the same tokens in both, and a mark stands for what a part holds. How many parts there are
    goes by the class of the larger set; sets near the end of their class bear the marks of the next one too. The lowest bit of a mark says
    that it is of the set's own class.
    """

    def of_class(flat: np.ndarray, row: np.ndarray, seed: np.ndarray, at: np.ndarray, bounds: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        parts = ((1 - threshold) / (1 + threshold) * 2 * (bounds[at + 1] - 1) + 1e-6).astype(np.int64) + 1
        first = np.cumsum(parts) - parts
        place = first[row] + ((flat >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, place, _hashed(flat))  # order does not count
        of = np.repeat(np.arange(len(parts)), parts)
        named = _hashed(seed[of] + (at[of] * 1_000_003 + np.arange(len(of)) - first[of]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return of, (_hashed(sums + named) & np.uint64(0xFFFFFFFFFFFFFFFE)) | np.uint64(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                lists = b.column("set")
                n = np.diff(lists.offsets.to_numpy())
                flat, row, seed = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(n)), n), b.column("seed").to_numpy().view(np.uint64)
                bounds = _bounds(int(n.max()), threshold, least)
                at = np.searchsorted(bounds, n, "right") - 1
                found = []
                for own in (1, 0):  # the next class is for sets that may be similar to some in it
                    bear = (n >= least) & ((own == 1) | (n >= threshold * bounds[at + 1] - 1e-9))
                    held, number = bear[row], np.cumsum(bear) - 1
                    of, marks = of_class(flat[held], number[row[held]], seed[bear], at[bear] + 1 - own, bounds, own)
                    found.append((np.flatnonzero(bear)[of], marks))
                of, marks = (np.concatenate(x) for x in zip(*found, strict=True))
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(marks[np.argsort(of, kind="stable")].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n.astype(np.int32)), listed], names=[*names, "n", "marks"]).filter(pa.array(n > 0))

    names = [*group, "id", "sha"]
    plain = sets.select(*names, "set", F.xxhash64(*group).alias("seed"))
    return plain.mapInArrow(run, ", ".join([*(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in names), "n int, marks array<bigint>"]))


def _dealt(placed: DataFrame, block: int) -> DataFrame:
    """placed (id, n, mark) with part and side: rows of a mark that over `block` rows bear meet in pairs of blocks, each pair a part of its own, with sides 1 and 2; a block alone has side 0.

    Marks are counted on every sixteenth set where blocks are large, as a count only decides how rows are dealt.
    """
    share = 16 if block >= 1024 else 1
    counted = placed.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).groupBy("mark").count().filter(F.col("count") * share > block)
    hot = written(counted.select("mark", F.ceil(F.col("count") * share / block).cast("int").alias("_k")), "token-hot")
    if hot.isEmpty():
        return placed.withColumns({"part": F.lit(0), "side": F.lit(0)})
    k = F.coalesce("_k", F.lit(1))
    own = F.pmod(F.xxhash64("id", F.lit(1)), k).cast("int")
    parts = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((F.least(own, j) * k + F.greatest(own, j)).alias("part"), F.when(j == own, 0).when(own < j, 1).otherwise(2).alias("side")))
    return placed.join(F.broadcast(hot), "mark", "left").withColumn("_p", F.explode(parts)).select("id", "n", "mark", "_p.part", "_p.side")  # hot: one row in `block` rows at most


def _met(dealt: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, as often as met: sets of one mark and part, not on one side, whose sizes can be similar. n is below 0 where the mark is of the class above."""

    def pairs(held: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mark, part, n, side = (held.column(c).to_numpy() for c in ("mark", "part", "n", "side"))
        new = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (part[1:] != part[:-1])]))
        end = np.repeat(np.append(new[1:], len(mark)), np.diff(np.append(new, len(mark))))
        size, at, step = np.abs(n), np.arange(len(mark)), 1
        while len(at := at[at + step < end[at]]):
            to = at + step
            fit = ((n[at] > 0) | (n[to] > 0)) & ((side[at] == 0) | (side[at] != side[to])) & (np.minimum(size[at], size[to]) >= threshold * np.maximum(size[at], size[to]) - 1e-9)
            if fit.any():
                yield pa.RecordBatch.from_arrays([held.column("id").take(pa.array(at[fit])), held.column("id").take(pa.array(to[fit]))], names=["a", "b"])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the rows of the last mark, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            held = b if rest is None else pa.concat_batches([rest, b])
            mark, part = held.column("mark").to_numpy(), held.column("part").to_numpy()
            cut = int(np.flatnonzero((mark != mark[-1]) | (part != part[-1])).max(initial=-1)) + 1
            if cut:
                yield from pairs(held.slice(0, cut))
            rest = held.slice(cut)
        if rest is not None:
            yield from pairs(rest)

    rows = dealt.repartition("mark", "part").sortWithinPartitions("mark", "part", "id")
    id = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {id}, b {id}")


def _named(sets: DataFrame, near: DataFrame, places: int) -> DataFrame:
    """The sets that near names, stored, and some others: a table of `places` bits tells them before tokens are made, and is sent to the tasks. All of them without places."""
    if not places:
        return written(sets, "token-named")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(places))
    ids = near.select((at("a") + 1).alias("at")).union(near.select(at("b") + 1))
    bits = ids.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()  # `places` bits at most
    table = np.zeros((-(-places // 32768), 4096), np.uint8)  # Spark counts places from 1
    for bucket, said in zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True):
        table[bucket - 1] = np.frombuffer(said, np.uint8)
    sent = sets.sparkSession.sparkContext.broadcast(table.reshape(-1))

    @F.arrow_udf(BooleanType())
    def told(place: pa.Array) -> pa.Array:
        x = place.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[x >> 3] >> (x & 7)) & 1 == 1)

    done = written(sets.filter(told(at("id"))), "token-named")
    sent.destroy()
    return done


def _candidates(marks: DataFrame, sets: DataFrame, group: Sequence[str], threshold: float, block: int, most_sent: int, once: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b) of marked sets that share a mark, and the sets that they name; once: sets of equal digest and group stand as one, by its smallest id."""
    known = lambda df: df.dropna(subset=list(group)) if group else df
    marks = known(marks).filter(F.size("marks") > 0)
    if once:
        marks = marks.groupBy(*group, "sha").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("marks").alias("marks"))
    one = written(marks.select("id", "n", "marks"), "token-marks")
    placed = one.select("id", "n", F.explode("marks").alias("m")).select("id", F.when(F.col("m").bitwiseAND(1) == 1, F.col("n")).otherwise(-F.col("n")).alias("n"), F.shiftrightunsigned("m", 1).alias("mark"))
    near = written(_met(_dealt(placed, block), threshold).filter("a < b").distinct(), "token-near")
    discard(one)
    return near, _named(known(sets).select(*group, "id", "set"), near, 64 * most_sent)


def _compared(near: DataFrame, named: DataFrame, group: Sequence[str], threshold: float) -> DataFrame:
    """(group, a, b, jaccard) of the pairs whose sets reach the threshold."""
    of = lambda x: named.select(*group, F.col("id").alias(x), F.col("set").alias(f"_s{x}"))
    return near.join(of("a"), "a").join(of("b"), [*group, "b"]).withColumn("jaccard", jaccard(F.col("_sa"), F.col("_sb"))).filter(F.col("jaccard") >= threshold).select(*group, "a", "b", "jaccard")


def similar_pairs(rows: DataFrame, id: str, tokens: str, group: Sequence[str], threshold: float, least: int, block: int = 4096, most_sent: int = 1_000_000, once: bool = False) -> DataFrame:
    """(group, a, b, jaccard), a < b: all pairs of sets of `least` tokens or more within a group at the threshold. Tokens are compared by 64-bit hashes.

    Sets this similar share one of some marks, each of which stands for a part of a set (_marks), so few others meet; those that do are
    compared exactly. Only marks and the sets to be compared, whose tokens are made anew, are stored and shuffled. Marks that over `block` sets bear are dealt out in blocks.
    What tells the sets to be compared takes `most_sent` words of 64 bits, which are sent to the tasks. once: rows of equal tokens in equal
    order and group stand as one, by its smallest id.
    """
    sets = _sets(rows, id, tokens, group)
    return _compared(*_candidates(_marks(sets, group, threshold, least), sets, group, threshold, block, most_sent, once), group, threshold)


def duplicate_groups(rows: DataFrame, id: str, tokens: str, group: Sequence[str], threshold: float = 0.92, least: int = 5) -> DataFrame:
    """(id, group_id, n_members, kind) for rows in a group of two or more; group_id is the smallest id of the group.

    Claims are tokens in their order; a row without any is in no group. Equal claims belong together in any group, near ones within their
    own; a component is `near` if it holds different claims.
    """
    sets = _sets(rows, id, tokens, group)
    member = written(_marks(sets, group, threshold, least), "members")
    near, named = _candidates(member, sets, group, threshold, 4096, 1_000_000, True)
    # one pair of each set is compared first; what these bring together already needs no further comparing, as a large group's pairs would
    links = written(_compared(near.groupBy("b").agg(F.min("a").alias("a")), named, group, threshold).select("a", "b"), "links")
    of = components(links)
    root = lambda x: of.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
    apart = near.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    rest = written(_compared(written(apart, "apart"), named, group, threshold).select("a", "b"), "links")
    everywhere = written(member.groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "claims")  # stored, so that a very common claim's join can be split
    own = member.groupBy(*group, "sha").agg(F.min("id").alias("b")).groupBy("sha").agg(F.min("b").alias("a"), F.collect_set("b").alias("b")).filter(F.size("b") > 1)  # a claim's smallest id in each group
    of = components(links.union(rest).union(own.select("a", F.explode("b").alias("b"))))
    discard(near, named, links, rest)
    roots = written(everywhere.join(of, everywhere["rep"] == of["node"], "left").select("sha", "n", F.coalesce("root", "rep").alias("group_id")), "roots")
    sizes = roots.groupBy("group_id").agg(F.sum("n").alias("n_members"), F.when(F.count(F.lit(1)) > 1, "near").otherwise("exact").alias("kind")).filter("n_members > 1")
    kinds = written(roots.join(sizes, "group_id").select("sha", "group_id", "n_members", "kind"), "groups")
    discard(everywhere, roots)
    return member.select(F.col("id").alias(id), "sha").join(kinds, "sha").select(id, "group_id", "n_members", "kind")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; lengths must agree, and a zero vector has no direction: both give null, which strict callers reject."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def evidence_quality(similarity: Column, low: float = 0.45, span: float = 0.40) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - low) / span)), 4)


def retrieve(rows: DataFrame, id: str, vector: str, query: Column, k: int, items: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank): for each row where `query` holds the k most similar other rows, or of `items` where given, which has the columns of rows; ties to the smaller id.

    Vectors are scaled to length one, and their products taken tile by tile (quarry.operators.products); those of length zero take no part.
    """
    def unit(df: DataFrame) -> DataFrame:
        v = F.transform(vector, lambda x: x.cast("double"))
        # the length is bound by the end of the fold, so it is taken once a vector; as a column it would be taken anew for every component
        scaled = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x, lambda s: F.when(s > 0, F.transform("v", lambda x: x / F.sqrt(s))))
        return df.select(F.col(id).alias("id"), F.coalesce(query, F.lit(False)).alias("asks"), v.alias("v")).withColumn("v", scaled).filter("v is not null")

    found = search(unit(rows), "id", "v", F.col("asks"), k, items=None if items is None else unit(items))
    return found.select("query_id", F.col("vec_id").alias("item_id"), F.col("score").alias("similarity"), "rank")
