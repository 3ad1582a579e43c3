"""SimHash near-duplicates by anchor-point covering.

Two fingerprints within three of 64 bits agree up to one bit on one of their halves. The anchors of a half are the
codewords of the perfect [31,26] Hamming code, which cover all 31-bit words with radius one. Each fingerprint goes to every
anchor within that radius plus the threshold of one bit, at most 16 a half, so that any linked pair meets at an anchor.
Fingerprints are compared per anchor, all 64 bits at once; links become components by rounds of star joins.

Defined results: a null text and a text without words have fingerprint zero, which links like any other; a text of fewer than
`words` words is one shingle; equal fingerprints are one class, however many rows hold them; repeated rows are kept; an empty
table gives an empty result; a component of null ids alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, bucket_of, kept, scratch, slices, small_batches, tidy, written
from quarry.operators.components import components

BITS = 31
#: Members of one anchor that one task compares; more are dealt out in blocks.
BLOCK = 8192


def shingles(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; a text of fewer words is one shingle, one without words has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, h = len(found) - words + 1, xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 255 * 256):
        part = hashes[i : i + 255 * 256]
        part = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 255, 8), axis=2, bitorder="little")
        ones += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    return majority(shingles(text, words, seed))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per document: id, fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000, 16 << 20):
            texts = b.column(1).cast(pa.binary() if b.column(1).type == pa.string() else pa.large_binary())
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["id", "fingerprint"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, fingerprint long")


def _flips() -> np.ndarray:
    """By syndrome, the words of weight up to two that have it: 16 each, for syndrome zero the zero word again and again."""
    table = np.zeros((BITS + 1, 16), np.uint64)
    for s in range(1, BITS + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, BITS + 1) if i < i ^ s and i ^ s]
        table[s] = [1 << (s - 1), *pairs]
    return table


def anchors(prints: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) for both halves of each fingerprint; halves are numbered from `first`."""
    out, rows, flips = [], [], _flips()
    for half in (first, first + 1):
        word = (prints >> np.uint64(32 * (half - first))) & np.uint64(2**BITS - 1)
        syndrome = np.zeros(len(word), np.int64)
        for i in range(BITS):
            syndrome ^= ((word >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
        near = (word[:, None] ^ flips[syndrome]) | np.uint64(half << 32)
        real = np.ones(near.shape, bool)
        real[syndrome == 0, 1:] = False
        out.append(near[real])
        rows.append(np.repeat(np.arange(len(word)), real.sum(axis=1)))
    return np.concatenate(out), np.concatenate(rows)


def _placed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, row = anchors(prints)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(prints[row].view(np.int64))], names=["anchor", "fingerprint"])

    return classes.select("fingerprint").mapInArrow(tidy(run), "anchor long, fingerprint long")


class _Forest:
    """Links already implied by earlier ones of this task are not sent on; forgetting them merely sends more."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def joins(self, a: int, b: int) -> bool:
        if len(self.up) > 1_000_000:
            self.up.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))
        return a != b


def _within(members: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is linked among the members, in blocks of bounded size."""
    members = np.unique(members)
    step = 512
    for i in range(0, len(members), step):
        left = members[i : i + step]
        for j in range(i, len(members), step):
            right = members[j : j + step]
            a, b = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= threshold)
            keep = a < b if i == j else slice(None)
            yield from zip(left[a[keep]].tolist(), right[b[keep]].tolist(), strict=True)


def _dealt(placed: DataFrame, columns: list[str], block: int, counted: DataFrame | None = None, share: int = 1) -> DataFrame:
    """placed with part: members of an anchor with more than `block` of them meet in pairs of blocks, each a part of its own.

    counted: one row in `share` of placed, by which large anchors are told; an error there deals a group out more or less finely and changes no result.
    """
    of = (placed if counted is None else counted).groupBy("anchor").count().select("anchor", (F.col("count") * share).alias("count"))
    hot = of.filter(F.col("count") > block).select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / block).cast("int").alias("k"))
    hot = written(hot, "simhash-hot")
    if hot.isEmpty():
        return placed.withColumn("part", F.lit(0))
    placed = placed.join(hot, placed["anchor"] == hot["hot"], "left").withColumn("own", F.when(F.col("k").isNull(), 0).otherwise(bucket_of(*columns, n=1 << 20) % F.col("k")))
    k, own = F.coalesce("k", F.lit(1)), F.col("own").cast("int")
    both = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.least(own, j) * k + F.greatest(own, j))
    return placed.select("anchor", *columns, F.explode(both).alias("part"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, values) of whole groups, from rows sorted by their two key columns; what a batch cuts off waits for the next."""
    left = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)], axis=1)
        value = np.stack([b.column(i).to_numpy().view(np.uint64) for i in range(2, b.num_columns)], axis=1)
        if left is not None:
            key, value = np.concatenate([left[0], key]), np.concatenate([left[1], value])
        same = np.flatnonzero(np.any(key != key[-1], axis=1))
        done = same[-1] + 1 if len(same) else 0  # the last group may go on
        left = key[done:], value[done:]
        if done:
            yield key[:done], value[:done]
    if left is not None:
        yield left


def _cut(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of equal keys start, and how many rows each has."""
    starts = np.concatenate([[0], np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(key)]]))


def links(classes: DataFrame, threshold: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between different fingerprints, as many as keep linked ones connected."""
    assert threshold <= 3, "halves differ in one bit only where the whole differs in three at most"
    placed = _dealt(_placed(classes), ["fingerprint"], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for key, value in _groups(batches):
            prints = value[:, 0]
            starts, sizes = _cut(key)
            found = []
            for size in range(2, 9):  # small groups together, by size
                if len(at := starts[sizes == size]):
                    group = prints[at[:, None] + np.arange(size)]
                    for i in range(size):
                        for j in range(i + 1, size):
                            near = np.bitwise_count(group[:, i] ^ group[:, j]) <= threshold
                            found += zip(group[near, i].tolist(), group[near, j].tolist(), strict=True)
            kept = [x for x in found if x[0] != x[1] and forest.joins(*x)]
            for at, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                kept += [x for x in _within(prints[at : at + size], threshold) if forest.joins(*x)]
            both = np.array(kept, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    dealt = placed.select("anchor", "part", "fingerprint").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """One row per class of equal fingerprints: fingerprint, n_docs, component_id (smallest id reachable). prints: id, fingerprint, written."""
    with scratch() as made:
        classes = written(prints.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_docs")), "classes")
        of = components(links(classes, threshold))
        labelled = classes.join(of, classes["fingerprint"] == of["node"], "left").select("fingerprint", "first", "n_docs", F.coalesce("root", "fingerprint").alias("root"))
        labelled = written(labelled, "labelled")
        first = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
        return kept(made, written(labelled.join(first, "root").select("fingerprint", "n_docs", "component_id"), "components"))


#: Near copies are compared by PRINTS fingerprints of 64 bits. Majority bits of two sets of similarity 0.8 differ in 15 % of places, too
#: many for halves to meet at an anchor, so each bit here is one of the least hash under an order of its own, which differs in (1 - similarity) / 2.
#: Those of similarity 0.8 differ in 12.8 of 128 bits with a deviation of 3.4; pairs that differ in more than WIDE are not compared.
PRINTS, WIDE = 2, 24
ORDERS = np.array([xxhash.xxh64_intdigest(str(i), 7) | 1 for i in range(64 * PRINTS)], np.uint64)


def least_bits(found: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints of a set of hashes, one bit of the least product with each of ORDERS; zero for the empty set."""
    if not len(found):
        return np.zeros(PRINTS, np.uint64)
    least = np.full(len(ORDERS), 2**64 - 1, np.uint64)
    for i in range(0, len(found), 2048):
        least = np.minimum(least, (found[i : i + 2048, None] * ORDERS).min(axis=0))
    return np.packbits(((least >> np.uint64(20)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")


def set_prints(docs: DataFrame, id: str, text: str = "text", words: int = 5) -> DataFrame:
    """One row per document: id, d (hash of the set of its shingles) and the fingerprints p0, p1 of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000, 16 << 20):
            prints = np.zeros((b.num_rows, 1 + PRINTS), np.uint64)
            for i, t in enumerate(b.column(1).cast(pa.large_binary())):
                found = np.unique(shingles(t.as_py(), words))
                prints[i, 0], prints[i, 1:] = xxhash.xxh64_intdigest(found.tobytes()), least_bits(found)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.view(np.int64)) for x in prints.T.copy())], names=["id", "d", "p0", "p1"])

    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"id {docs.schema[id].dataType.simpleString()}, d long, p0 long, p1 long")


def _joining(a: np.ndarray, b: np.ndarray, apart: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) join all that they link, the closest of each part first; label, the part of every member, is brought up to date."""
    kept, order = [], np.argsort(apart, kind="stable")
    while len(order := order[label[a[order]] != label[b[order]]]):
        ends = np.stack([label[a[order]], label[b[order]]], axis=1).ravel()
        forest, names = _Forest(), np.arange(label.max() + 1)
        for i in order[np.unique(np.unique(ends, return_index=True)[1] // 2)].tolist():
            if forest.joins(int(label[a[i]]), int(label[b[i]])):
                kept.append(i)
        for x in list(forest.up):
            names[x] = forest.root(x)
        label[:] = names[label]
    return np.array(kept, np.int64)


def _nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, label: np.ndarray, quota: int) -> np.ndarray:
    """Which of the pairs are among the `quota` closest of the part of either end."""
    order = np.argsort(apart, kind="stable")
    keep = np.zeros(len(order), bool)
    for part in (label[a[order]], label[b[order]]):
        at = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[at], prepend=-1))
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        keep[order[at[place < quota]]] = True
    return np.flatnonzero(keep)


def _meeting(members: np.ndarray, label: np.ndarray, most: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs to confirm, members with pairs held back) of an anchor; label tells what confirmed links have joined.

    In turn 0 that is nothing, and the pairs that would join all that is near are sent; later 8 ** turn pairs for each part and tile.
    """
    sent, held, step, label = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], 512, label.copy()
    for i in range(0, len(members), step):
        for j in range(i, len(members), step):
            apart = np.bitwise_count(members[i : i + step, None] ^ members[None, j : j + step]).sum(axis=2, dtype=np.uint16)
            a, b = np.nonzero(apart <= most)
            far, a, b = apart[a, b], a + i, b + j
            keep = (a < b) & ((label[a] != label[b]) if turn else True)
            a, b, far = a[keep], b[keep], far[keep]
            if len(a):
                go = _nearest(a, b, far, label, 8**turn) if turn else _joining(a, b, far, label)
                sent.append(np.stack([a[go], b[go]], axis=1))
                rest = np.ones(len(a), bool)
                rest[go] = False
                held += [a[rest], b[rest]]
    return np.concatenate(sent), np.unique(np.concatenate(held))


def _wide_pairs(active: DataFrame, most: int, block: int, turn: int) -> DataFrame:
    """Pairs of sets (a, b, apart) that meet at an anchor of any half and differ in `most` bits or fewer, to be confirmed in this turn.

    active: c (a set's number), p0, p1 and, after turn 0, r that names the part. Rows with `held` name a set (a) with pairs that wait for the next turn.
    """
    columns, share = active.columns, max(1, block // 128)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            all_ = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            for k in range(PRINTS):
                at, row = anchors(all_[1 + k].view(np.uint64), 2 * k)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), *(pa.array(x[row]) for x in all_)], names=["anchor", *columns])

    at_anchors = lambda df: df.mapInArrow(tidy(place), ", ".join(f"{c} long" for c in ("anchor", *columns)))
    placed = _dealt(at_anchors(active), columns, block, at_anchors(active.filter(bucket_of("c", n=share) == 0)), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, value in _groups(batches):
            starts, sizes = _cut(key)
            busy = sizes > 8
            for size in range(2, 9):  # small groups are looked through together, most hold nothing near
                of = np.flatnonzero(sizes == size)
                group = value[starts[of][:, None] + np.arange(size), 1 : 1 + PRINTS]
                for i in range(size):
                    for j in range(i + 1, size):
                        busy[of] |= np.bitwise_count(group[:, i] ^ group[:, j]).sum(axis=1) <= most
            pairs, held = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
            for at, size in zip(starts[busy].tolist(), sizes[busy].tolist(), strict=True):
                rows = value[at : at + size]
                label = np.unique(rows[:, 1 + PRINTS], return_inverse=True)[1].ravel() if turn else np.arange(size)
                words = rows[:, 1 : 1 + PRINTS]
                ab, wait = _meeting(words, label, most, turn)
                named = rows[:, 0].copy().view(np.int64)
                apart = np.bitwise_count(words[ab[:, 0]] ^ words[ab[:, 1]]).sum(axis=1, dtype=np.int64)
                pairs.append(np.concatenate([np.sort(named[ab], axis=1), apart[:, None]], axis=1))
                held.append(named[wait])
            pairs, held = np.concatenate(pairs), np.unique(np.concatenate(held))
            both = np.concatenate([pairs, np.stack([held, held, np.zeros_like(held)], axis=1)])
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in both.T.copy()), pa.array(np.arange(len(both)) >= len(pairs))], names=["a", "b", "apart", "held"])

    dealt = placed.select("anchor", "part", *columns).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(tidy(run), "a long, b long, apart long, held boolean").distinct()


def _nearest_of(left: DataFrame, quota: int) -> DataFrame:
    """(a, b): of the pairs of each part (ra, rb) the closest ones, one in each of `quota` shares of them."""
    ends = left.select("a", "b", "apart", F.explode(F.array("ra", "rb")).alias("part"), bucket_of("a", "b", n=quota).alias("share"))
    return ends.groupBy("part", "share").agg(F.min(F.struct("apart", "a", "b")).alias("x")).select("x.a", "x.b").distinct()


def _parted(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """pairs between different parts, with the parts of their ends as ra and rb."""
    if roots is None:
        return pairs.select("a", "b", "apart", F.col("a").alias("ra"), F.col("b").alias("rb"))
    roots = bounded(roots)
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select("a", "b", "apart", F.coalesce("root_a", "a").alias("ra"), F.coalesce("root_b", "b").alias("rb")).filter("ra <> rb")


def _confirmed(pairs: DataFrame, sets: DataFrame, tested: DataFrame | None, roots: DataFrame | None, least: float) -> tuple[DataFrame | None, DataFrame | None]:
    """(tested, roots) once every pair is confirmed, refused or joined by others.

    All at once where they are at most four for each set among them. Else first each part's closest pair, then 8, 64, ... of each, until no more
    than that are left; those that confirmed ones have joined need no look. So a group of copies costs comparisons by its members, not its pairs.
    """
    ids = ["a", "b"]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            same = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                same.append(shared >= least * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.bool_())], names=[*ids, "same"])

    of = lambda x: sets.select(F.col("c").alias(x), F.col("set").alias(f"set_{x}"))
    left, quota = written(_parted(pairs, roots), "copies-left"), 1
    room = 4 * left.select(F.explode(F.array(*ids))).distinct().count()
    while n := left.count():
        asked = bounded(left.select(*ids) if n <= room else written(_nearest_of(left, quota), "copies-asked"))
        other = of("b").join(asked.select("b"), "b", "left_semi")  # no set is shuffled that is not asked for
        both = asked.join(of("a"), "a").join(other, "b").select(*ids, "set_a", "set_b")
        checked = written(both.mapInArrow(tidy(confirm), "a long, b long, same boolean"), "copies-checked")
        tested = checked if tested is None else tested.union(checked)
        links = checked.filter("same").select(*ids)
        roots = written(components(links if roots is None else links.union(roots.select("node", "root"))), "copies-roots")
        if n <= room:
            break
        rest = left.select(*ids, "apart").join(checked.select(*ids), ids, "left_anti")
        left, quota = written(_parted(rest, roots), "copies-left"), 8 * quota
    return tested, roots


def near_copies(docs: DataFrame, id: str, text: str = "text", words: int = 5, least: float = 0.8, most: int = WIDE, block: int = BLOCK) -> DataFrame:
    """(id, group) for every document, written: groups are linked by a Jaccard similarity of `least` or more of their sets of shingles of `words` words.

    id: unique, of any type with an order; group is the least id of the group. Texts of equal sets are one class; those without words are one, too.
    Two classes are compared where one of their four half fingerprints meets at an anchor, so whether a pair is seen is a matter of chance,
    of 0.92 at a similarity of 0.8, 0.96 at 0.825 and 0.98 at 0.85, wherever the texts differ. All links are confirmed exactly on the whole texts.

    An anchor sends the pairs that would join its near members, closest first; what they leave apart once they are confirmed is sent in
    further turns, 8, 64, ... pairs for each part, until no pair waits. Of what all anchors send, each part's closest pairs are confirmed first
    (`_confirmed`), and no pair that was seen goes unconfirmed unless confirmed links join its ends.
    """
    with small_batches(docs.sparkSession), scratch() as made:
        return kept(made, _near_copies(docs, id, text, words, least, most, block))


def _near_copies(docs: DataFrame, id: str, text: str, words: int, least: float, most: int, block: int) -> DataFrame:
    prints = written(set_prints(docs, id, text, words), "copies-prints")
    classes = prints.groupBy("d", "p0", "p1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "copies-classes")  # a number is half of a hash and shuffles as less

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingles(t.as_py(), words)).tobytes() for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["c", "set"])

    active, turn, tested, roots, sets = classes.select("c", "p0", "p1"), 0, None, None, None
    while True:
        found = written(_wide_pairs(active, most, block, turn), "copies-found")
        pairs = found.filter("not held").select("a", "b", "apart")
        if sets is None:  # later turns ask for no others: whatever is near a member has a pair in the first
            asked = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
            chosen = written(classes.join(asked, "c").select("c", "first"), "copies-chosen")
            said = docs.select(F.col(id).alias("first"), F.col(text).cast("string").alias("text"))
            sets = written(said.join(bounded(chosen), "first").select("c", "text").mapInArrow(tidy(run), "c long, set binary"), "copies-sets")
        elif tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested, roots = _confirmed(pairs, sets, tested, roots, least)
        held = found.filter("held").select(F.col("a").alias("c"))
        if held.isEmpty():
            break
        waiting = classes.join(held, "c").select("c", "p0", "p1").join(bounded(roots.withColumnRenamed("node", "c")), "c", "left")
        active, turn = written(waiting.select("c", "p0", "p1", F.coalesce("root", "c").alias("r")), "copies-active"), turn + 1
    named = classes.select("d", "p0", "first", "n", F.col("c").alias("root"))
    if roots is not None:
        named = classes.join(bounded(roots.withColumnRenamed("node", "c")), "c", "left").select("d", "p0", "first", "n", F.coalesce("root", "c").alias("root"))
    named = written(named, "copies-named")
    several = written(named.groupBy("root").agg(F.min("first").alias("group"), F.sum("n").alias("rows")).filter("rows > 1"), "copies-groups")
    of_class = written(named.join(bounded(several), "root").select("d", "p0", "group"), "copies-of-class")
    return written(prints.join(bounded(of_class), ["d", "p0"], "left").select("id", F.coalesce("group", "id").alias("group")), "copies")


def as_hex(fingerprint: str = "fingerprint") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fingerprint)), 16, "0"))

