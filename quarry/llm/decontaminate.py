"""Benchmark decontamination over a distributed positional inverted index.

Training documents are dealt into segments, each a row of the written index: its terms, and for each term the ascending
positions of its postings. Every document lies in one segment, so the frequency of a term never gathers rows in one place.
Test items are searched segment by segment: the list of the rarest term, shifted by the term's offset, is intersected with
those of the next rarer ones until all terms of a window have met, or none is left.

Defined results: a null or empty text has no words; an item without words occurs nowhere, and one of fewer words than a window
is one window; items with a null id mark words but are not listed; repeated ids of items count once; repeated documents each
get a row; empty tables give empty results, an empty benchmark no hits; a long text stays whole, in a segment of its own size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, small_batches, tidy, written

#: The contract's words, on lower-cased UTF-8: bytes of characters beyond ASCII, digits and letters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEGMENT = 1_000_000
SCHEMA = "segment long, ids array<string>, n_words array<int>, terms binary, counts binary, postings binary"
FOUND = "segment long, at int, id string, n_words long, starts array<long>, ends array<long>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def _packed(segment: int, ids: list[str | None], lengths: list[int], terms: list[bytes], numbers: list[np.ndarray]) -> pa.RecordBatch:
    """numbers: the term of each word, by document; positions run on over documents, with a gap after each."""
    n = np.array(lengths, np.int64)
    base = np.cumsum(n + 1) - (n + 1)
    at = np.arange(int(n.sum()), dtype=np.int64) + np.repeat(base - (np.cumsum(n) - n), n)
    term = np.concatenate([*numbers, np.zeros(0, np.int64)])
    keys = np.sort((term << 32) | at)
    counts = np.bincount(term, minlength=len(terms)).astype("<u4")
    postings = (keys & 0xFFFFFFFF).astype("<u4")
    schema = pa.schema([("segment", pa.int64()), ("ids", pa.list_(pa.string())), ("n_words", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("terms", "counts", "postings"))])
    return pa.RecordBatch.from_pylist([{"segment": segment, "ids": ids, "n_words": lengths, "terms": b"\n".join(terms), "counts": counts.tobytes(), "postings": postings.tobytes()}], schema=schema)


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT) -> DataFrame:
    """The index over all documents and all their words, written in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = count(TaskContext.get().partitionId() << 32)
        fresh = lambda: ([], [], defaultdict(count().__next__), [])
        ids, lengths, terms, numbers = fresh()
        total = 0
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                found = words(t.as_py())
                ids.append(i)
                lengths.append(len(found))
                numbers.append(np.fromiter(map(terms.__getitem__, found), np.int64, len(found)))
                total += len(found)
                if total >= segment_words or len(ids) >= segment_words:
                    yield _packed(next(segment), ids, lengths, list(terms), numbers)
                    ids, lengths, terms, numbers = fresh()
                    total = 0
        if ids:
            yield _packed(next(segment), ids, lengths, list(terms), numbers)

    keyed = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return written(keyed.mapInArrow(tidy(run), SCHEMA), "postings")


class _Lists:
    """The postings of one segment, by test term."""

    def __init__(self, row: dict, wanted: list[bytes]):
        n = np.array(row["n_words"], np.int64)
        self.base = np.cumsum(n + 1) - (n + 1)
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        ends = np.cumsum(counts)
        self.postings = np.frombuffer(row["postings"], "<u4")
        number = {t: i for i, t in enumerate(row["terms"].split(b"\n"))} if len(counts) else {}
        at = np.array([number.get(t, -1) for t in wanted], np.int64)
        self.n = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(wanted), np.int64)
        self.a = np.where(at >= 0, (ends - counts)[at], 0) if len(counts) else self.n
        self.kept: dict[int, np.ndarray] = {}

    def of(self, term: int) -> np.ndarray:
        if (x := self.kept.get(term)) is None:
            x = self.kept[term] = self.postings[self.a[term] : self.a[term] + self.n[term]].astype(np.int64)
        return x

    def meet(self, starts: np.ndarray, term: int, offset: int) -> np.ndarray:
        """Of the starts, those at whose offset the term stands."""
        own, want = self.of(term), starts + offset
        at = np.searchsorted(own, want)
        return starts[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == want)]


def _phrases(lists: _Lists, terms: list[int], window: int) -> list[tuple[np.ndarray, int]]:
    """(positions, length) of the occurrences of each window of an item."""
    size = min(window, len(terms))
    n = lists.n[np.array(terms, np.int64)]
    there = np.flatnonzero(np.convolve(n > 0, np.ones(size, int), "valid") == size) if size else []
    n, pairs, out = n.tolist(), {}, []
    for s in map(int, there):
        order = sorted(range(s, s + size), key=n.__getitem__)
        starts = pairs.get(pair := tuple(order[:2]))
        if starts is None:
            starts = lists.of(terms[order[0]]) - order[0]
            if size > 1:
                starts = lists.meet(starts, terms[order[1]], order[1])
            pairs[pair] = starts
        for j in order[2:]:
            if not len(starts):
                break
            starts = lists.meet(starts, terms[j], j)
        if len(starts):
            out.append((starts + s, size))
    return out


def _near(lists: _Lists, terms: list[int], slop: int) -> list[tuple[np.ndarray, int]]:
    """Positions of an item's rarest term that have all its other terms within slop words, in the same document."""
    order = sorted(set(terms), key=lambda t: lists.n[t])
    if not order or not lists.n[order[0]]:
        return []
    starts = lists.of(order[0])
    doc = np.searchsorted(lists.base, starts, "right")
    low, high = np.maximum(starts - slop, lists.base[doc - 1]), starts + slop
    high = np.where(doc < len(lists.base), np.minimum(high, lists.base[np.minimum(doc, len(lists.base) - 1)] - 1), high)
    keep = np.ones(len(starts), bool)
    for t in order[1:]:
        own = lists.of(t)
        keep &= np.searchsorted(own, high, "right") > np.searchsorted(own, low, "left")
    return [(starts[keep], 1)] if keep.any() else []


def _blocks(items: DataFrame, id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The test items in blocks of bounded size; no more than one is held."""
    held, size = [], 0
    for r in items.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).toLocalIterator():
        held.append((r.id, words((r.text or "").encode())))
        size += len(r.text or "") + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    yield held


def _search(index_: DataFrame, items: list[tuple[str | None, list[bytes]]], window: int, slop: int | None) -> DataFrame:
    number: dict[bytes, int] = defaultdict(count().__next__)
    numbered = [(i, [number[w] for w in found]) for i, found in items if found]
    sent = index_.sparkSession.sparkContext.broadcast((numbered, list(number)))  # its size is that of a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, wanted = sent.value
        for b in slices(batches, rows=1):
            for row in b.to_pylist():
                yield _found(row, numbered, wanted, window, slop)

    return index_.mapInArrow(tidy(run), FOUND)


def _found(row: dict, numbered: list, wanted: list[bytes], window: int, slop: int | None) -> pa.RecordBatch:
    lists, starts, ends = _Lists(row, wanted), [], []
    listed: list[set] = [set() for _ in row["ids"]]
    for i, terms in numbered:
        for at, size in _phrases(lists, terms, window) if slop is None else _near(lists, terms, slop):
            starts.append(at)
            ends.append(at + size)
            if i is not None:
                for d in np.unique(np.searchsorted(lists.base, at, "right") - 1).tolist():
                    listed[d].add(i)
    spans: list[tuple[list, list]] = [([], []) for _ in row["ids"]]
    if starts:
        a, b = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
        a, b = a[new], b[np.concatenate([new[1:] - 1, [len(b) - 1]])]
        for d, x, y in zip((np.searchsorted(lists.base, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
            spans[d][0].append(x - int(lists.base[d]))
            spans[d][1].append(y - int(lists.base[d]))
    n = len(row["ids"])
    return pa.RecordBatch.from_arrays(
        [pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["ids"], pa.string()), pa.array(row["n_words"], pa.int64()),
         pa.array([s[0] for s in spans], pa.list_(pa.int64())), pa.array([s[1] for s in spans], pa.list_(pa.int64())), pa.array([sorted(x) for x in listed], pa.list_(pa.string()))],
        names=["segment", "at", "id", "n_words", "starts", "ends", "items"],
    )


def search(index_: DataFrame, items: DataFrame, id: str = "item_id", text: str = "text", window: int = 13, slop: int | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: id, n_words, spans (start, end in words, disjoint and ascending), items (ids found, sorted).

    Phrases of `window` words, or with `slop` the places of an item's rarest term that have its other terms within so many
    words. Items are sent to the segments in blocks of block_bytes; with several, each block's finds are written and then merged.
    """
    found = None
    blocks = _blocks(items, id, text, block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        one = _search(index_, block, window, slop)
        if after is None and found is None:
            return one.select("id", "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "items")
        one = written(one, "finds")
        found, block = one if found is None else found.unionByName(one), after
    merged = found.groupBy("segment", "at").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))))).alias("all"),
    )
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    last = lambda done: F.element_at(done, -1)
    joined = F.aggregate(
        "all", none,
        lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    return merged.select("id", "n_words", joined.alias("spans"), "items")


def judged(found: DataFrame) -> DataFrame:
    """found with n_hit, n_items, items_sha256 and contaminated by the contract's rule: a twentieth of the words or more."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
