"""Phrase collocation mining: exact counts of frequent phrases by minimal perfect hashing, and their weakest cuts.

1. Each text is split into words once. Its words go on as 64-bit hashes with zeros for the breaks between pieces, in rows of up to
   16,384 words of a language (`encoded`); beside them lie each word's counts. The hash tells words apart exactly: whether any two
   different words of the corpus share one is looked up, and if so another seed is taken.
2. Candidates are found level by level (`candidates`). By Apriori a phrase is frequent only if both its ends without one word are, so
   a task looks at those positions alone, with a bit filter of the shorter frequent phrases whose errors merely let more through.
   It must also reach the threshold in an array that all tasks tally the level's phrases in by hash (`tallied`); where a corpus would
   fill it, phrases are dealt to slices by their first two words and tallied slice by slice, so that the array tells as much at any size.
   It sends each phrase it holds once, with its occurrences there or the threshold, whichever is less: the sum of these reaches the
   threshold exactly where the whole count does, so candidates are safe and few before anything is counted.
3. A minimal perfect hash (`Slots`: levels of bits, collisions go on to the next level, the slot is the rank of the bit) numbers the
   candidates, words among them, and stores their keys, all words' hashes, in the order of the slots. Tasks look up every position,
   compare the stored key word by word, and bincount the slots that are verified into one numpy array; the arrays are added up in a
   tree, some tasks at a time. Candidates take turns of up to `TURN`, so what is sent to the tasks is bounded whatever the corpus holds.
   Turns, too, are dealt by the first two words: a turn looks up only the positions that may begin one of its candidates, and a phrase
   where its beginning was found, so that all turns together look up each position once.
4. Each candidate reads its own count and those of both sides of all its cuts by slot, from the turn's array.

Scores and comparisons are exact: they are taken in decimals of 38 digits, not in floats.

Defined results: a null text is empty; a null language is `und`; pieces and words are those of the contract, and A-Z alone is
lowered; repeated rows count again; ids play no part; long texts are read in blocks; ties go to the higher count, then to the phrase in
byte order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded, bucket_of, kept, scratch, slices, small_batches, written

#: Bytes that end a piece, and those that lie between words.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
BREAK = b"\xff"  # in no UTF-8 text
LOWERED = bytes(255 if x in ENDS else 32 if x in BLANKS else x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Words of one encoded row, bytes of text split at a time, words of a task's dictionary before it sends its counts.
ROW, PIECE, HELD = 1 << 14, 1 << 18, 100_000
#: Bytes of a row group of the encoded texts: a reader holds one as vectors.
GROUP = 8 << 20
#: Phrases that a task brings together before it sends them.
GATHERED = 1 << 19
#: Candidates of one turn: 50 MB of keys, counts and bits.
TURN = 1 << 20
#: Slots of one part of an array of counts, and arrays added up at a time.
PART, FAN = 4096, 16
#: Places of the array that the phrases of a level are tallied in: the fewest, the most, and words of the corpus for each place.
TALLY, MOST_TALLY, LOAD = 1 << 24, 1 << 26, 6
#: Bits of the largest filter.
MOST_BITS = 1 << 28
GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def joined(columns: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of each row of some columns of hashes."""
    out = np.full(len(columns[0]), len(columns) + (salt << 8), np.uint64)
    for c in columns:
        out = mixed(out * GOLD + c)
    return out


class Slots:
    """A minimal perfect hash: level by level a key sets a bit that no other key of the level wants; its slot is the rank of that bit."""

    def __init__(self, keys: np.ndarray, room: float = 2.0) -> None:
        """keys: different hashes."""
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # slots before, size, words of bits, ranks before each word
        done, level = 0, 0
        while len(keys):
            size = max(64, int(room * len(keys)) + 63 & ~63)
            at = self.places(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64)
            self.levels.append((done, size, words, ranks))
            done, keys, level = done + int(alone.sum()), keys[~alone[at]], level + 1
        self.n = done

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64(int(GOLD) * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not given, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (done, size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = self.places(keys[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            has = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[has]] = (done + ranks[at >> 6] + below)[has]
            left = left[~has]
        return out


class Table:
    """Candidates by slot: stored keys (language and words, zeros behind), to verify what is looked up."""

    def __init__(self, keys: np.ndarray) -> None:
        self.salt = next(x for x in range(100) if len(np.unique(joined(list(keys.T), x))) == len(keys))
        hashes = joined(list(keys.T), self.salt)
        self.slots = Slots(hashes)
        self.keys = np.zeros_like(keys)
        self.keys[self.slots.of(hashes)] = keys

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """The slots of phrases (language, words) of one length, -1 where a phrase is no candidate."""
        full = columns + [np.zeros(len(columns[0]), np.uint64)] * (self.keys.shape[1] - len(columns))
        if not len(self.keys):
            return np.full(len(columns[0]), -1, np.int64)
        slot = self.slots.of(joined(full, self.salt))
        known = slot >= 0
        for i, c in enumerate(full):
            known &= self.keys[slot, i] == c
        return np.where(known, slot, -1)


class Bits:
    """A filter: a bit for each phrase of a set; others may share it."""

    def __init__(self, size: int, parts: dict[int, bytes], part: int) -> None:
        self.size, self.words = size, np.zeros(size // 8, np.uint8)
        for i, data in parts.items():
            self.words[i * part // 8 : i * part // 8 + len(data)] = np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        return (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def dealt(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """A number of the first two words of a phrase, by which slices and turns are dealt; hashes are even as they are. `_dealt` is the same in Spark."""
    return (first if second is None else first ^ (second >> np.uint64(1))) & np.uint64(2**62 - 1)


def _dealt() -> Column:
    return F.col("w1").bitwiseXOR(F.shiftrightunsigned("w2", 1)).bitwiseAND(F.lit(2**62 - 1))


def few_tasks(codes: DataFrame) -> DataFrame:
    """codes in two tasks a core at most: each sends an array, or each phrase that it holds, and these should not grow with the number of files."""
    n = 2 * codes.sparkSession.sparkContext.defaultParallelism
    return codes.coalesce(n) if codes.rdd.getNumPartitions() > n else codes


def blocks_of(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in blocks that end at a blank or a piece's end, as far as it has any."""
    text = text.translate(LOWERED)
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b" ", at, at + size), text.rfind(BREAK, at, at + size)) + 1
        if cut <= at:
            ends = [x for x in (text.find(b" ", at + size), text.find(BREAK, at + size)) if x >= 0]
            cut = min(ends) + 1 if ends else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Words(dict):
    """A task's numbers of a language's words, their hashes and counts; number 0 is the break."""

    def __init__(self, seed: int) -> None:
        super().__init__({BREAK: 0})
        self.seed, self.hashes, self.counts = seed, [0], np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed) or 1)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.replace(BREAK, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def codes(self, numbers: np.ndarray, own: int) -> np.ndarray:
        """The hashes of some words, of which the first `own` are counted."""
        n = np.bincount(numbers[:own], minlength=len(self.hashes))
        n[: len(self.counts)] += self.counts
        self.counts = n
        return np.fromiter(self.hashes, np.uint64, len(self.hashes))[numbers]


def encoded(docs: DataFrame, text: str, lang: str, longest: int, seed: int = 42, row: int = ROW) -> DataFrame:
    """Two kinds of rows, written: `codes` (lang, own, codes: own words and longest - 1 more) and `words` (lang, word, hash, n).

    own: how many of the row's positions may begin a phrase; what stands behind them begins the next row.
    """
    schema = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}

        def counted(lang: str) -> pa.RecordBatch:
            d = known.pop(lang)
            n = len(d.counts) - 1
            names = list(d)[1 : n + 1]
            return pa.RecordBatch.from_arrays(
                [pa.array(["words"] * n, pa.string()), pa.array([lang] * n, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.array(d.hashes[1 : n + 1], np.uint64).view(np.int64)), pa.array(d.counts[1:]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                schema=schema,
            )

        def coded(lang: str, own: int, codes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": "codes", "lang": lang, "own": own, "codes": codes.tobytes()}], schema=schema)

        def rows(lang: str, parts: list[np.ndarray], ended: bool) -> Iterator[pa.RecordBatch]:
            """The words held of a language in rows; where a text goes on, the last ones stay and begin the next row."""
            numbers = np.concatenate(parts)
            parts.clear()
            upto = len(numbers) if ended else max(0, len(numbers) - longest + 1)
            codes = known[lang].codes(numbers, upto)
            for i in range(0, upto, row):
                own = min(row, upto - i)
                yield coded(lang, own, codes[i : i + own + longest - 1])
            if upto < len(numbers):
                parts.append(numbers[upto:])

        for b in slices(batches, 1000, 2 << 20):
            held: dict[str, list[np.ndarray]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                d, parts = known.setdefault(name, _Words(seed)), held.setdefault(name, [])
                for part in blocks_of(t.as_py()):
                    parts.append(d.numbers(part))
                    if len(part) >= PIECE // 2 and sum(map(len, parts)) > PIECE:
                        yield from rows(name, parts, False)
                parts.append(np.zeros(1, np.int32))
            for name, parts in held.items():
                yield from rows(name, parts, True)
            while known and sum(map(len, known.values())) > HELD:
                yield counted(max(known, key=lambda x: len(known[x])))
        for name in list(known):
            yield counted(name)

    said = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).filter("text is not null")
    return written(said.mapInArrow(run, "kind string, lang string, word string, hash long, n long, own long, codes binary"), "phrases", row_group=GROUP)


def _spread(lang: str, own: int, codes: bytes) -> tuple[np.uint64, int, np.ndarray]:
    return language_code(lang), own, np.frombuffer(codes, "<u8")


@lru_cache(maxsize=10_000)
def language_code(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))


def passing(code: np.uint64, codes: np.ndarray, filters: list[Bits], wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For 1, 2, ... words, the positions of phrases that their filter lets through, as it does both their ends without one word; then those of one word more, whose ends pass.

    wanted: the positions that the last ones are asked of; others are looked at only as far as these need them.
    """
    ok = codes != 0
    if wanted is not None:
        near = wanted.copy()
        for j in range(1, len(filters) + 1):
            near[j:] |= wanted[:-j]
        ok &= near
    for k, bits in enumerate(filters, 1):
        at = np.flatnonzero(ok)
        at = at[bits.has(joined([np.full(len(at), code), *(codes[at + i] for i in range(k))]))]
        yield at
        passed = np.zeros(len(ok), bool)
        passed[at] = True
        ok = passed[:-1] & passed[1:]
    yield np.flatnonzero(ok if wanted is None else ok & wanted[: len(ok)])


def _unique(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(the different rows of some columns, the sum of n for each)."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    h = joined(columns)
    order = np.argsort(h, kind="stable")
    h, columns, n = h[order], [c[order] for c in columns], n[order]
    new = lambda cs: np.logical_or.reduce([np.concatenate([[True], c[1:] != c[:-1]]) for c in cs])
    first = new(columns)
    if first.sum() > new([h]).sum():  # different rows of one hash may lie mixed
        order = np.lexsort(columns)
        columns, n = [c[order] for c in columns], n[order]
        first = new(columns)
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.add.reduceat(n, at)


def filter_bits(spark: SparkSession, frequent: DataFrame, k: int) -> Bits:
    """The filter of the frequent phrases of k words; its parts, of bounded size in all, come to the driver."""
    n = frequent.count()
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    part = min(size, 1 << 20)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [np.array([language_code(x) for x in b.column(0).to_pylist()], np.uint64), *(b.column(i).to_numpy().view(np.uint64) for i in range(1, k + 1))]
            yield pa.RecordBatch.from_arrays([pa.array((joined(columns) & np.uint64(size - 1)).astype(np.int64))], names=["at"])

    def packed(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        bits = np.zeros(part, bool)
        bits[at % part] = True
        return pa.table({"part": pa.array([int(at[0]) // part], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    places = frequent.select("lang", *[f"w{i}" for i in range(1, k + 1)]).mapInArrow(place, "at long").distinct()
    parts = places.groupBy((F.col("at") / part).cast("long").alias("g")).applyInArrow(packed, "part long, bits binary").collect()
    return Bits(size, {r["part"]: bytes(r["bits"]) for r in parts}, part)


def summed(arrays: DataFrame, tasks: int, kind: type, most: int | None = None, fan: int = FAN) -> DataFrame:
    """arrays (task, part, sums) added up by part in a tree, `fan` tasks at a time; no sum is kept beyond `most`."""

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), kind).astype(np.int64) for x in table.column("sums"))
        total = total if most is None else np.minimum(total, most)
        return pa.table({"task": pa.array([table.column("task")[0].as_py() // fan], pa.int64()), "part": table.column("part").slice(0, 1), "sums": pa.array([total.astype(kind).tobytes()], pa.binary())})

    while True:
        arrays = arrays.groupBy((F.col("task") / fan).cast("long").alias("g"), F.col("part").alias("p")).applyInArrow(added, "task long, part long, sums binary")
        tasks = -(-tasks // fan)
        if tasks <= 1:
            return arrays


def _parts(sums: np.ndarray, part: int) -> pa.RecordBatch:
    """A task's array in parts, without those that are zero."""
    some = [i for i in range(0, len(sums), part) if sums[i : i + part].any()]
    columns = [pa.array([TaskContext.get().partitionId()] * len(some), pa.int64()), pa.array([i // part for i in some], pa.int64()), pa.array([sums[i : i + part].tobytes() for i in some], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["task", "part", "sums"])


class Sliced:
    """A filter in slices, one for each share of the phrases as `dealt` deals them."""

    def __init__(self, slices: list[Bits]) -> None:
        self.slices = slices

    def has(self, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """of: the slice of each phrase."""
        out = np.zeros(len(hashes), bool)
        for i, bits in enumerate(self.slices):
            at = np.flatnonzero(of == i)
            out[at] = bits.has(hashes[at])
        return out


def _slice_of(first: np.ndarray, second: np.ndarray, slices: int) -> np.ndarray:
    return (dealt(first, second) >> np.uint64(32)) % np.uint64(slices)


def tally_size(words: int, least_size: int = TALLY, most_size: int = MOST_TALLY, load: int = LOAD) -> tuple[int, int]:
    """(places of an array, slices) for a corpus of so many words."""
    size = least_size
    while size < most_size and words > load * size:
        size *= 2
    return size, max(1, -(-words // (load * size)))


def tallied(spark: SparkSession, codes: DataFrame, filters: list[Bits], least: int, size: int = TALLY, slices: int = 1) -> Sliced:
    """A filter of phrases one word longer than those filtered: their occurrences, tallied by hash in an array of `size` places, reach `least`.

    Phrases of one place add up, so none that is frequent is lost, and most that are not stay out of what tasks send each other.
    """
    sent, most = spark.sparkContext.broadcast(filters), min(least, 255)
    read = few_tasks(codes.select("lang", "own", "codes"))
    tasks = read.rdd.getNumPartitions()

    def tally(slice: int) -> Bits:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters, sums = sent.value, np.zeros(size, np.uint8)
            for b in batches:
                for i in range(b.num_rows):
                    code, own, words = _spread(*(b.column(j)[i].as_py() for j in range(3)))
                    wanted = None
                    if slices > 1:
                        wanted = np.zeros(len(words), bool)
                        wanted[:-1] = _slice_of(words[:-1], words[1:], slices) == slice
                        wanted[own:] = False
                    *_, at = passing(code, words, filters, wanted)
                    at = at[at < own]
                    place, n = np.unique(joined([np.full(len(at), code), *(words[at + j] for j in range(len(filters) + 1))]) & np.uint64(size - 1), return_counts=True)
                    place = place.astype(np.int64)
                    sums[place] = np.minimum(sums[place] + n, most)
            yield _parts(sums, 1 << 16)

        done = summed(read.mapInArrow(run, "task long, part long, sums binary"), tasks, np.uint8, most)
        packed = lambda x: np.packbits(np.frombuffer(bytes(x), np.uint8) >= most, bitorder="little").tobytes()

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(x.as_py()) for x in b.column(1)], pa.binary())], names=["part", "bits"])

        return Bits(size, {r["part"]: bytes(r["bits"]) for r in done.select("part", "sums").mapInArrow(bits, "part long, bits binary").collect()}, 1 << 16)

    found = Sliced([tally(i) for i in range(slices)])
    sent.destroy()
    return found


def candidates(spark: SparkSession, codes: DataFrame, k: int, filters: list[Bits], tally: Sliced, least: int, longest: int, gathered: int = GATHERED) -> DataFrame:
    """lang and w1 .. wk of the phrases of k words that occur `least` times or more; written. filters: of the shorter lengths; tally: the level's own.

    What a task holds is added up whenever it is `gathered` phrases. Where more than half as many different ones are left, it sends the
    rarest of them and keeps the others, which are likely to come again, so that a task sends a frequent phrase about once.
    """
    sent = spark.sparkContext.broadcast((filters, tally))
    names = [f"w{i}" for i in range(1, k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[list[np.ndarray], np.ndarray]]] = {}
        (filters, tally), size = sent.value, 0

        def added(lang: str) -> tuple[list[np.ndarray], np.ndarray]:
            parts = held[lang]
            return _unique([np.concatenate(x) for x in zip(*(c for c, _ in parts), strict=True)], np.concatenate([n for _, n in parts])) if len(parts) > 1 else parts[0]

        def told(lang: str, columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *(pa.array(c.view(np.int64)) for c in columns), pa.array(np.minimum(n, least).astype(np.int32))], names=["lang", *names, "n"])

        for b in batches:
            for i in range(b.num_rows):
                lang = b.column(0)[i].as_py()
                code, own, words = _spread(lang, b.column(1)[i].as_py(), b.column(2)[i].as_py())
                *_, at = passing(code, words, filters)
                at = at[at < own]
                columns = [words[at + j] for j in range(k)]
                at = np.flatnonzero(tally.has(joined([np.full(len(at), code), *columns]), _slice_of(columns[0], columns[1], len(tally.slices))))
                if len(at):
                    held.setdefault(lang, []).append(_unique([c[at] for c in columns], np.ones(len(at), np.int64)))
                    size += len(held[lang][-1][1])
                if size > gathered:
                    for x in held:
                        held[x] = [added(x)]
                    size = sum(len(n) for ((_, n),) in held.values())
                    if size > gathered // 2:
                        rare = np.partition(np.concatenate([n for ((_, n),) in held.values()]), size - gathered // 4)[size - gathered // 4]
                        for x, ((columns, n),) in held.items():
                            yield told(x, [c[n <= rare] for c in columns], n[n <= rare])
                            held[x] = [([c[n > rare] for c in columns], n[n > rare])]
                        size = sum(len(n) for ((_, n),) in held.values())
        for lang in held:
            yield told(lang, *added(lang))

    seen = few_tasks(codes.select("lang", "own", "codes")).mapInArrow(run, ", ".join(["lang string", *(f"{w} long" for w in names), "n int"]))
    found = seen.groupBy("lang", *names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    done = written(found.select("lang", *names, *[F.lit(0).cast("long").alias(f"w{i}") for i in range(k + 1, longest + 1)]), "phrases-candidates")
    sent.destroy()
    return done


def _array_of(keys: pa.Table, longest: int) -> np.ndarray:
    langs = {x: language_code(x) for x in set(keys.column("lang").to_pylist())}
    first = np.array([langs[x] for x in keys.column("lang").to_pylist()], np.uint64)
    return np.stack([first, *(keys.column(f"w{i}").to_numpy().view(np.uint64) for i in range(1, longest + 1))], axis=1) if len(first) else np.zeros((0, longest + 1), np.uint64)


def counted(spark: SparkSession, codes: DataFrame, table: Table, filters: list[Bits], longest: int, turn: int = 0, turns: int = 1, part: int = PART, fan: int = FAN) -> np.ndarray:
    """Occurrences of the turn's candidates by slot: a task bincounts into one array, arrays are added up in a tree."""
    sent, n = spark.sparkContext.broadcast((table, filters)), len(table.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, filters = sent.value
        sums, slots, held = np.zeros(n, np.int64), [], 0

        def found(code: np.uint64, words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
            """Of some positions those that begin a candidate of k words, which is counted."""
            columns = [np.full(len(at), code), *(words[at + j] for j in range(k))]
            some = np.flatnonzero(filters[k - 1].has(joined(columns)))
            slot = table.find([c[some] for c in columns])
            slots.append(slot[slot >= 0].astype(np.int32))
            return at[some[slot >= 0]]

        for b in batches:
            for i in range(b.num_rows):
                code, own, words = _spread(*(b.column(j)[i].as_py() for j in range(3)))
                real, own = words != 0, min(own, len(words))
                mine = lambda x: x % np.uint64(turns) == turn if turns > 1 else True
                found(code, words, np.flatnonzero(real[:own] & mine(dealt(words[:own]))), 1)
                at = np.flatnonzero(real[:-1] & real[1:] & mine(dealt(words[:-1], words[1:])))
                at = at[at < own]
                for k in range(2, longest + 1):
                    at = at[at + k <= len(words)]
                    at = found(code, words, at[real[at + k - 1]], k)
                held += sum(map(len, slots[-longest:]))
                if held > n // 2:  # an array of the turn's size is made for many rows at once
                    sums += np.bincount(np.concatenate(slots), minlength=n)
                    slots.clear()
                    held = 0
        if slots:
            sums += np.bincount(np.concatenate(slots), minlength=n)
        yield _parts(sums, part)

    read = few_tasks(codes.select("lang", "own", "codes"))
    sums = summed(read.mapInArrow(run, "task long, part long, sums binary"), read.rdd.getNumPartitions(), np.int64, fan=fan)
    out = np.zeros(n, np.int64)
    for r in sums.collect():  # one array of the turn's size
        data = np.frombuffer(bytes(r["sums"]), np.int64)
        out[r["part"] * part : r["part"] * part + len(data)] = data
    sent.destroy()
    return out


def read_cuts(spark: SparkSession, asked: DataFrame, table: Table, counts: np.ndarray, longest: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """asked (lang, w1 .., reads: own count, then both sides of every cut) with what the turn's array knows of them filled in, by slot."""
    sent = spark.sparkContext.broadcast((table, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = sent.value
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = _array_of(t, longest)
            reads = t.column("reads").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).copy()
            size = (keys[:, 1:] != 0).sum(axis=1)
            for k in range(1, longest + 1):
                row = np.flatnonzero(size == k)
                words = [keys[row, 1 + j] for j in range(k)]
                for place, i, j in [(0, 0, k), *((2 * c - 1, 0, c) for c in range(1, k)), *((2 * c, c, k) for c in range(1, k))]:
                    of = np.flatnonzero(dealt(*words[i:j][:2]) % np.uint64(turns) == turn)
                    slot = table.find([keys[row[of], 0], *(w[of] for w in words[i:j])])
                    reads[row[of[slot >= 0]], place] = counts[slot[slot >= 0]]
            flat = pa.array(reads.reshape(-1))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, reads.size + 1, reads.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "reads"), listed], names=[*(c for c in b.schema.names if c != "reads"), "reads"])

    columns = [c for c in asked.columns if c != "reads"]
    return asked.select(*columns, "reads").mapInArrow(run, ", ".join([f"{c} {asked.schema[c].dataType.simpleString()}" for c in columns] + ["reads array<long>"]))


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 4, least: int = 30, most: int = 2000, scale: int = 2_000_000, inside: tuple[int, int] = (80, 100), turn: int = TURN, row: int = ROW) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of two to `longest` words.

    score: floor(scale * a / (l + r)) at the weakest cut. Phrases are left out that lie in a longer candidate of at least inside[0] /
    inside[1] of their occurrences.
    """
    with small_batches(docs.sparkSession), scratch() as made:
        return kept(made, _mined(docs, lang, text, longest, least, most, scale, inside, turn, row))


def _encoded_words(docs: DataFrame, text: str, lang: str, longest: int, row: int) -> tuple[DataFrame, DataFrame]:
    """The encoded texts and their words (lang, word, n, hash), under a seed by which no two words share a hash."""
    for seed in range(42, 50):
        both = encoded(docs, text, lang, longest, seed, row)
        words = written(both.filter("kind = 'words'").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("hash").alias("hash")), "phrases-words")
        if words.groupBy("hash").agg((F.min("word") != F.max("word")).alias("shared")).filter("shared").isEmpty():
            return both.filter("kind = 'codes'"), words
    raise RuntimeError("words share hashes under every seed")


def _mined(docs: DataFrame, lang: str, text: str, longest: int, least: int, most: int, scale: int, inside: tuple[int, int], turn: int, row: int) -> DataFrame:
    spark, names = docs.sparkSession, [f"w{i}" for i in range(1, longest + 1)]
    codes, words = _encoded_words(docs, text, lang, longest, row)
    frequent = written(words.filter(F.col("n") >= least).select("lang", F.col("hash").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in names[1:]]), "phrases-candidates")
    levels, filters = [frequent], [filter_bits(spark, frequent, 1)]
    size, slices = tally_size(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    for k in range(2, longest + 1):
        levels.append(candidates(spark, codes, k, filters, tallied(spark, codes, filters, least, size, slices), least, longest))
        filters.append(filter_bits(spark, levels[-1], k))
    everything = reduce(DataFrame.unionByName, levels)
    turns = max(1, -(-everything.count() * 5 // (4 * turn)))  # hashes do not deal them out quite evenly
    of_turn = _dealt() % turns
    asked = reduce(DataFrame.unionByName, levels[1:]).withColumn("reads", F.array_repeat(F.lit(0).cast("long"), 2 * longest - 1))
    for t in range(turns):
        table = Table(_array_of(everything.filter(of_turn == t).toArrow(), longest))
        asked = read_cuts(spark, asked, table, counted(spark, codes, table, filters, longest, t, turns), longest, t, turns)
        if t % 8 == 7:
            asked = written(asked, "phrases-read")
    return written(_ranked(written(asked, "phrases-read"), words, names, longest, most, scale, inside, buckets=16 * turns), "phrases-found")


def _ranked(known: DataFrame, words: DataFrame, names: list[str], longest: int, most: int, scale: int, inside: tuple[int, int], buckets: int) -> DataFrame:
    exact = lambda c: c.cast("decimal(38,0)")
    size = F.size(F.filter(F.array(*names), lambda w: w != 0))
    known = known.select("lang", *names, size.alias("size"), F.col("reads")[0].alias("a"), F.col("reads").alias("reads"))
    # the most frequent longer candidate that holds each phrase
    part = lambda i, k: F.struct(*[(F.col(names[i + j]) if j < k else F.lit(0).cast("long")).alias(names[j]) for j in range(longest)])
    held = [
        known.filter(F.col("size") == n).select("lang", "a", F.explode(F.array(*[part(i, k) for k in range(2, n) for i in range(n - k + 1)])).alias("s")).select("lang", "s.*", "a")
        for n in range(3, longest + 1)
    ]
    if held:
        longer = reduce(DataFrame.unionByName, held).groupBy("lang", *names).agg(F.max("a").alias("longer"))
        known = known.join(longer, ["lang", *names], "left").filter(F.col("longer").isNull() | (exact(F.col("longer")) * inside[1] < exact(F.col("a")) * inside[0]))
    cut = lambda k: F.struct(F.expr(f"CAST({scale}BD * CAST(a AS DECIMAL(24,0)) AS DECIMAL(38,0)) div CAST(reads[{2 * k - 1}] + reads[{2 * k}] AS DECIMAL(20,0))").alias("score"), F.lit(k).alias("k"), F.col("reads")[2 * k - 1].alias("l"), F.col("reads")[2 * k].alias("r"))
    cuts = F.array(*[F.when(F.col("size") > k, cut(k)) for k in range(1, longest)])
    scored = known.withColumn("cut", F.array_min(F.filter(cuts, lambda x: x.isNotNull()))).select("lang", *names, "a", "cut.l", "cut.r", "cut.score")
    # of equal score and count the phrase's bytes decide, so words are needed before ranks; few words are in frequent phrases
    spelt = words.select(F.col("lang"), F.col("hash"), F.col("word"))
    used = scored.select("lang", F.explode(F.array(*names)).alias("hash")).filter("hash <> 0").distinct()
    spelt = bounded(written(spelt.join(used, ["lang", "hash"], "left_semi"), "phrases-spelt"))
    for w in names:
        scored = scored.join(spelt.select("lang", F.col("hash").alias(w), F.col("word").alias(f"s{w}")), ["lang", w], "left")
    scored = scored.withColumn("phrase", F.concat_ws(" ", *[f"s{w}" for w in names]))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("bucket", bucket_of("phrase", n=buckets)).withColumn("at", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("at") <= most)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
