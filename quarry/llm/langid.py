"""Language identification of mixed text: script ranges, then Viterbi over words.

A word's script leaves those learned languages as candidates that are written in it. Candidates are scored by hashed
n-grams of the word's bytes, and the best labelling of a text's words, with a penalty for each switch, gives its spans.

Counts for the model come from a bounded sample of the given documents (`most`, a parameter) and fill a table whose size is
buckets times languages; labelling covers all words of all documents.
Defined results: null texts and texts without a letter are `und` with score zero and no spans; without any learned language all
texts are; ties go to the language first in order; repeated rows are labelled each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, tidy


def _class(*categories: str, end: int = 0x110000) -> str:
    """The characters of the categories below `end` as ranges of a character class."""
    marks = [c for c in (*range(min(end, 0x20000)), *range(min(end, 0xE0000), min(end, 0xE0200))) if unicodedata.category(chr(c)) in categories]
    cuts = [i for i in range(1, len(marks)) if marks[i] != marks[i - 1] + 1]
    return "".join(f"{re.escape(chr(marks[a]))}-{re.escape(chr(marks[b - 1]))}" for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True))


_MARKS, _NUMERALS = _class("Mn", "Mc", "Me"), _class("Nl", "No")
#: Letters (categories L), with the marks (categories M) that stand among them; numerals such as fractions are none.
_LETTER = rf"[^\W\d_{_NUMERALS}]"
WORD = re.compile(rf"{_LETTER}+(?:[{_MARKS}]+{_LETTER}*)*")
#: The same for texts that hold neither marks nor such numerals, which is faster to match; texts with characters of higher planes are matched in full.
_ODD, _PLAIN = re.compile(f"[{_class('Mn', 'Mc', 'Me', 'Nl', 'No', end=0x10000)}\U00010000-\U0010FFFF]"), re.compile(r"[^\W\d_]+")
#: Where the ranges of code points of the scripts begin, from the Unicode block list; what lies below the first is Latin.
RANGES = ((0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x780, "other"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "other"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"))
SCRIPTS = ("Latin", *dict.fromkeys(s for _, s in RANGES if s != "Latin"))
_STARTS = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([0, *(SCRIPTS.index(s) for _, s in RANGES)])
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
MOST = 20_000
#: The least share of a language's words for it to be a candidate in their script.
LEAST_SHARE = 0.01


class Model(NamedTuple):
    langs: list[str]
    scripts: np.ndarray  # script by language: whether it is a candidate
    table: np.ndarray  # (orders * BUCKETS + 1) by language: log shares; the last row is zero


def words(text: str | None) -> list[str]:
    t = (text or "").lower()
    return (WORD if _ODD.search(t) else _PLAIN).findall(t)


def script_of(found: list[str]) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_STARTS, np.array([ord(w[0]) for w in found], np.int64), "right")]


def _grams(found: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket at each byte, the zero row where none starts, and the byte at which each word starts."""
    data = np.frombuffer(f" {' '.join(found)} ".encode(), np.uint8).astype(np.uint64)
    space = data == 32
    out = []
    for k, n in enumerate(ORDERS):
        size = max(0, len(data) - n + 1)
        h = np.zeros(size, np.uint64)
        inner = np.zeros(size, bool)
        for i in range(n):
            h = h * np.uint64(1_000_003) + data[i : i + size]
            if 0 < i < n - 1:
                inner |= space[i : i + size]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        bucket = np.full(len(data), len(ORDERS) * BUCKETS, np.int64)
        bucket[:size] = np.where(inner, len(ORDERS) * BUCKETS, h.astype(np.int64) + k * BUCKETS)
        bucket[-1] = len(ORDERS) * BUCKETS
        out.append(bucket)
    return out, np.flatnonzero(space)[:-1]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, smoothing: float = 0.2) -> Model:
    """Learned from docs with a non-null lang: about `most` of them, drawn at random with a fixed seed.

    The sample is shared out evenly by language, and a language of fewer rows than its share keeps all of them, so rare ones are learned at any size.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a number per language
    quota = max(1, most // max(1, len(counts)))
    if any(n > quota for n in counts.values()):
        rows = rows.sampleBy("lang", {x: min(1.0, quota / n) for x, n in counts.items()}, seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        sums: dict[str, np.ndarray] = {}

        def fold() -> None:
            for lang_, c in seen.items():
                own = sums.setdefault(lang_, np.zeros(len(ORDERS) * BUCKETS + 1 + len(SCRIPTS)))
                if c:
                    found, weight = list(c), np.fromiter(c.values(), np.float64, len(c))
                    buckets, starts = _grams(found)
                    each = np.repeat(weight, np.diff([*starts, len(buckets[0])]))
                    for b in buckets:
                        own[: len(ORDERS) * BUCKETS + 1] += np.bincount(b, each, len(ORDERS) * BUCKETS + 1)
                    own[len(ORDERS) * BUCKETS + 1 :] += np.bincount(script_of(found), weight, len(SCRIPTS))
            seen.clear()

        for b in slices(batches, 1000):
            for t, lang_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[lang_].update(words(t))
            fold()
        for lang_, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "at", "n"])

    counted = rows.mapInArrow(tidy(run), "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()  # a row per bucket and language at most
    langs = sorted(counted["lang"].unique())
    sums = np.zeros((len(ORDERS) * BUCKETS + 1 + len(SCRIPTS), len(langs)))
    sums[counted["at"].to_numpy(int), counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = counted["n"]
    scripts = sums[len(ORDERS) * BUCKETS + 1 :]
    table = sums[: len(ORDERS) * BUCKETS + 1] + smoothing
    for k in range(len(ORDERS)):
        part = table[k * BUCKETS : (k + 1) * BUCKETS]
        part[:] = np.log(part / part.sum(axis=0))
    table[-1] = 0
    return Model(langs, scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=0), 1), table.astype(np.float32))


def word_scores(model: Model, found: list[str], floor: float = 6.0) -> np.ndarray:
    """By word and language, how far below the best candidate, `floor` at most; languages of other scripts stand below that."""
    buckets, starts = _grams(found)
    total = np.add.reduceat(sum(model.table[b] for b in buckets), starts, axis=0)
    may = model.scripts[script_of(found)]
    may |= ~may.any(axis=1, keepdims=True)
    total = np.where(may, total, -np.inf)
    return np.where(may, np.maximum(total - total.max(axis=1, keepdims=True), -floor), -2 * floor).astype(np.float32)


def viterbi(scores: np.ndarray, ids: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, texts one after another; all texts of a batch step on together."""
    states, ends = scores.shape[1], np.cumsum(lengths)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (ends - lengths)[order], lengths[order]
    back, own = np.zeros((len(ids), states), np.int16), np.arange(states)
    most = np.zeros((len(order), states), np.float32)
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    rows = np.arange(len(order))
    for t, k in enumerate(alive.tolist()):
        at, m = starts[:k] + t, most[:k]
        if t:
            b = m.argmax(axis=1)
            best = (m[rows[:k], b] - penalty)[:, None]
            stay = m >= best
            back[at] = np.where(stay, own, b[:, None])
            m = np.where(stay, m, best)
        most[:k] = m + scores[ids[at]]
    label, state = np.zeros(len(ids), np.int64), most.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = starts[:k] + t
        label[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return label


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = 9.0) -> DataFrame:
    """docs with lang_pred, score (the share of letters in that language) and spans (start and end in words, lang)."""
    sent, place = docs.sparkSession.sparkContext.broadcast(tuple(model)), docs.columns.index(text)  # its size is that of the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for b in slices(batches, 1000):
            number: dict[str, int] = defaultdict(count().__next__)
            found = [words(t) if model.langs else [] for t in b.column(place).to_pylist()]
            lengths = np.array([len(x) for x in found], np.int64)
            ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in found)])
            pred, share = ["und"] * len(found), np.zeros(len(found))
            n_spans, cut, label = np.zeros(len(found), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(found)), lengths)
            first = np.cumsum(lengths) - lengths
            if len(ids):
                label = viterbi(word_scores(model, list(number)), ids, lengths, penalty)
                letters = np.fromiter(map(len, number), np.int64, len(number))[ids]
                sums = np.bincount(doc * len(model.langs) + label, letters, len(found) * len(model.langs)).reshape(len(found), -1)
                for i in np.flatnonzero(lengths).tolist():
                    pred[i], share[i] = model.langs[sums[i].argmax()], sums[i].max() / sums[i].sum()
                cut = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
                n_spans = np.bincount(doc[cut], minlength=len(found))
            end = np.concatenate([cut[1:], [len(ids)]])[: len(cut)]
            spans = pa.StructArray.from_arrays([pa.array(cut - first[doc[cut]]), pa.array(end - first[doc[cut]]), pa.array([model.langs[x] for x in label[cut].tolist()], pa.string())], names=["start", "end", "lang"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(share), lists], names=[*b.schema.names, "lang_pred", "score", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")
