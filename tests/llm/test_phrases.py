import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import phrases


def plain(docs, longest, least, most, scale, inside):
    """The contract in plain counters."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        dropped = set()
        for g, a in cands.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    if inside[1] * a >= inside[0] * cands[g[i : i + k]]:
                        dropped.add(g[i : i + k])
        rows = []
        for g, a in cands.items():
            if g not in dropped:
                score, _, left, right = min((scale * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def documents(seed, n):
    rng = np.random.default_rng(seed)
    words = [*"abcdefgh", "Ab", "é", "ß", " ", "日本", "x" * 40, "\x00", "\x7f"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?", " \r "]
    text = lambda: "".join(words[int(rng.zipf(1.4)) % len(words)] + ends[rng.integers(len(ends))] for _ in range(rng.integers(0, 120)))
    docs = [([None, "en", "de", "", "und", "e n"][rng.integers(6)], text()) for _ in range(n)]
    return docs + [("en", None), (None, None), ("fr", ""), ("fr", " . "), ("en", "a b c d. " * 700), ("en", "a " * 3000), ("de", docs[0][1]), ("de", docs[0][1])]


@pytest.mark.parametrize("longest,least,turn,row", [(4, 5, 1 << 19, 1 << 20), (3, 3, 40, 64), (5, 4, 150, 17), (2, 30, 1 << 19, 100)])
def test_equals_plain(spark, longest, least, turn, row):
    docs = documents(longest, 150)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(docs)], "doc_id long, lang string, text string").repartition(5)
    got = phrases.mine(df, longest=longest, least=least, most=50, turn=turn, row=row)
    assert sorted(map(tuple, got.collect())) == plain(docs, longest, least, 50, 2_000_000, (80, 100))


def test_empty_and_columns_of_other_names(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine(df).count() == 0
    clash = "hash long, word string, kind string, own long, codes binary, n long, w1 long, reads int, score int"
    df = spark.createDataFrame([("en", "a b", *[None] * 9)] * 40, f"lang string, text string, {clash}")
    assert [tuple(r) for r in phrases.mine(df).collect()] == [("en", 1, "a b", 40, 40, 40, 80, 1_000_000)]


def test_long_texts_go_in_blocks(spark, monkeypatch):
    text = b"one two, three\tfour " * 200 + b"x" * 5000 + b" five"
    for size in (1, 7, 64, 1000):
        parts = list(phrases.blocks_of(text, size))
        assert b"".join(parts) == text.translate(phrases.LOWERED) and sum((len(p.replace(b"\xff", b" \xff ").split()) for p in parts)) == len(text.translate(phrases.LOWERED).replace(b"\xff", b" \xff ").split())
    docs = [("en", "a b c d e. f g " * 40_000)]
    got = phrases.mine(spark.createDataFrame(docs, "lang string, text string"), row=1000)
    assert sorted(map(tuple, got.collect())) == plain(docs, 4, 30, 2000, 2_000_000, (80, 100))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    slots = phrases.Slots(keys)
    assert sorted(slots.of(keys).tolist()) == list(range(len(keys)))
    assert (slots.of(np.arange(100, dtype=np.uint64)) < max(len(keys), 1)).all()


def test_stored_keys_verify():
    keys = np.random.default_rng(2).integers(1, 2**63, (3000, 4)).astype(np.uint64)
    keys[::2, 3] = 0
    t = phrases.Table(keys)
    found = t.find(list(keys.T))
    assert sorted(found.tolist()) == list(range(3000)) and (t.keys[found] == keys).all()
    assert (t.find(list(np.roll(keys, 1, axis=0)[:, [1, 0, 2, 3]].T)) == -1).all()


def test_slices_turns_and_early_sends_change_nothing(spark, monkeypatch):
    sent, lookups = phrases.candidates, []
    monkeypatch.setattr(phrases, "tally_size", lambda words: (1 << 16, 5))
    monkeypatch.setattr(phrases, "candidates", lambda *a: sent(*a, gathered=64))
    monkeypatch.setattr(phrases, "counted", lambda *a, of=phrases.counted: lookups.append(a[-1]) or of(*a))
    docs = documents(9, 100)
    got = phrases.mine(spark.createDataFrame(docs, "lang string, text string").repartition(3), least=4, most=50, turn=60, row=64)
    assert sorted(map(tuple, got.collect())) == plain(docs, 4, 4, 50, 2_000_000, (80, 100))
    assert len(lookups) > 1 and set(lookups) == {len(lookups)}


def test_the_tally_keeps_pace_with_the_corpus():
    for words in (0, 1, 10**8, 10**9, 10**10, 10**11):
        size, slices = phrases.tally_size(words)
        assert size <= phrases.MOST_TALLY and words <= phrases.LOAD * size * slices
    assert phrases.tally_size(0) == (phrases.TALLY, 1)
