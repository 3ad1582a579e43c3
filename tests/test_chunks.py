"""The chunking queries against brute force, over a table of whole texts."""

import random
import re

import pytest

from quarry.functions import blocks
from quarry.plans import texts as Q

SAID = ["one two. ", "three four! ", "five; six ", "a line\n", "\n\n", "no stop here ", "x" * 40 + " ", "é漢? "]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    random.seed(17)
    found = ["", None, "short.", "y" * 20_001, "\n\n\n"] + ["".join(random.choices(SAID, k=random.randint(1, 2500))) for _ in range(30)]
    path = str(tmp_path_factory.mktemp("chunks"))
    spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, found


def brute_chunks(text, limit, overlap):
    ends = {i + 2 for i in range(len(text) - 1) if text[i] in ".!?" and re.match(r"\s", text[i + 1])}
    start, out = 0, []
    while start < len(text):
        last = min(len(text), start + limit)
        fit = [e for e in ends if start + limit // 2 <= e <= last] if last < len(text) else []
        last = max(fit, default=last)
        out += [text[start:last].strip()]
        if last >= len(text):
            break
        start = max(start + 1, last - overlap)
    return [x for x in out if x]


def brute_windows(parts, limit):
    """Each window takes paragraphs while their joined text fits; the last of the window before opens it where the next one fits behind."""
    out, i, opener = [], 0, []
    while i < len(parts):
        held = opener if len("\n\n".join([*opener, parts[i]])) <= limit else []
        held = [*held, parts[i]]
        i += 1
        while i < len(parts) and len("\n\n".join([*held, parts[i]])) <= limit:
            held, i = [*held, parts[i]], i + 1
        out.append("\n\n".join(held))
        opener = held[-1:]
    return out


def test_chunks_equal_brute_force(spark, table):
    path, found = table
    got = {r.doc_id: (r.n_chunks, r.longest) for r in Q.chunks(spark, path).collect() if r.n_chunks and r.longest is not None}
    want = {i: brute_chunks(t or "", 7000, 600) for i, t in enumerate(found)}
    assert got == {i: (len(x), max(map(len, x))) for i, x in want.items() if x}
    assert all([*blocks.chunks(t, 500, 50)] == brute_chunks(t or "", 500, 50) for t in found[:12])


def test_packed_windows_equal_brute_force(spark, table):
    path, found = table
    got = {r.doc_id: (r.n_windows, r.longest) for r in Q.packed_windows(spark, path).collect() if r.n_windows and r.longest is not None}
    parts = {i: [p for raw in re.split(r"\n\s*\n", (t or "").replace("\n", "\n\n")) if raw.strip() for p in blocks.split_long(raw.strip(), 4000)] for i, t in enumerate(found)}
    want = {i: brute_windows(p, 4000) for i, p in parts.items()}
    assert got == {i: (len(x), max(map(len, x))) for i, x in want.items() if x}
    for t in found:
        pieces = [*blocks.split_long((t or "").strip(), 300)]
        assert all(0 < len(p) <= 300 for p in pieces) and re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", t or "")
