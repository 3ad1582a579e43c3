"""Table functions for what is inherently sequential in a text: blocks of Markdown, packed windows, chunks with overlap.

Each call gets one document, so documents are dealt over tasks by Spark; a text's length is the only bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_CAPTION = re.compile(r"(?i)^\s*(figure|fig\.?|table)\s*(\d+)")
_IMAGE = re.compile(r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']([^"']+)|!\[[^\]]*\]\(([^)\s]+)""")


def parse_blocks(text: str | None) -> Iterator[tuple[int, str, str, str | None, str | None, str | None]]:
    """(order, type, text, image, caption kind, caption number) of each block; a line-wise machine with one open block."""
    order, held, until = 0, [], None

    def done(kind: str | None = None):
        nonlocal order, held
        raw = "\n".join(held).strip()
        held = []
        if not raw:
            return
        image, cap = _IMAGE.search(raw), _CAPTION.match(re.sub(r"<[^>]*>", "", raw))
        if kind is None:
            kind = "heading" if re.match(r"#{1,6}\s", raw) else "caption" if cap else "image" if image else "paragraph"
        plain = " ".join(re.sub(r"<[^>]*>", " ", raw).split()) if kind in ("table", "html", "caption") else raw
        order += 1
        yield order, kind, plain, (image[1] or image[2]) if image else None, ("figure" if cap[1].lower().startswith("fig") else "table") if cap else None, cap[2] if cap else None

    for line in (text or "").split("\n"):
        bare = line.strip()
        if until:
            held.append(line)
            if until in bare.lower():
                kind, until = ("table" if until == "</table>" else "html"), None
                yield from done(kind)
        elif m := re.match(r"(?i)<(table|div)\b", bare):
            yield from done()
            held.append(line)
            close = f"</{m[1].lower()}>"
            if close in bare.lower():
                yield from done("table" if close == "</table>" else "html")
            else:
                until = close
        elif re.match(r"#{1,6}\s|!\[|(?i:<img\b)", bare):
            yield from done()
            held.append(line)
            yield from done()
        elif bare:
            held.append(line)
        else:
            yield from done()
    yield from done()


def split_long(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most `limit` characters, broken after a sentence or line past the half where there is one."""
    while len(text) > limit:
        cut = max((text.rfind(s, 0, limit) + len(s) for s in (". ", "; ", "\n") if text.rfind(s, 0, limit) >= limit // 2), default=limit)
        yield text[:cut].strip()
        text = text[cut:].strip()
    if text:
        yield text


def windows(text: str | None, limit: int = 10_000, overlap: int = 1) -> Iterator[str]:
    """Paragraphs packed greedily up to the limit, the last `overlap` of one window opening the next."""
    parts = [p for raw in re.split(r"\n\s*\n", text or "") if raw.strip() for p in split_long(raw.strip(), limit)]
    held: list[str] = []
    fresh = 0
    for p in parts:
        if held and sum(map(len, held)) + 2 * len(held) + len(p) > limit:
            if fresh:
                yield "\n\n".join(held)
            held = held[-overlap:] if overlap else []
            while held and sum(map(len, held)) + 2 * len(held) + len(p) > limit:
                held.pop(0)
            fresh = 0
        held.append(p)
        fresh += 1
    if fresh:
        yield "\n\n".join(held)


def chunks(text: str | None, limit: int = 7_000, overlap: int = 600) -> Iterator[str]:
    """Chunks of at most `limit` characters that end after a sentence where one ends past the half; each repeats the last `overlap` characters."""
    text, start = text or "", 0
    while start < len(text):
        end = min(len(text), start + limit)
        if end < len(text):
            stops = [m.end() for m in re.finditer(r"[.!?]\s", text[start:end]) if m.end() >= limit // 2]
            end = start + stops[-1] if stops else end
        if piece := text[start:end].strip():
            yield piece
        if end >= len(text):
            return
        start = max(start + 1, end - overlap)


@udtf(returnType="block int, kind string, text string, image string, caption_kind string, caption_number string", useArrow=True)
class Blocks:
    def eval(self, text: str):
        yield from parse_blocks(text)


@udtf(returnType="at int, text string", useArrow=True)
class Windows:
    def eval(self, text: str, limit: int, overlap: int):
        yield from enumerate(windows(text, limit, overlap))


@udtf(returnType="at int, text string", useArrow=True)
class Chunks:
    def eval(self, text: str, limit: int, overlap: int):
        yield from enumerate(chunks(text, limit, overlap))


def register(spark: SparkSession) -> None:
    """Make the table functions usable in SQL: md_blocks, text_windows, text_chunks."""
    spark.udtf.register("md_blocks", Blocks)
    spark.udtf.register("text_windows", Windows)
    spark.udtf.register("text_chunks", Chunks)
