"""Problem 3: texts over a size limit cut into overlapping pieces at natural boundaries.

Recursive bisection: a span over ``limit - overlap`` is cut at the strongest boundary in its middle half, the one
nearest the midpoint, and its halves are cut in turn. Boundaries from strong to weak: page, paragraph, line, sentence,
word; where the middle half has none, the midpoint itself. Overlaps are attached at the end, so no piece is over ``limit``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textbuf import column

PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?…][»”\"')\]]*\s+")
WORD = re.compile(r"\s+")
STRENGTHS = ("page", "paragraphe", "ligne", "phrase", "mot", "milieu")


def nearest(pattern: re.Pattern, text: str, lo: int, hi: int, mid: int) -> int | None:
    """End of the match in ``[lo, hi)`` nearest to ``mid``."""
    m = pattern.search(text, mid, hi)
    after = m.end() if m and m.end() < hi else None
    reach = 128
    while True:
        begin = max(lo, mid - reach)
        before = None
        for m in pattern.finditer(text, begin, min(hi, mid + 8)):
            if m.start() < mid and lo < m.end() < hi:
                before = m.end()
        if before is not None or begin == lo:
            break
        reach *= 4
    if before is None or after is None:
        return after if before is None else before
    return before if abs(mid - before) <= after - mid else after


def midpoint_cut(text: str, lo: int, hi: int, pages: list[int]) -> tuple[int, int]:
    """(place, strength) of the cut of ``[lo, hi)``; the place is where the right half begins."""
    mid, reach = (lo + hi) // 2, (hi - lo) // 4
    a, b = mid - reach, mid + reach
    k = bisect_left(pages, mid)
    close = [p for p in pages[max(0, k - 1) : k + 1] if a < p < b]
    if close:
        return min(close, key=lambda p: abs(p - mid)), 0
    for strength, pattern in enumerate((PARAGRAPH, LINE, SENTENCE, WORD), 1):
        if (p := nearest(pattern, text, a, b, mid)) is not None:
            return p, strength
    while mid > a + 1 and unicodedata.combining(text[mid]):
        mid -= 1
    return mid, 5


def cut(text: str, limit: int, overlap: int, pages: list[int]) -> list[tuple[int, int, int, int]]:
    """(begin without overlap, end, begin with overlap, strength of the cut before) of each piece."""
    if len(text) <= limit:
        return [(0, len(text), 0, -1)]
    cuts, open_spans = [], [(0, len(text))]
    while open_spans:
        lo, hi = open_spans.pop()
        if hi - lo > limit - overlap:
            place, strength = midpoint_cut(text, lo, hi, pages)
            cuts.append((place, strength))
            open_spans += [(lo, place), (place, hi)]
    cuts.sort()
    out, before = [], 0
    for (begin, strength), end in zip([(0, -1), *cuts], [*(c for c, _ in cuts), len(text)], strict=True):
        first = max(before, begin - overlap)
        if before < first < begin and not (text[first - 1].isspace() and not text[first].isspace()):
            m = WORD.search(text, first, begin)
            first = m.end() if m and m.end() < begin else first
        out.append((begin, end, first if begin else 0, strength))
        before = begin
    return out


def page_starts(pages: list[str | None] | None, text: str) -> list[int]:
    """Where pages begin in ``text``, if it is their joined and stripped form; else form feeds only."""
    joined = "\n".join(p or "" for p in pages or [])
    starts = [m.end() for m in re.finditer("\f", text)]
    if joined.strip() != text:
        return starts
    shift, at = len(joined) - len(joined.lstrip()), 0
    for p in (pages or [])[:-1]:
        at += len(p or "") + 1
        if 0 < at - shift < len(text):
            starts.append(at - shift)
    return sorted(set(starts))


PIECES = pa.schema([("id", pa.int64()), ("rang", pa.int32()), ("n_morceaux", pa.int32()), ("debut", pa.int32()), ("fin", pa.int32()), ("chevauchement", pa.int32()), ("coupe", pa.string()), ("texte", pa.string())])
PIECES_DDL = "id long, rang int, n_morceaux int, debut int, fin int, chevauchement int, coupe string, texte string"


def _split(limit: int, overlap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, text, pages in zip(*(column(batch, c) for c in ("id", "text", "pages")), strict=True):
                if text is None:
                    continue
                pieces = cut(text, limit, overlap, page_starts(pages, text) if len(text) > limit else [])
                for k, (begin, end, first, strength) in enumerate(pieces):
                    rows.append((i, k, len(pieces), begin, end, begin - first, STRENGTHS[strength] if strength >= 0 else None, text[first:end]))
                size += len(text)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return run


def split_texts(df: DataFrame, id_col: str, text_col: str, pages_col: str | None = None, limit: int = 6000, overlap: int = 300) -> DataFrame:
    """(id, rang, n_morceaux, debut, fin, chevauchement, coupe, texte): the pieces of every text in order.

    ``[debut, fin)`` are 0-based characters without the overlap, so these spans join up to the text again;
    ``texte`` begins ``chevauchement`` characters earlier. A text within the limit is one piece, an empty text one
    empty piece, a null text none. A row that comes twice is cut twice. No shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of limit")
    pages = F.col(pages_col) if pages_col else F.lit(None).cast("array<string>")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), pages.alias("pages")).mapInArrow(_split(limit, overlap), PIECES_DDL)
