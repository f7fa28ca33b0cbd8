"""Problem 1: records that differ only in layout (white space, letter case, punctuation, JSON layout).

Every record is read once. A skip-and-fold table turns its characters into 64-bit values (0 for what
is skipped); two rolling polynomial hashes run over the values, so no canonical text is ever built.
Copies within an Arrow batch are set aside at once, which is the combine step before the shuffle: however
hot a group is, a batch sends one text of it. The remaining texts meet by hash, and rows with equal hashes
are compared by two pointers that skip what the table skips. A real collision opens another class.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textbuf import BASES, U64, column, flat, fold_tables, mix, random_values, sized_powers, slices
from papyrine.worktable import worktable

#: Most characters hashed at once.
SLICE = 1 << 20
#: Noncharacters, so never part of a text: end of an element, end of a field.
ELEMENT, FIELD = "\ufdd0", "\ufdd1"
#: Marks a sheet that can't be parsed; such a sheet is a copy only of one with the same characters.
BROKEN = "\ufdd2"


def record_text(raw: str | None, scalar: str, lists: tuple[str, ...]) -> str | None:
    """The compared fields of one JSON object in declared order, with their separators.

    Null gives null. Null, empty and absent lists are alike; null elements don't count. A scalar in
    place of a list is a list of one. Elements that aren't strings are compared by their JSON text.
    """
    if raw is None:
        return None
    try:
        doc = json.loads(raw)
    except ValueError:
        return BROKEN + raw
    if not isinstance(doc, dict):
        return BROKEN + raw
    as_text = lambda x: x if isinstance(x, str) else json.dumps(x, sort_keys=True)
    key = doc.get(scalar)
    parts = ["" if key is None else as_text(key), FIELD]
    for name in lists:
        value = doc.get(name)
        for x in value if isinstance(value, list) else [value]:
            if x is not None:
                parts += (as_text(x), ELEMENT)
        parts.append(FIELD)
    return "".join(parts)


def fold_values(which: int) -> np.ndarray:
    """The skip-and-fold table: a random 64-bit value per folded code point, 0 for skipped ones."""
    lower, kind = fold_tables()
    return np.where(kind == 0, U64(0), random_values(which)[lower])


_TABLES: dict[int, np.ndarray] = {}
_SKIP = None


def fold_hashes(texts: list[str], which: int) -> np.ndarray:
    """Polynomial hash of each text over its characters that aren't skipped, as int64."""
    if which not in _TABLES:
        _TABLES[which] = fold_values(which)
    cps, starts = flat(texts)
    if not len(cps):
        return mix(np.zeros(len(texts), U64)).view(np.int64)
    values = _TABLES[which][cps]
    kept = values != 0
    rank = np.concatenate([[0], np.cumsum(kept)])
    values, bounds = values[kept], rank[starts]
    up, down = sized_powers(BASES[which], len(values) + 1)
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[: len(values)])])
    return mix((prefix[bounds[1:]] - prefix[bounds[:-1]]) * down[bounds[:-1]] + mix((bounds[1:] - bounds[:-1]).astype(U64))).view(np.int64)


def _runs() -> re.Pattern:
    global _SKIP
    if _SKIP is None:
        kind = fold_tables()[1]
        edges = np.flatnonzero(np.diff(np.concatenate([[1], kind, [1]])))
        spans = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))
        _SKIP = re.compile(f"[^{spans}]+")
    return _SKIP


def same_apart_from_layout(a: str, b: str) -> bool:
    """Two pointers walk both texts from run to run of characters that count, without building either canonical text."""
    if a == b:
        return True
    lower = fold_tables()[0]
    left, right = (_runs().finditer(x) for x in (a, b))
    i = iend = j = jend = 0
    while True:
        if i == iend:
            m = next(left, None)
            i, iend = m.span() if m else (-1, -1)
        if j == jend:
            m = next(right, None)
            j, jend = m.span() if m else (-1, -1)
        if i < 0 or j < 0:
            return i < 0 and j < 0
        n = min(iend - i, jend - j)
        x, y = a[i : i + n], b[j : j + n]
        if x != y and any(lower[ord(p)] != lower[ord(q)] for p, q in zip(x, y, strict=True)):
            return False
        i, j = i + n, j + n


SENT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("rep_id", pa.int64()), ("rec", pa.string()), ("n_here", pa.int32()), ("members", pa.list_(pa.int64()))])
SENT_DDL = "h1 long, h2 long, rep_id long, rec string, n_here int, members array<long>"


def _combine(scalar: str, lists: tuple[str, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, r) for i, c in zip(column(batch, "id"), column(batch, "raw"), strict=True) if (r := record_text(c, scalar, lists)) is not None and i is not None]
            pairs.sort(key=lambda p: p[0])
            texts = [r for _, r in pairs]
            h1, h2 = ([h for _, some in slices(texts, SLICE) for h in fold_hashes(some, w).tolist()] for w in (0, 1))
            classes: dict[tuple[int, int], list[list]] = {}
            for (i, rec), key in zip(pairs, zip(h1, h2, strict=True), strict=True):
                for c in (held := classes.setdefault(key, [])):
                    if same_apart_from_layout(c[1], rec):
                        c[2].append(i)
                        break
                else:
                    held.append([i, rec, []])
            rows = [(k[0], k[1], i, rec, 1 + len(m), m) for k, held in classes.items() for i, rec, m in held]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, SENT, strict=True)], schema=SENT)

    return run


KEPT = pa.schema([("rep_id", pa.int64()), ("garde_id", pa.int64())])


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h1, h2, rep_id), so the first text of a class has its smallest id.

    A row goes out as soon as it is compared; one text per class is held, however long the class is.
    A text without any copy gives no row.
    """
    key, classes = None, []
    for batch in batches:
        reps, gardes = [], []
        for h1, h2, rep, rec, n in zip(*(column(batch, c) for c in ("h1", "h2", "rep_id", "rec", "n_here")), strict=True):
            if (h1, h2) != key:
                key, classes = (h1, h2), []
            garde = next((g for text, g in classes if same_apart_from_layout(text, rec)), None)
            if garde is None:
                classes.append((rec, garde := rep))
            if garde != rep or n > 1:
                reps.append(rep)
                gardes.append(garde)
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(gardes, pa.int64())], schema=KEPT)


def formatting_copies(df: DataFrame, id_col: str, json_col: str, scalar: str, lists: tuple[str, ...]) -> DataFrame:
    """(garde_id, copie_id): every record with a smaller-numbered record that differs only in layout.

    ``df`` has a unique long ``id_col``; ``json_col`` holds a JSON object whose ``scalar`` and ``lists``
    are compared. Rows with a null id or null JSON are no copies. An unparsable record is compared as
    raw text. An id that comes twice gives its records' copies under that id; an empty table gives none.
    Other columns are not read, whatever their names.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("raw"))
    sent = worktable(source.mapInArrow(_combine(scalar, lists), SENT_DDL), "p1")
    settled = (
        sent.select("h1", "h2", "rep_id", "rec", "n_here")
        .repartition("h1", "h2")
        .sortWithinPartitions("h1", "h2", "rep_id")
        .mapInArrow(_settle, "rep_id long, garde_id long")
    )
    kept = worktable(settled, "p1-kept")
    between = kept.where("rep_id <> garde_id").select("garde_id", F.col("rep_id").alias("copie_id"))
    within = (
        sent.where("n_here > 1").select("rep_id", "members")
        .join(kept, "rep_id")
        .select("garde_id", F.explode("members").alias("copie_id"))
    )
    return between.unionByName(within)


def copy_counts(copies: DataFrame) -> DataFrame:
    """(garde_id, n_exemplaires): one row per record that has copies, itself counted."""
    return copies.groupBy("garde_id").agg((F.count("*") + 1).alias("n_exemplaires"))
