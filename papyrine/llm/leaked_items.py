"""Problem 8: passages of held-out test items inside a corpus.

Items give two kinds of windows: their whole length, and every passage of ``window`` words (the shortest leak that counts;
a shorter item is one passage). A text's windows of the same sizes get a SimHash, and fingerprints meet in blocks: passages
within Hamming distance 2 agree in one of three blocks, whole items within distance 7 agree in one of four blocks but for one bit,
so none within these radii is missed. Candidates are verified by the exact weighted similarity of their five-word shingles, and
passages word for word as well.

Before that, a window needs enough shingles of the items to be able to reach the similarity at all (a window of s shingles
needs 2st/(1+t) of them for a similarity t). Which shingles the items have is told by a bitmap of fixed size, so what is sent to the tasks
doesn't grow with the items; a shingle that only seems to be one costs a candidate, never a find. Items are not collected: windows
of both sides are joined on their blocks, each different window once, however many texts hold it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textbuf import BASES, U64, column, flat, mix, random_values, sized_powers, slices, word_tables
from papyrine.worktable import worktable

SLICE = 1 << 18
SHINGLE = 5
SIMILAR = 0.8
#: (first bit, bits) of the blocks, and the distance up to which they miss nothing, for passages and for whole items.
PASSAGE_BLOCKS, PASSAGE_RADIUS = ((0, 22), (22, 21), (43, 21)), 2
WHOLE_BLOCKS, WHOLE_RADIUS = ((0, 16), (16, 16), (32, 16), (48, 16)), 7
#: log2 of the bits of the bitmap of item shingles.
BITMAP = 24
#: Most matched windows that are sent to all tasks; with more, they meet the texts' windows by a salted shuffle.
SENT_MATCHES = 300_000
SALTS = 16


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end). Words are runs of letters and digits without
    regard to case and accents; everything else parts words."""
    cps, starts = flat(texts)
    base, kind = word_tables()
    k = kind[cps]
    here = np.concatenate([k, np.zeros(1, np.uint8)])
    counts = k == 1
    rank = np.concatenate([[0], np.cumsum(counts)])
    begins = np.zeros(len(cps) + 1, bool)
    inside = here != 0
    begins[1:] = inside[1:] & ~inside[:-1]
    begins[:1] = inside[:1]
    begins[starts[:-1]] |= inside[starts[:-1]]
    ends_after = np.zeros(len(cps) + 1, bool)
    ends_after[1:] = inside[:-1] & ~inside[1:]
    ends_after[starts[1:]] |= np.concatenate([inside[:1], inside])[starts[1:]]
    first, last = np.flatnonzero(begins[: len(cps)]), np.flatnonzero(ends_after)
    up, down = sized_powers(BASES[0], int(rank[-1]) + 1)
    packed = random_values(2)[base[cps[counts]]]
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(packed * up[: len(packed)])])
    hashed = mix((prefix[rank[last]] - prefix[rank[first]]) * down[rank[first]])
    kept = rank[last] > rank[first]
    first, hashed = first[kept], hashed[kept]
    return hashed, np.searchsorted(first, starts)


def _scale(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) | U64(1)


def shingles(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words along the last axis."""
    n = tokens.shape[-1] - size + 1
    if n < 1:
        return np.zeros((*tokens.shape[:-1], 0), U64)
    return mix(sum((tokens[..., k : k + n] * w for k, w in enumerate(_scale(size, 0))), np.zeros((*tokens.shape[:-1], n), U64)))


def simhash(windows: np.ndarray) -> np.ndarray:
    """Fingerprint of every row of word hashes: each bit as in the majority of the words."""
    n, size = windows.shape
    out = np.zeros(n, U64)
    for k in range(0, n, step := max(1, (1 << 22) // (64 * max(1, size)))):
        part = np.ascontiguousarray(windows[k : k + step])
        ones = np.unpackbits(part.view(np.uint8).reshape(len(part), size, 8), axis=2).sum(axis=1, dtype=np.int32)
        out[k : k + step] = np.packbits(2 * ones > size, axis=1).reshape(-1).view(U64)
    return out


def shingle_similarity(a: np.ndarray, b: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of paired windows; a shingle weighs what it occurs."""
    left, right = shingles(a, size), shingles(b, size)
    out = np.ones(len(a))
    for r in np.flatnonzero((left != right).any(axis=1)).tolist():
        x, nx = np.unique(left[r], return_counts=True)
        y, ny = np.unique(right[r], return_counts=True)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        common = np.minimum(nx[i], ny[j]).sum()
        out[r] = common / (nx.sum() + ny.sum() - common)
    return out


def needed(size: int, similar: float) -> int:
    """How many shingles of a window of ``size`` words must be shingles of the item."""
    s = size - min(SHINGLE, size) + 1
    return max(1, math.ceil(2 * s * similar / (1 + similar) - 1e-9))


# --- items ---------------------------------------------------------------------------------------------------------------


def _item_windows(window: int, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "item")
            tokens, bounds = words([t or "" for t in column(batch, "texte")])
            rows: list[tuple] = []
            for i, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n = b - a
                if not n:
                    continue
                mine, size = tokens[a:b], min(window, n)
                grams = shingles(mine, min(SHINGLE, n)).view(np.int64).tolist()
                rows.append((i, n, True, simhash(mine[None])[0].view(np.int64).item(), mine.view(np.int64).tolist(), grams))
                parts = np.lib.stride_tricks.sliding_window_view(mine, size)
                rows += [(i, size, False, p, w, None) for p, w in zip(simhash(parts).view(np.int64).tolist(), parts.astype(U64).view(np.int64).tolist(), strict=True)]
            types = [kind, pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["item", "mots", "entier", "empreinte", "jetons", "grammes"])

    return run


def _block(prints: Column, blocks: tuple[tuple[int, int], ...], first: int, flips: bool = False) -> Column:
    """Array of (bloc, cle) of a fingerprint, with ``flips`` also of its neighbours by one bit of the block."""
    every = []
    for k, (shift, width) in enumerate(blocks):
        key = F.shiftrightunsigned(prints, shift).bitwiseAND(F.lit((1 << width) - 1))
        near = [F.lit(0), *(F.lit(1 << b) for b in range(width))] if flips else [F.lit(0)]
        every += [F.struct(F.lit(first + k).alias("bloc"), key.bitwiseXOR(x.cast("long")).alias("cle")) for x in near]
    return F.array(*every)


def _bitmap(items: DataFrame) -> np.ndarray:
    """The shingles of all items as bits; at most 2**BITMAP / 64 rows come to the driver, whatever the number of items."""
    grams = items.where("entier").select(F.explode("grammes").alias("h")).select(F.shiftrightunsigned("h", 64 - BITMAP).alias("g"))
    rows = grams.groupBy(F.shiftright("g", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(g % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), U64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(U64)
    return out


# --- texts ---------------------------------------------------------------------------------------------------------------


def candidate_windows(tokens: np.ndarray, bounds: np.ndarray, bitmap: np.ndarray, sizes: list[int], similar: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, text of each) of the windows that have enough shingles of the items."""
    hits_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in sizes:
        gram = min(SHINGLE, size)
        if gram not in hits_of:
            at = shingles(tokens, gram) >> U64(64 - BITMAP)
            hits = np.flatnonzero((bitmap[at >> U64(6)] >> (at & U64(63))) & U64(1))
            text = np.searchsorted(bounds, hits, side="right") - 1
            inside = hits + gram <= bounds[text + 1]
            hits_of[gram] = hits[inside], text[inside]
        hits, text = hits_of[gram]
        least, span = needed(size, similar), size - gram
        if len(hits) < least:
            continue
        # the window that holds hits i .. i + least - 1 begins between these places
        lo, hi, same = hits[least - 1 :] - span, hits[: len(hits) - least + 1], text[least - 1 :] == text[: len(hits) - least + 1]
        mine = text[: len(hits) - least + 1]
        lo, hi = np.maximum(lo, bounds[mine]), np.minimum(hi, bounds[mine + 1] - size)
        some = np.flatnonzero(same & (lo <= hi))
        if not len(some):
            continue
        n = (hi - lo + 1)[some]
        first = np.unique(np.repeat(lo[some] - np.cumsum(n) + n, n) + np.arange(n.sum()))
        yield size, first, np.searchsorted(bounds, first, side="right") - 1


def _text_windows(shared, sizes: list[int], similar: float, kind: pa.DataType):
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["id", "mots", "h1", "h2", "n", "empreinte", "jetons"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            told: set[tuple[int, int, int]] = set()
            for begin, texts in slices(column(batch, "text"), SLICE):
                tokens, bounds = words(texts)
                for size, first, owner in candidate_windows(tokens, bounds, shared.value, sizes, similar):
                    for k in range(0, len(first), step := max(1, (1 << 20) // size)):
                        mat = tokens[first[k : k + step, None] + np.arange(size)]
                        h = [mix((mat * _scale(size, s)).sum(axis=1, dtype=U64)).view(np.int64) for s in (1, 2)]
                        _, at, n = np.unique(np.stack([owner[k : k + step], *h]), axis=1, return_index=True, return_counts=True)
                        h1, h2 = h[0][at], h[1][at]
                        jetons: list = []
                        for r, key in zip(at.tolist(), zip(h1.tolist(), h2.tolist(), strict=True), strict=True):
                            new = (size, *key) not in told
                            told.add((size, *key))
                            jetons.append(mat[r].view(np.int64) if new else None)
                        prints = simhash(mat[at]).view(np.int64)
                        mine = ids.take(pa.array(begin + owner[k : k + step][at]))
                        cols = [np.full(len(at), size), h1, h2, n, prints, jetons]
                        yield pa.RecordBatch.from_arrays([mine, *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], names=names)

    return run


def _verified(similar: float, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = column(batch, "jetons"), column(batch, "item_jetons")
            sizes, whole = np.array(column(batch, "mots")), np.array(column(batch, "entier"), bool)
            alike, equal = np.zeros(len(left)), np.zeros(len(left), bool)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                for k in range(0, len(rows), step := max(1, (1 << 20) // size)):
                    some = rows[k : k + step]
                    a, b = (np.array([x[r] for r in some.tolist()], np.int64).view(U64) for x in (left, right))
                    equal[some] = (a == b).all(axis=1)
                    alike[some] = shingle_similarity(a, b, min(SHINGLE, size))
            kept = np.flatnonzero((alike >= similar) & (whole | equal))
            out = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [*(out.column(out.schema.get_field_index(c)) for c in ("mots", "h1", "h2", "item")), pa.array(np.where(whole, alike, 0.0)[kept]), pa.array((equal & ~whole)[kept])],
                names=["mots", "h1", "h2", "item", "similarite", "egale"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "texte", window: int = 12, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, similarite, n_fenetres_egales, mots_passage): ``similarite`` is the best similarity of a window of the text
    as long as the item, if it is ``similar`` or more, else 0; ``n_fenetres_egales`` counts the text's windows of ``mots_passage`` words
    that are a passage of the item word for word. ``mots_passage`` is ``window`` or, for a shorter item, its length. Rows
    have at least one of the two.

    Ids keep their types. Null and empty texts hold nothing; items without a word can't be searched, see :func:`unsearchable`.
    A document that comes twice counts its windows twice, an item that comes twice counts once. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0")
    wanted = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("texte")).where("item is not null and texte is not null").distinct()
    id_ddl, item_ddl = source.schema["id"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    id_kind, item_kind = (pa.schema(_arrow(df)).field(0).type for df in (source.select("id"), wanted.select("item")))
    known = worktable(wanted.mapInArrow(_item_windows(window, item_kind), f"item {item_ddl}, mots int, entier boolean, empreinte long, jetons array<long>, grammes array<long>"), "p8-items")
    sizes = sorted(r.mots for r in known.select("mots").distinct().collect())  # as many as there are lengths of items
    shared = spark.sparkContext.broadcast(_bitmap(known))
    seen = worktable(source.mapInArrow(_text_windows(shared, sizes, similar, id_kind), f"id {id_ddl}, mots int, h1 long, h2 long, n long, empreinte long, jetons array<long>"), "p8-windows")

    window_key = ["mots", "h1", "h2"]
    contents = seen.where("jetons is not null").dropDuplicates(window_key)
    both = F.concat(_block(F.col("empreinte"), PASSAGE_BLOCKS, 0), _block(F.col("empreinte"), WHOLE_BLOCKS, len(PASSAGE_BLOCKS)))
    asked = contents.select(*window_key, "empreinte", "jetons", F.inline(both))
    passages = known.where("not entier").dropDuplicates(["item", "empreinte", "jetons"]).withColumn("blocs", _block(F.col("empreinte"), PASSAGE_BLOCKS, 0))
    wholes = known.where("entier").withColumn("blocs", _block(F.col("empreinte"), WHOLE_BLOCKS, len(PASSAGE_BLOCKS), flips=True))
    index = passages.unionByName(wholes).select("item", "mots", "entier", F.col("empreinte").alias("item_empreinte"), F.col("jetons").alias("item_jetons"), F.inline("blocs"))
    near = F.bit_count(F.col("empreinte").bitwiseXOR(F.col("item_empreinte"))) <= F.when(F.col("entier"), F.lit(WHOLE_RADIUS)).otherwise(F.lit(PASSAGE_RADIUS))
    pairs = asked.join(index, ["mots", "bloc", "cle"]).where(near).select(*window_key, "item", "entier", "jetons", "item_jetons").dropDuplicates([*window_key, "item", "entier", "item_jetons"])
    checked = pairs.mapInArrow(_verified(similar, item_kind), f"mots int, h1 long, h2 long, item {item_ddl}, similarite double, egale boolean")
    matches = worktable(checked.groupBy(*window_key, "item").agg(F.max("similarite").alias("similarite"), F.max("egale").alias("egale")), "p8-matches")

    places = seen.select("id", *window_key, "n")
    if matches.count() <= SENT_MATCHES:
        met = places.join(F.broadcast(matches), window_key)
    else:
        salted = matches.withColumn("sel", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = places.withColumn("sel", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*window_key, "sel"])
    lengths = known.where("entier").groupBy("item").agg(F.least(F.max("mots"), F.lit(window)).alias("mots_passage"))
    found = met.groupBy("id", "item").agg(F.max("similarite").alias("similarite"), F.sum(F.when(F.col("egale"), F.col("n")).otherwise(F.lit(0))).alias("n_fenetres_egales"))
    return found.join(lengths, "item").select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarite", "n_fenetres_egales", "mots_passage")


def _arrow(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def unsearchable(items: DataFrame, item_col: str = "item_id", item_text: str = "texte") -> DataFrame:
    """(item_id) of the items without any letter or digit, which no search can find; null texts are among them."""
    return items.where(~F.coalesce(F.col(item_text).rlike(r"[\p{L}\p{N}]"), F.lit(False))).select(F.col(item_col).alias("item_id")).distinct()
