"""Problem 10: spans of at least ``min_len`` characters that stand verbatim in more than one text.

Level-wise doubling. Windows of half of ``min_len`` are taken at content-defined anchors (the smallest hash among the half windows
of every window of ``min_len``), so texts that share a span share its anchor. Only anchors found in two texts are doubled:
the windows of full length that belong to such an anchor make up its *territory*, a stretch of text. Equal territories
are one class however many texts hold them; the classes of an anchor meet in one task, where their windows are grouped by hash and
compared character by character. What comes out are runs of windows held by the same set of texts, which name the set by its
size, smallest id and fingerprint, so the result grows with the shared text, not with its pairs.

An anchor with more than ``HOT`` classes isn't brought to one task: its windows are spread by their own hashes and counted with
map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.textbuf import U64, Rolling, column, flat, slices, sliding_min
from papyrine.worktable import worktable

SLICE = 1 << 19
PLACE = U64((1 << 30) - 1)
#: Most classes of one anchor that are compared in one task.
HOT = 2_000
#: Most anchors whose places are sent to all tasks; with more, texts and places are brought together by a shuffle.
SENT_ANCHORS = 500_000
#: A territory held by more texts than this is joined to its runs in ``SALTS`` tasks.
HOT_MEMBERS = 100_000
SALTS = 16


def _owners(cps: np.ndarray, starts: np.ndarray, min_len: int, roll: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(place of every window of ``min_len`` inside one text, place of its anchor), flat places, ascending."""
    unit, n = min_len // 2, len(cps)
    if n < min_len:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.arange(n - unit + 1)
    order = (roll.at(places, unit) & ~PLACE) | places.astype(U64)
    own = (sliding_min(order, min_len - unit + 1) & PLACE).astype(np.int64)
    inside = np.zeros(len(own) + 1, np.int64)
    whole = np.diff(starts) >= min_len
    np.add.at(inside, starts[:-1][whole], 1)
    np.add.at(inside, starts[1:][whole] - min_len + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return at, own[at]


def _anchor_rows(min_len: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(column(batch, "id"), np.int64)
            for first, texts in slices(column(batch, "text"), SLICE):
                cps, starts = flat(texts)
                roll = Rolling(cps)
                at = np.unique(_owners(cps, starts, min_len, roll)[1])
                owner = np.searchsorted(starts, at, side="right") - 1
                unit = roll.at(at, min_len // 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(ids[first + owner]), pa.array((at - starts[owner]).astype(np.int32))], names=["unit", "id", "place"])

    return run


TERRITORY = pa.schema([("unit", pa.int64()), ("own", pa.int64()), ("id", pa.int64()), ("place", pa.int32()), ("context", pa.string())])


def _territories(min_len: int):
    """One row per surviving anchor: where its windows begin and the text they cover. ``own`` is the id where a text has
    the anchor's half window more than once, so that its repetitions within itself aren't taken for another text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marked = np.array(column(batch, "id"), np.int64), column(batch, "places")
            for first, texts in slices(column(batch, "text"), SLICE):
                cps, starts = flat(texts)
                roll = Rolling(cps)
                at, own = _owners(cps, starts, min_len, roll)
                wanted = np.concatenate([np.array(marked[first + k], np.int64) + starts[k] for k in range(len(texts))])
                kept = np.isin(own, wanted)
                at, own = at[kept], own[kept]
                heads = np.flatnonzero(np.diff(own, prepend=-1))
                begin, end = at[heads], at[np.append(heads[1:], len(at)) - 1] + min_len if len(at) else at
                owner = np.searchsorted(starts, begin, side="right") - 1
                unit = roll.at(own[heads], min_len // 2).view(np.int64)
                _, which, often = np.unique(np.stack([owner, unit]), axis=1, return_inverse=True, return_counts=True)
                alone = often[which.ravel()] == 1
                mine = ids[first + owner]
                context = [texts[k][a:b] for k, a, b in zip(owner.tolist(), (begin - starts[owner]).tolist(), (end - starts[owner]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(mine, mask=alone), pa.array(mine), pa.array((begin - starts[owner]).astype(np.int32)), pa.array(context, pa.string())], schema=TERRITORY)

    return run


def window_groups(contexts: list[str], min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of each window, its place there, its group): windows of one group are equal character by character."""
    cps, starts = flat(contexts)
    counts = np.diff(starts) - min_len + 1
    which = np.repeat(np.arange(len(contexts)), counts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[which] + place
    hashed = Rolling(cps).at(at, min_len)
    order = np.argsort(hashed, kind="stable")
    new = np.diff(hashed[order], prepend=hashed[order][:1]) != 0
    first_of = np.empty(len(order), np.int64)
    first_of[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    # A window whose neighbour before it is compared with the neighbour before its own match differs by the last character at most.
    follows = np.zeros(len(at), bool)
    if len(at):
        follows[1:] = (at[1:] == at[:-1] + 1) & (at[first_of[1:]] == at[first_of[:-1]] + 1) & (first_of[1:] != np.arange(1, len(at)))
    equal = cps[at + min_len - 1] == cps[at[first_of] + min_len - 1]
    heads = np.flatnonzero(~follows & (first_of != np.arange(len(at))))
    reach = np.arange(min_len)
    for k in range(0, len(heads), 4096):
        some = heads[k : k + 4096]
        equal[some] = (cps[at[some, None] + reach] == cps[at[first_of[some], None] + reach]).all(axis=1)
    group = first_of.copy()
    if not equal.all():  # equal hashes of different texts: those windows, and all behind them in their rows, are grouped by their text
        rows = np.flatnonzero(np.isin(first_of, first_of[~equal]) | np.isin(which, which[~equal]))
        told: dict[str, int] = {}
        for r in np.flatnonzero(np.isin(first_of, first_of[rows])).tolist():
            group[r] = told.setdefault(contexts[which[r]][place[r] : place[r] + min_len], r)
    return which, place, group


RUNS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("debut", pa.int32()), ("dernier", pa.int32()), ("n", pa.int64()), ("ensemble", pa.int64()), ("least", pa.int64())])
RUNS_DDL = "k1 long, k2 long, debut int, dernier int, n long, ensemble long, least long"


def _runs(rows: dict[str, np.ndarray], contexts: list[str], min_len: int) -> pa.RecordBatch:
    """Runs of windows of each class that stand in two texts or more, for whole groups of classes."""
    which, place, group = window_groups(contexts, min_len)
    unit_of = np.where(rows["alone"], np.arange(len(contexts)), -1 - rows["rank"])  # an own text counts once
    pairs, at = np.unique(np.stack([group, unit_of[which]]), axis=1, return_index=True)
    begins = np.flatnonzero(np.diff(pairs[0], prepend=-1))
    member = which[at]
    stats = [np.zeros(len(group), np.int64) for _ in range(3)]
    if len(begins):
        head = pairs[0][begins]
        stats[0][head] = np.add.reduceat(np.where(rows["alone"], rows["n"], 1)[member], begins)
        stats[1][head] = np.bitwise_xor.reduceat(rows["ensemble"][member], begins)
        stats[2][head] = np.minimum.reduceat(rows["least"][member], begins)
    n, ensemble, least = (s[group] for s in stats)
    kept = np.flatnonzero(n > 1)
    which, place, n, ensemble, least = (x[kept] for x in (which, place, n, ensemble, least))
    new = np.ones(len(which), bool)
    if len(which):
        new[1:] = (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1) | (n[1:] != n[:-1]) | (ensemble[1:] != ensemble[:-1]) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(which)) - 1 if len(first) else first
    w = which[first]
    out = (rows["k1"][w], rows["k2"][w], place[first].astype(np.int32), place[last].astype(np.int32), n[first], ensemble[first], least[first])
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, RUNS, strict=True)], schema=RUNS)


def _meet(min_len: int):
    """Rows come sorted by ``unit``; groups of classes are held until some megabytes of them are whole."""

    def settle(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        own = table.column("own")
        rows = {c: table.column(c).to_numpy() for c in ("unit", "k1", "k2", "n", "ensemble", "least")}
        rows["alone"] = own.is_null().to_numpy()
        # the same id in two groups of classes isn't the same member
        told = np.stack([rows["unit"], own.fill_null(0).to_numpy()])
        rows["rank"] = np.unique(told, axis=1, return_inverse=True)[1].ravel()
        return _runs(rows, table.column("context").to_pylist(), min_len)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < 1 << 22:
                continue
            unit = batch.column(0).to_numpy()
            tail = int(np.searchsorted(unit == unit[-1], True))
            if tail == 0 and all(b.column(0)[0].as_py() == unit[-1] for b in held):
                continue
            if tail:
                yield settle([*held[:-1], batch.slice(0, tail)])
                held = [batch.slice(tail)]
            else:  # the last group began in a batch before
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                keys = whole.column(0).to_numpy()
                tail = int(np.searchsorted(keys == keys[-1], True))
                yield settle([whole.slice(0, tail)])
                held = [whole.slice(tail)]
            size = sum(b.nbytes for b in held)
        if held:
            yield settle(held)

    return run


def _leaves(min_len: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts = column(batch, "context")
            for first, texts in slices(contexts, SLICE):
                cps, starts = flat(texts)
                counts = np.diff(starts) - min_len + 1
                which = np.repeat(np.arange(len(texts)), counts)
                place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                h1, h2 = (Rolling(cps, r).at(starts[which] + place, min_len).view(np.int64) for r in (0, 1))
                kept = batch.take(pa.array(first + which))
                names = ["k1", "k2", "own", "n", "ensemble", "least"]
                yield pa.RecordBatch.from_arrays([*(kept.column(kept.schema.get_field_index(c)) for c in names), pa.array(place.astype(np.int32)), pa.array(h1), pa.array(h2)], names=[*names, "p", "h1", "h2"])

    return run


def _spread(classes: DataFrame, min_len: int) -> DataFrame:
    """The runs of classes of hot anchors, whose windows are told apart by 128-bit hashes and counted where they fall."""
    ddl = "k1 long, k2 long, own long, n long, ensemble long, least long, p int, h1 long, h2 long"
    windows = worktable(classes.mapInArrow(_leaves(min_len), ddl), "p10-leaves")
    member = F.when(F.col("own").isNull(), F.struct("k1", "k2")).otherwise(F.struct(F.lit(None).cast("long").alias("k1"), F.col("own").alias("k2")))
    once = windows.groupBy("h1", "h2", member.alias("member"), F.col("own").isNotNull().alias("is_own")).agg(F.max("n").alias("n"), F.max("ensemble").alias("ensemble"), F.min("least").alias("least"))
    groups = once.groupBy("h1", "h2").agg(F.sum(F.when(F.col("is_own"), 1).otherwise(F.col("n"))).alias("n"), F.bit_xor("ensemble").alias("ensemble"), F.min("least").alias("least")).where("n > 1")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = windows.select("k1", "k2", "p", "h1", "h2", F.pmod("k2", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["h1", "h2", "salt"])
    order = Window.partitionBy("k1", "k2").orderBy("p")
    stats = F.struct("n", "ensemble", "least")
    new = ((F.lag("p").over(order) == F.col("p") - 1) & F.lag(stats).over(order).eqNullSafe(stats)).eqNullSafe(F.lit(True))
    runs = rows.withColumn("new", (~new).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("k1", "k2", "run").agg(F.min("p").alias("debut"), F.max("p").alias("dernier"), F.first("n").alias("n"), F.first("ensemble").alias("ensemble"), F.first("least").alias("least")).drop("run")


def shared_runs(df: DataFrame, id_col: str, text_col: str, min_len: int = 250, hot: int = HOT, hot_members: int = HOT_MEMBERS) -> DataFrame:
    """(id, debut, dernier, n, ensemble, least): in text ``id``, the windows of ``min_len`` characters that begin at the 0-based
    places ``debut`` to ``dernier`` each stand in the same ``n`` texts, at least two. The set of texts is named by
    (n, ensemble, least): its size, the exclusive or of the hashes of its ids, and its smallest id.

    Null, empty and shorter texts have none. Ids are unique. Texts are taken whole; a window that comes twice in one text
    counts once for the set, but both places are told. Other columns are not read.
    """
    if min_len < 64:
        raise ValueError("min_len must be 64 or more")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= min_len)
    anchors = worktable(texts.mapInArrow(_anchor_rows(min_len), "unit long, id long, place int"), "p10-anchors")
    units = anchors.groupBy("unit").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("unit")
    places = worktable(anchors.join(units, "unit", "left_semi").groupBy("id").agg(F.collect_list("place").alias("places")), "p10-places")
    size = places.agg(F.sum(F.size("places")).alias("n")).first().n or 0
    held = texts.join(F.broadcast(places) if size <= SENT_ANCHORS else places.hint("merge"), "id")
    found = held.mapInArrow(_territories(min_len), "unit long, own long, id long, place int, context string")
    found = worktable(found.withColumn("k1", F.xxhash64("unit", "own", "context")).withColumn("k2", F.xxhash64("context", "unit", F.lit(1), "own")), "p10-territories")
    hashed = F.xxhash64("id")
    classes = found.groupBy("unit", "own", "context", "k1", "k2").agg(
        F.count("*").alias("n"), F.when(F.col("own").isNull(), F.bit_xor(hashed)).otherwise(F.max(hashed)).alias("ensemble"), F.min("id").alias("least"))
    classes = worktable(classes.select("unit", "own", "k1", "k2", "n", "ensemble", "least", "context"), "p10-classes")
    many = worktable(classes.groupBy("unit").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("unit"), "p10-hot")
    any_hot = not many.isEmpty()
    cold = classes.join(many, "unit", "left_anti").select(classes.columns) if any_hot else classes
    runs = cold.repartition("unit").sortWithinPartitions("unit").mapInArrow(_meet(min_len), RUNS_DDL)
    if any_hot:
        runs = runs.unionByName(_spread(classes.join(many, "unit", "left_semi"), min_len))
    members = found.select("k1", "k2", "id", "place")
    large = worktable(classes.where(F.col("n") > hot_members).select("k1", "k2"), "p10-large")
    keys = ["k1", "k2"]
    if large.isEmpty():
        told = members.join(runs, keys)
    else:  # a class that many texts hold is spread over several tasks
        runs = worktable(runs, "p10-class-runs")
        salted = runs.join(large, keys, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot_members = members.join(large, keys, "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        told = members.join(large, keys, "left_anti").join(runs, keys).unionByName(hot_members.join(salted, [*keys, "salt"]).drop("salt"))
    return worktable(told.select("id", (F.col("place") + F.col("debut")).alias("debut"), (F.col("place") + F.col("dernier")).alias("dernier"), "n", "ensemble", "least"), "p10-runs")


SET = ["n", "ensemble", "least"]


def shared_spans(runs: DataFrame, min_len: int = 250) -> DataFrame:
    """(doc_id, debut, fin, n_textes): the maximal spans of each text all of whose windows stand in the same ``n_textes`` texts;
    0-based, ``fin`` is excluded. A span that stands in more texts inside a longer one is told by itself."""
    order = Window.partitionBy("id").orderBy("debut")
    before = F.lag(F.struct("dernier", *SET)).over(order)
    same = (before["dernier"] == F.col("debut") - 1) & (before["n"] == F.col("n")) & (before["ensemble"] == F.col("ensemble")) & (before["least"] == F.col("least"))
    marked = runs.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(F.col("id").alias("doc_id"), "span").agg(F.min("debut").alias("debut"), (F.max("dernier") + min_len).alias("fin"), F.first("n").alias("n_textes")).drop("span")


def sharing_sets(runs: DataFrame) -> DataFrame:
    """(groupe, doc_id, n_textes): the different sets of texts that share a window, one row per member. The compact form of
    the pairs: texts of one set share a span of ``min_len``, and texts without a set in common share none."""
    name = F.concat_ws("-", *SET).alias("groupe")
    return runs.select(name, F.col("id").alias("doc_id"), F.col("n").alias("n_textes")).distinct()


def sharing_pairs(runs: DataFrame, hot: int = 2000, salts: int = 32) -> DataFrame:
    """(doc_id_a, doc_id_b): the pairs of texts that share a window, each once.

    Every set of texts is expanded once, however many windows it shares. Sets of more than ``hot`` texts are salted over
    ``salts`` tasks. The number of rows is the number of pairs; :func:`sharing_sets` says the same in one row per member.
    """
    rows = worktable(runs.select(*SET, "id").distinct(), "p10-sets")
    own = F.when(F.col("n") > hot, F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0))
    every = F.when(F.col("n") > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = rows.select(*SET, own.cast("int").alias("salt"), F.col("id").alias("doc_id_a"))
    b = rows.select(*SET, F.explode(every).alias("salt"), F.col("id").alias("doc_id_b"))
    return a.join(b, [*SET, "salt"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def shared_part(runs: DataFrame, df: DataFrame, id_col: str, text_col: str, min_len: int = 250) -> DataFrame:
    """(doc_id, n_caracteres, n_partages, part_partagee) of every text: how many of its characters lie in a
    shared span. Null texts have null length and share nothing; an empty text's part is 0."""
    order = Window.partitionBy("id").orderBy("debut")
    covered = (
        runs.withColumn("next", F.lead("debut").over(order))
        .withColumn("own", F.col("dernier") - F.col("debut") + F.least(F.lit(min_len), F.coalesce(F.col("next") - F.col("dernier"), F.lit(min_len))))
        .groupBy("id").agg(F.sum("own").alias("n_partages"))
    )
    n = F.length(text_col)
    return (
        df.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n_caracteres"))
        .join(covered.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .withColumn("n_partages", F.coalesce("n_partages", F.lit(0)))
        .withColumn("part_partagee", F.when(F.col("n_caracteres") > 0, F.col("n_partages") / F.col("n_caracteres")).otherwise(F.lit(0.0)))
    )
