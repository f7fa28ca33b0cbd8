"""Problem 9: a mix of sources with target shares, sizes in tokens of a public tokenizer.

Efraimidis-Spirakis sampling: every document gets the key -ln(u)/w, u a hash of its id and w its quality weight, and a
source is read in key order. A source first gives its complete epochs, then the head of its order up to the rest of its
budget. Prefix sums are taken over buckets of the key's logarithm, then over finer buckets inside the one the budget ends in, then
over the documents of the one finer bucket it ends in. On a logarithmic scale an exponential key has the same density for every
weight, at most 0.255 an octave, so a bucket of 1/64 octave holds 0.4 % of a source at most and a finer one 4096 times less,
whatever the weights are: no task holds a source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from importlib import import_module

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.textbuf import column
from papyrine.worktable import worktable

#: Buckets an octave of the key, and finer buckets in each.
BUCKETS, FINER = 64, 4096
#: Most targets whose plan is sent to all tasks; with more, plan and documents meet by a salted shuffle.
SENT_TARGETS = 100_000
SALTS = 16


def default_vocabulary() -> str:
    """Path of the rank file that is used unless another is given."""
    return import_module("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


#: Fixed value: the pattern that parts text before the merges of the rank files, as published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``df`` without ``text_col``, with ``n_tokens`` (0 for null and empty texts)."""
    path = vocabulary or default_vocabulary()
    kept = [c for c in df.columns if c != text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in column(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(counts, pa.int64())], names=[*kept, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema) + ", n_tokens long"
    return df.mapInArrow(run, schema)


def quality(text: Column) -> Column:
    """Weight in [0.05, 1]: texts of some length that are mostly words weigh more. Null weighs least."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce(0.05 + 0.95 * F.least(F.lit(1.0), n / 400) * F.when(n > 0, letters / n), F.lit(0.05))


def sampling_key(identity: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / w; a weight that is null or not positive counts as very small."""
    weight = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(1e-9))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), identity), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def with_buckets(df: DataFrame) -> DataFrame:
    """``df`` with ``bac`` and ``sous``, the bucket of its key ``cle`` and the finer bucket in it."""
    at = F.log2(F.greatest(F.col("cle"), F.lit(1e-300))) * BUCKETS
    return df.withColumn("bac", F.floor(at).cast("int")).withColumn("sous", F.floor((at - F.floor(at)) * FINER).cast("int"))


def _with_source(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    """Documents with the one row of their source. A source may hold most documents, so the row comes to them."""
    if per_source.count() <= SENT_TARGETS:
        return docs.join(F.broadcast(per_source), "source")
    salted = per_source.withColumn("sel", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("sel", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["source", "sel"]).drop("sel")


def _edge(docs: DataFrame, rest: DataFrame, bucket: str) -> DataFrame:
    """(source, reste, <bucket>_fin, avant): the bucket in which ``reste`` tokens are passed, and the tokens before it.
    ``rest`` has (source, reste, avant), where ``avant`` are the tokens before all documents given."""
    sums = docs.groupBy("source", bucket).agg(F.sum("n_tokens").alias("somme")).join(rest, "source")
    order = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("devant", F.col("avant") + F.coalesce(F.sum("somme").over(order), F.lit(0))).where("devant + somme > reste")
    first = sums.groupBy("source").agg(F.min_by(F.struct("reste", F.col(bucket).alias("b"), "devant"), bucket).alias("x"))
    return worktable(first.select("source", "x.reste", F.col("x.b").alias(f"{bucket}_fin"), F.col("x.devant").alias("avant")), "p9-edge")


def mix_sources(df: DataFrame, targets: DataFrame, id_col: str, source_col: str, text_col: str, total_tokens: int | None = None, weight: Column | None = None, vocabulary: str | None = None, seed: int = 1, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    ``chosen``: (doc_id, source, n_tokens, repetitions) of each document with at least one repetition.
    ``shares``: (source, part_cible, part_atteinte, n_tokens, n_documents, n_disponibles, epoques, n_vises) of each target; ``n_vises``
    are the tokens aimed at.

    ``targets`` has ``source``, ``part_cible``, ``repetitions_max``. By default the total is the largest at which every
    source that has tokens reaches its share; a target without documents gets 0 and the other shares keep their proportions.
    With ``total_tokens``, or with ``whole``, where the total is all tokens of the sources with a target, a source that runs
    out at ``repetitions_max`` stays below its share, which ``shares`` shows.
    Sources without a target, and null sources, give nothing. A text without tokens costs nothing and is used as
    often as its source's epochs. Equal keys are ordered by id. Without any tokens nothing is chosen.
    """
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"),
        (quality(F.col(text_col)) if weight is None else weight).alias("w"),
    ).where("doc_id is not null and source is not null")
    docs = docs.withColumn("cle", sampling_key(F.col("doc_id"), F.col("w"), seed)).drop("w")
    docs = worktable(with_buckets(token_counts(docs, "text", vocabulary)), "p9-docs")
    goals = targets.where("source is not null").groupBy("source").agg(F.max("part_cible").alias("part_cible"), F.max("repetitions_max").alias("repetitions_max"))
    has = docs.groupBy("source").agg(F.sum("n_tokens").alias("n_disponibles"))
    plan = goals.join(has, "source", "left").withColumn("n_disponibles", F.coalesce("n_disponibles", F.lit(0)))
    usable = F.when((F.col("n_disponibles") > 0) & (F.col("repetitions_max") > 0), F.col("part_cible")).otherwise(F.lit(0.0))
    head = plan.select(usable.alias("part"), (F.col("n_disponibles") * F.col("repetitions_max")).alias("most"), F.col("n_disponibles").alias("disponibles")).agg(
        F.sum("part").alias("part"), F.sum(F.when(F.col("part") > 0, F.col("disponibles"))).alias("disponibles"), F.min(F.when(F.col("part") > 0, F.col("most") / F.col("part"))).alias("total")).first()
    scale = float(head.part or 1.0)
    if total_tokens is None and whole:
        total_tokens = head.disponibles or 0
    total = float(total_tokens) if total_tokens is not None else float(head.total or 0.0) * scale
    budget = F.lit(total) * usable / F.lit(scale)
    plan = (
        plan.withColumn("budget", budget)
        .withColumn("epoques", F.when(F.col("n_disponibles") > 0, F.least(F.col("repetitions_max"), F.floor((F.col("budget") + 1e-6 * F.col("budget")) / F.col("n_disponibles")))).otherwise(F.lit(0)).cast("int"))
        .withColumn("reste", F.when(F.col("epoques") < F.col("repetitions_max"), F.greatest(F.lit(0.0), F.col("budget") - F.col("epoques") * F.col("n_disponibles"))).otherwise(F.lit(0.0)))
    )
    plan = worktable(plan, "p9-plan")
    rest = plan.where("reste > 0").select("source", "reste")
    edge = _edge(docs, rest.withColumn("avant", F.lit(0).cast("long")), "bac").withColumnRenamed("avant", "avant_bac")
    inner = _with_source(docs, edge).where("bac = bac_fin and avant_bac < reste")
    finer = _edge(inner.select(docs.columns), edge.select("source", "reste", F.col("avant_bac").alias("avant")), "sous")
    cuts = worktable(plan.select("source", "epoques").join(edge.drop("reste"), "source", "left").join(finer, "source", "left"), "p9-cuts")
    located = _with_source(docs.select("doc_id", "source", "n_tokens", "cle", "bac", "sous"), cuts)
    last = (F.col("bac") == F.col("bac_fin")) & (F.col("sous") == F.col("sous_fin")) & (F.col("avant") < F.col("reste"))
    before = (F.col("bac") < F.col("bac_fin")) | (F.col("bac") == F.col("bac_fin")) & (F.col("sous") < F.col("sous_fin"))
    inside = Window.partitionBy("source").orderBy("cle", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    told = ["doc_id", "source", "n_tokens", "epoques"]
    ahead = located.where(~F.coalesce(last, F.lit(False))).select(*told, F.coalesce(before, F.lit(False)).cast("int").alias("extra"))
    at_edge = located.where(last).withColumn("devant", F.col("avant") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    at_edge = at_edge.select(*told, (F.col("devant") + F.col("n_tokens") / 2 <= F.col("reste")).cast("int").alias("extra"))
    chosen = ahead.unionByName(at_edge).select("doc_id", "source", "n_tokens", (F.col("epoques") + F.col("extra")).alias("repetitions")).where("repetitions > 0")
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repetitions")).alias("n_tokens"), F.count("*").alias("n_documents"))
    shares = plan.join(reached, "source", "left").select("source", "part_cible", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "n_disponibles", "epoques", F.col("budget").alias("n_vises"))
    everything = Window.partitionBy()  # one row per target
    shares = shares.withColumn("part_atteinte", F.coalesce(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(everything), F.lit(0)), F.lit(0.0)))
    return chosen, shares
