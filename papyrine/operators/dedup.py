"""Keyed deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the largest ``order`` values (nulls count as smallest).

    Rows with equal order values are told apart by a hash of the row, so the choice doesn't depend on the plan;
    rows equal in every column are one. Null keys form a key of their own. One shuffle on the key.
    """
    rank = "__rank"
    while rank in df.columns:
        rank += "_"
    window = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order), row_hash(df))
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash over all columns of ``df``; maps are hashed as sorted entries."""
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema))
