from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from papyrine.operators import indicators as ind

ITEM = "array<struct<echele_5:string,echele_4:string,echele_3:string,echele_2:string,echele_1:string,nb_votants:int,pourcentage:double>>"


def item(level, votes, pct):
    return tuple(str(level) if level == k else None for k in (5, 4, 3, 2, 1)) + (votes, pct)


def text(spark, items, total):
    rows = spark.createDataFrame([(items, total)], f"d {ITEM}, total int")
    return rows.select(ind.willingness(F.col("d"), F.col("total")).alias("v")).first().v


def test_rebalance(spark):
    given = [(33.3, 33.3, 33.3), (50.0, 50.0, 0.0), (0.0, 0.0, 0.0), (49.5, 49.5, 1.0), (0.5, 0.5, 99.0)]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, a double, b double, c double")
    out = rows.select("i", ind.rebalance(F.col("a"), F.col("b"), F.col("c")).alias("t")).orderBy("i").collect()
    assert [tuple(r.t) for r in out] == [(34, 33, 33), (50, 50, 0), (100, 0, 0), (49, 50, 1), (0, 0, 100)]


def test_rebalanced_sum_is_100(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([tuple(r.uniform(0, 100) for _ in range(3)) for _ in range(500)], "a double, b double, c double")
    t = rows.select(ind.rebalance(F.col("a"), F.col("b"), F.col("c")).alias("t")).select(F.col("t.x") + F.col("t.y") + F.col("t.z"))
    assert {x[0] for x in t.collect()} == {100}


VOTES = [(5, 17, 73.0), (4, 1, 4.0), (3, 3, 13.0), (2, 1, 4.0), (1, 1, 4.0)]


@pytest.mark.parametrize(
    ("items", "total", "expected"),
    [
        ([item(*v) for v in VOTES], 23, "79 % favorables, 13 % neutre, 8 % non favorables"),
        ([item(k, n, None) for k, n, _ in VOTES], 23, "78 % favorables, 13 % neutre, 9 % non favorables"),
        (None, None, "100 % favorables, 0 % neutre, 0 % non favorables"),
        ([], 5, "100 % favorables, 0 % neutre, 0 % non favorables"),
        ([None, item(3, None, 100.0)], None, "0 % favorables, 100 % neutre, 0 % non favorables"),
        ([item(5, 1, 10.0), item(5, 1, 100.0)], 2, "100 % favorables, 0 % neutre, 0 % non favorables"),
    ],
)
def test_willingness(spark, items, total, expected):
    assert text(spark, items, total) == expected


def test_rows_and_arrays_agree(spark):
    r = random.Random(4)
    docs = []
    for d in range(60):
        items = [item(r.randint(1, 5), r.choice([None, r.randint(0, 9)]), r.choice([None, 0.0, float(r.randint(0, 60))])) for _ in range(r.randint(1, 7))]
        docs.append((d, items, r.randint(1, 30)))
    rows = spark.createDataFrame(docs, f"d int, items {ITEM}, total int")
    arrays = {x.d: x.v for x in rows.select("d", ind.willingness(F.col("items"), F.col("total")).alias("v")).collect()}
    long = rows.select("d", "total", F.posexplode("items").alias("pos", "i")).select("d", "total", "pos", F.coalesce(*(F.col(f"i.echele_{k}") for k in ind.LEVELS)).alias("niveau"), "i.nb_votants", "i.pourcentage")
    by_rows = {x.d: x.volonte for x in ind.willingness_by(long, ["d"], "niveau", "pourcentage", "nb_votants", "total", "pos").collect()}
    assert arrays == by_rows


SAT = "array<struct<label:string,count:double,percent:double>>"


@pytest.mark.parametrize(
    ("items", "expected"),
    [
        ([("Très satisfait(e)", 8.0, None), ("Satisfait(e)", 2.0, None), ("Déçu(e)", 0.0, None)], "100 %"),
        ([("Très satisfait(e)", 1.0, None), ("Sans opinion", 7.0, None)], "12 %"),
        ([("Très satisfait(e)", 0.0, 60.0), ("Satisfait(e)", None, 20.0), (None, None, 5.0)], "80 %"),
        ([], None), (None, None), ([None], None),
    ],
)
def test_satisfaction(spark, items, expected):
    assert spark.createDataFrame([(items,)], f"v {SAT}").select(ind.satisfaction(F.col("v")).alias("o")).first().o == expected


def test_mean_note(spark):
    kind = "array<struct<objectif_label:string,note_sur_10:double>>"
    rows = spark.createDataFrame([([("a", 7.0), ("b", None), ("c", 7.5)],), ([("a", None)],), ([],), (None,)], f"v {kind}")
    assert [r.o for r in rows.select(ind.mean_note(F.col("v")).alias("o")).collect()] == ["7.2/10", None, None, None]


def test_fill_percent(spark):
    rows = spark.createDataFrame([(None, 17, 23), (None, 1, 23), (5.0, 1, 23), (None, 1, 0), (None, None, 5)], "p double, n int, t int")
    assert [r.o for r in rows.select(ind.fill_percent(F.col("p"), F.col("n"), F.col("t")).alias("o")).collect()] == [73.9, 4.3, 5.0, None, None]
