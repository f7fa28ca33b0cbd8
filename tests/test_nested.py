from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papyrine.operators import nested

DDL = "id long, s struct<a:string, l:array<struct<x:int, rang:string, inner:array<struct<y:int>>, p:struct<q:int>>>>, tags array<string>, dewey string"


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (1, ("t", [(1, "r", [(5,), None, (6,)], (9,)), None, (2, None, None, None)]), ["u", None], "c"),
        (2, None, None, None), (3, (None, []), [], "d"), (None, (None, [(7, None, [], None)]), None, None),
    ]
    return spark.createDataFrame(rows, DDL)


def test_every_node_once(df):
    got = {(r.id, r.chemin, tuple(r.dewey), tuple(r.parent), r.rang) for r in nested.nodes(df, "id").collect()}
    assert got == {
        (1, "s.l", (1, 2, 0), (), 0), (1, "s.l", (1, 2, 2), (), 2), (1, "s.l.inner", (1, 2, 0, 3, 0), (1, 2, 0), 0), (1, "s.l.inner", (1, 2, 0, 3, 2), (1, 2, 0), 2),
        (1, "tags", (2, 0), (), 0), (None, "s.l", (1, 2, 0), (), 0),
    }


def test_parents_exist(df):
    got = nested.nodes(df, "id").collect()
    labels = {(r.id, tuple(r.dewey)) for r in got}
    assert all((r.id, tuple(r.parent)) in labels for r in got if r.parent)


def test_flat_table_with_clashing_names(df):
    t = nested.flat_table(df, "id", "s.l")
    assert t.columns == ["id", "dewey", "parent", "rang", "x", "rang_", "p_q"]
    assert {(r.id, r.rang, r.x, r["rang_"], r.p_q) for r in t.collect()} == {(1, 0, 1, "r", 9), (1, 2, 2, None, None), (None, 0, 7, None, None)}
    assert {(r.id, r.rang, r.valeur) for r in nested.flat_table(df, "id", "tags").collect()} == {(1, 0, "u")}
    assert set(nested.flat_tables(df, "id")) == {"", "s.l", "s.l.inner", "tags"}


def test_record_table(df):
    t = nested.record_table(df.withColumn("s_a", F.lit(5)), "id")
    assert t.columns == ["id", "s_a", "dewey", "s_a_"] and {tuple(r) for r in t.collect()} == {(1, "t", "c", 5), (2, None, None, 5), (3, None, "d", 5), (None, None, None, 5)}


def test_maps_are_tables_of_entries(spark):
    ddl = "id long, s struct<m:map<string,array<struct<x:int>>>>, k map<string,double>"
    df = spark.createDataFrame([(1, ({"a": [(1,), None, (3,)], "b": None},), {"oui": 1.0, "non": None}), (2, None, {})], ddl)
    got = {(r.id, r.chemin, tuple(r.dewey), tuple(r.parent), r.rang) for r in nested.nodes(df, "id").collect()}
    assert got == {
        (1, "s.m", (1, 1, 0), (), 0), (1, "s.m", (1, 1, 1), (), 1), (1, "s.m.value", (1, 1, 0, 2, 0), (1, 1, 0), 0), (1, "s.m.value", (1, 1, 0, 2, 2), (1, 1, 0), 2),
        (1, "k", (2, 0), (), 0), (1, "k", (2, 1), (), 1),
    }
    assert {(r.id, r.rang, r.key, r.value) for r in nested.flat_table(df, "id", "k").collect()} == {(1, 0, "non", None), (1, 1, "oui", 1.0)}
    assert {(r.id, tuple(r.parent), r.rang, r.x) for r in nested.flat_table(df, "id", "s.m.value").collect()} == {(1, (1, 1, 0), 0, 1), (1, (1, 1, 0), 2, 3)}
    assert nested.record_table(df, "id").columns == ["id"]


def test_unknown_and_empty(df):
    with pytest.raises(ValueError):
        nested.nodes(df, "id", ["nope"])
    assert nested.nodes(df.limit(0), "id").count() == 0
    assert nested.nodes(df.select("id", "dewey"), "id").count() == 0
