from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.operators import records
from papyrine.operators.dedup import latest_by_key

LEGACY = {
    "Nom formation": "A", " semestre": "S1 2025", "lien_vers_formation": "x",
    "pre_formation": {"souhaitez_vous_suivre": {"votants": 23}, "souhaitez_vous_suivre_distribution": [
        {"label": "5", "count": 1, "percent": "1 %"}, {"label": "5", "count": 17, "percent": "73,9 %"}, {"label": 4, "count": 1, "percent": None}],
        "sujets_a_aborder": [], "demande_sujets_a_aborder": ["s"], "maitrise_objectifs": {"mode": "notes_sur_10", "note_globale_objectifs_sur_10": 0, "par_objectif": [{"objectif_label": "o", "note_sur_10": 5}]}},
    "a_chaud": {"impression_globale_note_sur_10": 0, "note_globale_a_chaud": 8.5, "points_forts": ["p"]},
}


def test_legacy_layout(spark):
    current = {"Nom formation": "B", "version_prompt": "v9", "pre_formation": {"volonte_suivi_formation": None}}
    rows = spark.createDataFrame([(1, json.dumps(LEGACY)), (2, json.dumps(current)), (3, None), (4, "no json")], "id int, raw string")
    out = {r.id: r for r in records.legacy_to_current(rows, "raw").collect()}
    v2 = json.loads(out[1].v2)
    assert not out[1].etait_v2 and v2["version_prompt"] == "v2.1" and v2["Nom formation"] == "A" and v2[" semestre"] == "S1 2025"
    pre = v2["pre_formation"]
    assert pre["volonte_suivi_formation"] == {"nb votants": 23}
    scale = pre["souhaitez_vous_suivre_distribution"]
    assert [next(k for k in d if k != "pourcentage") for d in scale] == [f"echele {k}" for k in "54321"]
    assert scale[0] == {"echele 5": "17 votants", "pourcentage": 73.9} and scale[1]["pourcentage"] == 4.3 and scale[1]["echele 4"] == "1 votants" and scale[2]["echele 3"] is None
    assert pre["demande_sujets_a_aborder"] == ["s"] and v2["a_chaud"]["note_globale_a_chaud"] == 8.5
    assert out[4].v2 is None
    assert out[2].etait_v2 and json.loads(out[2].v2)["version_prompt"] == "v2.1" and out[3].v2 is None


def mapped(spark, *docs):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, raw string")
    out = records.legacy_to_current(rows, "raw").select("id", "v2", records.payload_errors(F.col("v2")).alias("e"), records.payload_json(F.col("v2")).alias("j"))
    return [(json.loads(r.v2), r.e, json.loads(r.j)) for r in out.orderBy("id").collect()]


def test_golden_legacy_documents(spark):
    def legacy(counts, percents, total=23, label="Satisfait-e"):
        items = [{"label": k, "count": c, "percent": p} for k, c, p in zip("54321", counts, percents, strict=False)]
        return {"Nom formation": "A", " semestre": "S1 2025", "lien_vers_formation": "x", "pre_formation": {"souhaitez_vous_suivre": {"voters_total": total}, "souhaitez_vous_suivre_distribution": items}, "a_chaud": {"satisfaction_contenu": [{"label": label, "count": 3}]}}

    votes, shares = [17, 1, 3, 1, 1], [73, 4, 13, 4, 4]
    g5, g6, g7, two, odd, text = mapped(spark, legacy(votes, shares), legacy(votes[:4], shares), legacy(votes, [None] * 5), legacy([4, 6], [None, None], 10), legacy(votes, shares, label="Satisfait -e"), legacy(votes, [None] * 5, "23"))
    share = lambda doc: [d["pourcentage"] for d in doc[0]["pre_formation"]["souhaitez_vous_suivre_distribution"]]
    assert g5[1] == [] and share(g5) == shares and g5[0]["version_prompt"] == "v2.1" and "nb_votants" not in g5[0]["pre_formation"]["souhaitez_vous_suivre_distribution"][0]
    assert g6[1] == ["$.pre_formation.souhaitez_vous_suivre_distribution[]: exactement un"]
    assert share(g7) == [73.9, 4.3, 13.0, 4.3, 4.3] == share(text) and g7[1] == [] and share(two)[:2] == [40.0, 60.0]
    assert g5[0]["a_chaud"]["satisfaction_contenu"] == [{"label": "Satisfait(e)", "count": 3}] and odd[1] == ["$.a_chaud.satisfaction_contenu[].label: domaine"]
    assert g7[2]["pre_formation"]["volonte_suivi_formation"] == {"nb votants": 23} and g7[2]["pre_formation"]["souhaitez_vous_suivre_distribution"][0] == {"echele 5": "17 votants", "pourcentage": 73.9}


def test_current_records_are_repaired_too(spark):
    doc = {"Nom formation": "B", "pre_formation": {"autre": [1], "volonte_suivi_formation": {"nb_votants": "8"}, "souhaitez_vous_suivre_distribution": [{"echele 5": "2 votants"}, {"echele 4": "4", "pourcentage": None}, {"echele 3": "1 votant", "pourcentage": 3.5}, "x", None]},
           "a_chaud": {"points_forts": ["p"], "satisfaction_contenu": [{"label": "Déçu-e", "percent": 5.0}, {"label": "Ravi"}, 7, None]}}
    (v2, _, _), (plain, _, _), (odd, _, _) = mapped(spark, doc, {"pre_formation": {"volonte_suivi_formation": None}, "k": {"b": 1, "a": [2]}}, {"pre_formation": {"volonte_suivi_formation": 3, "souhaitez_vous_suivre_distribution": {"a": 1}}, "a_chaud": {"satisfaction_contenu": "x"}})
    assert v2["pre_formation"]["souhaitez_vous_suivre_distribution"] == [{"echele 5": "2 votants", "pourcentage": 25.0}, {"echele 4": "4", "pourcentage": None}, {"echele 3": "1 votant", "pourcentage": 3.5}, "x", None]
    assert v2["a_chaud"] == {"points_forts": ["p"], "satisfaction_contenu": [{"label": "Déçu(e)", "percent": 5.0}, {"label": "Ravi"}, 7, None]} and v2["pre_formation"]["autre"] == [1] and v2["version_prompt"] == "v2.1"
    assert plain["k"] == {"b": 1, "a": [2]} and odd["a_chaud"] == {"satisfaction_contenu": "x"}


def test_identity_dump_and_hash(spark):
    raw = json.dumps({" semestre": "S2", "Nom formation": "extrait", "a_froid": {"note_sur_10": "8,5", "inconnu": 1}, "a_chaud": None, "intervenants": {"retards_apprenants": {"oui": None}}})
    df = spark.createDataFrame([(raw, 'Nom "cité"')], "raw string, nom string")
    forced = records.with_identity(F.col("raw"), F.col("nom"), F.lit("S1 2025"), F.lit(None).cast("string"))
    r = df.select(forced.alias("f"), records.payload_json(forced, commas=True).alias("j"), records.payload_json(forced, nulls=True).alias("n"), records.payload_value(forced, commas=True).alias("v"), records.payload_errors(forced, commas=True).alias("e")).first()
    assert json.loads(r.f)["Nom formation"] == 'Nom "cité"' and json.loads(r.f)["lien_vers_formation"] is None and r.e == ["$.lien_vers_formation: absent"]
    assert json.loads(r.j) == {"Nom formation": 'Nom "cité"', " semestre": "S1 2025", "a_froid": {"note_sur_10": 8.5}, "intervenants": {"retards_apprenants": {"oui": None}}}
    assert r.v["a_froid"]["note_sur_10"] == 8.5 and r.v["Nom formation"] == 'Nom "cité"' and r.v["a_chaud"] is None
    assert json.loads(r.n)["a_froid"]["note_sur_10"] is None and json.loads(r.n)["a_chaud"] is None
    pairs = spark.createDataFrame([('{"b": 1, "a": [1, {"y": 2, "x": 3}]}',), ('{"a":[1,{"x":3,"y":2}],"b":1}',), ('{"a":[1,{"x":3,"y":2}],"b":2}',), ("no",), (None,), ("{}",)], "raw string")
    h = [x.h for x in pairs.select(records.record_hash(F.col("raw")).alias("h")).collect()]
    assert h[0] == h[1] != h[2] and h[3] is None and h[4] is None
    assert [x.h for x in pairs.select(records.holds_something(F.col("raw")).alias("h")).collect()] == [True, True, True, False, False, False]


FIELDS = {"$.n": (T.LongType(), True, None), "$.d": (T.DoubleType(), False, None), "$.s": (T.StringType(), False, ("x", "y")), "$.b": (T.BooleanType(), False, None)}


@pytest.mark.parametrize(
    ("raw", "values", "errors"),
    [
        ('{"n": 17.0, "d": "8.5", "s": "x", "b": true}', (17, 8.5, "x", True), []),
        ('{"n": " 17 "}', (17, None, None, None), []),
        ('{"n": true, "d": true}', (1, 1.0, None, None), []),
        ('{"n": 17.5}', (None, None, None, None), ["$.n: type"]),
        ('{"n": ""}', (None, None, None, None), ["$.n: type"]),
        ('{"n": null}', (None, None, None, None), ["$.n: absent"]),
        ('{"n": 1, "d": "8,5"}', (1, None, None, None), ["$.d: type"]),
        ('{"n": 1, "s": 5}', (1, None, None, None), ["$.s: type"]),
        ('{"n": 1, "s": "z"}', (1, None, "z", None), ["$.s: domaine"]),
        ('[1]', (None, None, None, None), ["json"]), ("oops", (None, None, None, None), ["json"]), (None, (None, None, None, None), ["json"]),
    ],
)
def test_validate(spark, raw, values, errors):
    r = records.validate(spark.createDataFrame([(raw,)], "raw string"), "raw", FIELDS).first()
    assert ((r.n, r.d, r.s, r.b), r.erreurs) == (values, errors)


GOOD = {"Nom formation": "A", " semestre": "S1 2025", "lien_vers_formation": "x", "inconnu": {"a": 1}}


@pytest.mark.parametrize(
    ("more", "errors"),
    [
        ({}, []), ({"a_chaud": None, "intervenants": {"retards_apprenants": {"oui": 1, "non": None}}}, []),
        ({"Nom formation": None}, ["$.Nom formation: absent"]), ({"a_froid": [1]}, ["$.a_froid: type"]),
        ({"a_chaud": {"satisfaction_contenu": [{"label": "Satisfait(e)", "count": "3"}, {"label": "Ravi", "count": "x"}, {}]}}, ["$.a_chaud.satisfaction_contenu[].label: domaine", "$.a_chaud.satisfaction_contenu[].count: type", "$.a_chaud.satisfaction_contenu[].label: absent"]),
        ({"a_chaud": {"points_forts": ["a", None, 3]}}, ["$.a_chaud.points_forts[]: absent", "$.a_chaud.points_forts[]: type"]),
        ({"a_froid": {"maitrise_objectifs_a_froid": {"mode": "5_niveaux", "par_objectif": [{"objectif_label": "o", "levels": {"totalement": "y"}}]}}}, ["$.a_froid.maitrise_objectifs_a_froid.mode: domaine", "$.a_froid.maitrise_objectifs_a_froid.par_objectif[].levels.totalement: type"]),
        ({"pre_formation": {"souhaitez_vous_suivre_distribution": [{"echele 5": "1 votants", "echele 4": None, "pourcentage": 3}, {"echele_3": "2"}]}}, []),
        ({"pre_formation": {"souhaitez_vous_suivre_distribution": [{"echele 5": "1", "echele 4": "2"}]}}, ["$.pre_formation.souhaitez_vous_suivre_distribution[]: exactement un"]),
        ({"pre_formation": {"souhaitez_vous_suivre_distribution": [{"echele 5": None}]}}, ["$.pre_formation.souhaitez_vous_suivre_distribution[]: exactement un"]),
        ({"intervenants": {"contenu_non_prevu": {"reponse": "peut-être"}, "retards_apprenants": {"oui": "z"}}}, ["$.intervenants.contenu_non_prevu.reponse: domaine", "$.intervenants.retards_apprenants.*: type"]),
    ],
)
def test_whole_payload(spark, more, errors):
    df = spark.createDataFrame([(json.dumps(GOOD | more),)], "raw string")
    assert sorted(df.select(records.payload_errors(F.col("raw")).alias("e")).first().e) == sorted(errors)


def test_payload_that_is_no_object(spark):
    df = spark.createDataFrame([("[1]",), ("oops",), (None,)], "raw string")
    assert [r.e for r in df.select(records.payload_errors(F.col("raw")).alias("e")).collect()] == [["json"]] * 3


def test_align_headers(spark):
    df = spark.createDataFrame([("a", None, ["x", "", "y"])], "n string, k int, l array<string>")
    heads = [" n", "zz", "k", "n", "l "]
    assert tuple(records.align_to_headers(df, heads).first()) == ("a", "", "", "a", "x • y")
    assert tuple(records.align_to_headers(df, heads, last_duplicate_only=True).first()) == ("", "", "", "a", "x • y")
    with pytest.raises(ValueError):
        records.align_to_headers(df, [])


def test_key_differences_and_ledger(spark):
    a, b = records.key_differences(F.array(F.lit("b"), F.lit("a"), F.lit("c")), F.array(F.lit("c"), F.lit("z")))
    assert tuple(spark.range(1).select(a, b).first()) == (["a", "b"], ["z"])
    df = spark.createDataFrame([("h1",), ("h2",), (None,)], "hash string")
    assert {r.hash for r in records.new_payloads(df, spark.createDataFrame([("h1",), ("h1",)], "hash string")).collect()} == {"h2", None}


def test_latest_by_key(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (2, None, "c"), (None, 1, "d"), (None, 2, "e")]
    df = spark.createDataFrame(rows, "k int, t int, __rank string")
    assert {tuple(r) for r in latest_by_key(df, ["k"], ["t"]).collect()} == {(1, 7, "b"), (2, None, "c"), (None, 2, "e")}
    assert latest_by_key(df.limit(0), ["k"], ["t"]).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("Satisfait-e",), ("autre",), (None,)], "l string")
    assert [r.o for r in df.select(records.canonical_label(F.col("l")).alias("o")).collect()] == ["Satisfait(e)", "autre", None]
