from __future__ import annotations

import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papyrine.operators import drift
from papyrine.plans.training_data import DECLARED
from papyrine.schema import PAYLOAD


def record(version=("version_prompt", "v2.1"), votes=("nb_votants", 4), late=("retards_apprenants", {"oui": 1, "non": 9})):
    doc = {"Nom formation": "A", "pre_formation": {"souhaitez_vous_suivre_distribution": [{"echele 5": "5", "pourcentage": 50}, {"echele 4": "4", "pourcentage": 3}], "volonte_suivi_formation": {"nb votants": 3}},
           "intervenants": {"commentaire_organisation_generale": "un mot"}}
    if version:
        doc[version[0]] = version[1]
    if votes:
        for d in doc["pre_formation"]["souhaitez_vous_suivre_distribution"]:
            d[votes[0]] = votes[1]
    if late:
        doc["intervenants"][late[0]] = late[1]
    return doc


def found(spark, files, flux="f"):
    rows = [(k, flux, r, json.dumps(d) if isinstance(d, dict) else d) for k, (r, d) in enumerate(files)]
    df = spark.createDataFrame(rows, "raw_id long, flux string, rang int, raw string")
    out = drift.follow_schemas(drift.file_facts(df, "flux", "rang", "raw"), PAYLOAD, DECLARED)
    return {(r.rang, r.champ, r.changement) for r in out.where("changement <> 'place'").collect()}


def test_changes(spark):
    files = [
        (1, record()), (1, "no json"), (1, None),
        (2, record(version=None, votes=("nb votants", "4"))),
        (4, record(version=("schema_version", 2.1), votes=("effectif", "7"), late=("retards", 3))),
        (5, record(version=("schema_version", None), votes=None, late=("retards", None))),
        (6, record(version=("versionPrompt", {"majeure": 2, "mineure": 0}), votes=("nb_votants", 1), late=("retards", [{"reponse": "oui", "nombre": 2}]))),
    ]
    assert found(spark, files) == {
        (2, "version_prompt", "retrait"), (2, "nb_votants", "renommage"), (2, "nb_votants", "type"),
        (4, "version_prompt", "ajout"), (4, "nb_votants", "renommage"), (4, "retards_apprenants", "renommage"), (4, "retards_apprenants", "type"),
        (5, "version_prompt", "retrait"), (5, "nb_votants", "retrait"), (5, "retards_apprenants", "retrait"),
        (6, "version_prompt", "ajout"), (6, "nb_votants", "ajout"), (6, "retards_apprenants", "ajout"),
    }


def test_a_new_key_is_no_renaming(spark):
    files = [(1, record()), (2, record(version=None) | {"outil_saisie": "tablette"})]
    assert found(spark, files) == {(2, "version_prompt", "retrait")}


def test_moved_field(spark):
    moved = record(version=None)
    moved["intervenants"]["version_prompt"] = "v2.1"
    assert found(spark, [(1, record()), (2, moved)]) == set()


def test_moved_and_renamed_field(spark):
    moved = record(version=None)
    moved["intervenants"]["numero_version"] = "v2.1"
    assert found(spark, [(1, record()), (2, moved)]) == {(2, "version_prompt", "renommage")}


def test_moved_into_a_new_section(spark):
    moved = record(late=None) | {"suivi": {"bilan": {"retards_apprenants": {"oui": 2, "non": 7}}}}
    assert found(spark, [(1, record()), (2, moved)]) == set()


def test_section_and_its_field_renamed_together(spark):
    doc = record()
    doc["formateurs"] = {"commentaire_organisation_generale": "un mot", "retards": {"oui": 1, "non": 9}}
    del doc["intervenants"]
    assert found(spark, [(1, record()), (2, doc)]) == {(2, "retards_apprenants", "renommage")}


def test_distance_counts_subtrees():
    def node(name, *children, kind="object"):
        n = drift.Node(name, types=Counter({kind: 1}), shapes=Counter({"o:" + ",".join(sorted(c.name for c in children)) if children else "s:a": 1}))
        n.children = {c.name: c for c in children}
        return n

    leaf = lambda x: node(x, kind="string")
    a = node("", node("xyz", leaf("un"), leaf("deux"), leaf("trois")), leaf("quatre"))
    b = node("", node("foo", leaf("un"), leaf("deux"), leaf("trois"), leaf("cinq")), node("bar", leaf("zwei")))
    matched, come = drift.edit_script(a, b)
    assert {(x.name, y.name) for x, y in matched} == {("xyz", "foo"), ("un", "un"), ("deux", "deux"), ("trois", "trois")} and {n.name for n in come} == {"bar", "cinq"}
    assert drift.distance(a, a, {}) == 0 and drift.distance(a, b, {}) == pytest.approx(2 + 1 + 1 + 2)


def test_shapes_are_of_the_whole_text():
    assert drift.shape("v2.1") == "s:a0.0" and drift.shape("17 votants") == "s:0 a" and drift.shape("Un mot, puis d'autres. " * 900 + "9") == "s:a+. 0"
    assert drift.shape({f"k{i:04}": 1 for i in range(200)}) != drift.shape({f"k{i:04}": 1 for i in range(199)})


def test_many_shapes_of_one_field_do_not_push_out_those_of_another(spark):
    many = [(1, "a", 1, json.dumps(record(version=("version_prompt", f"{k:b}".replace("0", "-").replace("1", ".")), votes=("nb_votants", "4_b")))) for k in range(700)]
    rows = [(k, *x) for k, (_, *x) in enumerate(many * 2)] + [(2000, "c", 1, json.dumps(record(late=("retards_apprenants", ["x", 1])))) ]
    rows += [(3000, "b", 1, json.dumps(record(late=("zzz", ["x", 1])))), (3001, "b", 2, json.dumps(record(late=("retards_apprenants", ["x", 1]))))]
    df = spark.createDataFrame(rows, "raw_id long, flux string, rang int, raw string")
    out = drift.follow_schemas(drift.file_facts(df, "flux", "rang", "raw"), PAYLOAD, DECLARED).where("changement <> 'place'")
    assert {(r.flux, r.rang, r.champ, r.changement) for r in out.collect()} == {("b", 2, "retards_apprenants", "renommage")}


def test_one_file_and_no_file(spark):
    assert found(spark, [(1, record())]) == set()
    assert found(spark, [(1, None), (2, "[]")]) == set()


def test_assignment_is_optimal():
    r = random.Random(6)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            cost = [[r.randint(0, 9) for _ in range(n)] for _ in range(n)]
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            got = drift.assign(cost)
            assert sorted(got) == list(range(n)) and sum(cost[i][got[i]] for i in range(n)) == best


def test_projection_reads_renamed_keys(spark):
    df = spark.createDataFrame([(json.dumps(record(votes=("nb votants", 7))),), (None,)], "raw string")
    s = drift.SEP
    got = df.select(drift.items_at(F.col("raw"), F.lit(f"{s}pre_formation{s}souhaitez_vous_suivre_distribution{s}[]"), F.lit("nb votants")).alias("v"), drift.value_at(F.col("raw"), F.lit(f"{s}intervenants"), F.lit("retards_apprenants")).alias("l")).collect()
    assert got[0].v == ["7", "7"] and json.loads(got[0].l) == {"oui": 1, "non": 9} and got[1].v is None


def test_projection_follows_the_whole_path(spark):
    doc = {"a": {"b": {"c": {"k": 5}, "l": [{"d": {"k": "x"}}, {"d": None}, {"d": {"k": {"m": 1}}}]}}, "l": [{"k": 1}, {"k": 2}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "raw string")
    path = lambda *steps: F.lit("".join(drift.SEP + s for s in steps))
    k = F.lit("k")
    got = df.select(
        drift.value_at(F.col("raw"), path("a", "b", "c"), k).alias("v"), drift.items_at(F.col("raw"), path("a", "b", "l", "[]", "d"), k).alias("i"),
        drift.items_at(F.col("raw"), path("l", "[]"), k).alias("j"), drift.items_at(F.col("raw"), path("a", "b", "c"), k).alias("none"),
    ).first()
    assert tuple(got) == ("5", ["x", None, '{"m":1}'], ["1", "2"], None)
