from __future__ import annotations

import json

from pyspark.sql import functions as F

from papyrine.functions.scalar import fold
from papyrine.operators import extraction as ex
from papyrine.operators import records

REPORT = """SOMMAIRE
EVALUATION A CHAUD
p. 2
ÉVALUATION PRÉ-FORMATION
Souhaitez-vous suivre cette formation ?
5 .......... 17  73 %
4 .......... 1   4 %
3 .......... 3   13 %
2 .......... 1   4 %
1 .......... 1   5 %
23 votants
Quels sont les sujets que vous aimeriez aborder ?
- Les gestes
du matin
- Le tri
Evaluation a cliaud
Formation profitable ?
Oui 90 %
Non : 10 %
Satisfaction du contenu ?
Très satisfait-e  8
Satisfait(e) 2
Note /10
Moyenne : 8,5 / 10
Points forts
Le rythme
EVALUATION A FROID
Note sur 10
7 / 10
RÉSULTATS DES ÉVALUATIONS
Progression des competences
+ 1,25 / 10
"""


def test_record_from_text(spark):
    df = spark.createDataFrame([(1, REPORT, "A"), (2, None, "B"), (3, "", "C"), (4, "rien de connu", "D")], "r int, t string, n string").withColumns({"bloc": F.lit("clash"), "pos": F.lit(0)})
    out = ex.records_from_text(df, "r", "t", F.col("n"), F.lit("S1 2025"), F.lit("x"))
    rows = out.withColumn("e", records.payload_errors(F.col("json"))).collect()
    assert [r.r for r in rows] == [1] and rows[0].e == []
    doc = json.loads(rows[0].json)
    pre, hot = doc["pre_formation"], doc["a_chaud"]
    assert pre["volonte_suivi_formation"] == {"nb votants": 23} and pre["souhaitez_vous_suivre_distribution"][0] == {"echele 5": "5", "nb_votants": 17, "pourcentage": 73.0}
    assert pre["demande_sujets_a_aborder"] == ["Les gestes du matin", "Le tri"] and "meta_extraction" not in doc
    assert hot["formation_profitable"] == {"oui_percent": 90.0, "non_percent": 10.0} and hot["note_globale_a_chaud"] == 8.5 and hot["points_forts"] == ["Le rythme"]
    assert [(x["label"], x["count"]) for x in hot["satisfaction_contenu"]] == [("Très satisfait(e)", 8.0), ("Satisfait(e)", 2.0)]
    assert doc["a_froid"] == {"note_sur_10": 7.0} and doc["resultats_evaluations"] == {"progression_competences_plus_sur_10": 1.25}


def test_unreadable_chart_is_told(spark):
    df = spark.createDataFrame([(1, REPORT.replace("23 votants", "24 votants"))], "r int, t string")
    doc = json.loads(ex.records_from_text(df, "r", "t", F.lit("A"), F.lit("S"), F.lit("x")).first().json)
    assert doc["meta_extraction"] == {"graphique_non_lisible": True}


def test_near_titles(spark):
    texts = ["ÉVALUATION À CHAUD :", "evaluation a chuad", "evaluation a chaud du groupe", "note /10", "note /11", "", None, "EVALUATION PRE FORMATION"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.k for r in df.select(ex.near(fold(F.col("t")), [*ex.TITLES, "note /10"]).alias("k")).collect()]
    assert got == ["evaluation a chaud", "evaluation a chaud", None, "note /10", None, None, None, "evaluation pre-formation"]


def test_four_levels(spark):
    df = spark.createDataFrame([("Totalement : 12 En partie 3,5 % Pas du tout .... 0",), ("rien",), (None,)], "t string")
    assert [tuple(r.v) for r in df.select(ex.four_levels(F.col("t")).alias("v")).collect()] == [(12.0, 3.5, None, 0.0), (None,) * 4, (None,) * 4]
