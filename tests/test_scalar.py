from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import lists, scalar as fx


def table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def each(spark, values, make, kind="string"):
    return [r.o for r in table(spark, values, kind).select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_lenient_numbers(spark):
    texts = ["8,5", " 73 % ", "1,234.5", None, "abc", "1_000", "7d", "", " 8,5 ", "1e3", ".5", "5."]
    assert each(spark, texts, fx.lenient_float) == [8.5, 73.0, None, None, None, 1000.0, None, None, 8.5, 1000.0, 0.5, 5.0]
    assert each(spark, [None, "abc", "2"], fx.lenient_number) == [0.0, 0.0, 2.0]
    assert math.isnan(each(spark, ["NaN"], fx.lenient_float)[0]) and each(spark, ["-inf"], fx.lenient_float) == [-math.inf]


def test_one_decimal_is_exact(spark):
    r = random.Random(1)
    values = [k / 100 for k in range(0, 1001)] + [r.uniform(0, 1e6) for _ in range(2000)] + [7.25, 7.35, 8.45, 0.35, 0.05, 1e15 + 0.25, 99.95, 9.95, -0.04, -7.25, 123456.75, 0.0]
    assert each(spark, values, fx.one_decimal, "double") == [f"{v:.1f}" for v in values]
    assert each(spark, [None, math.inf, -math.inf, math.nan], fx.one_decimal, "double") == [None, "inf", "-inf", "nan"]


def test_formats(spark):
    assert each(spark, [7.25, 7.35, None], fx.note, "double") == ["7.2/10", "7.3/10", None]
    assert each(spark, [2.5, 3.5, 0.5, None], fx.percent_text, "double") == ["2 %", "4 %", "0 %", None]
    assert each(spark, [1.25, 1.2, 1.0, 1.005, 1.015, -0.5, 100.0, None], fx.impact, "double") == ["+1.25/10", "+1.2/10", "+1/10", "+1/10", "+1.02/10", "+-0.5/10", "+100/10", None]
    assert each(spark, [16.5, None], fx.votes_text, "double") == ["16 votants", None]
    assert each(spark, ["17 votants", "1 votant", "5", None, "12 votants"], fx.votes_number) == [17, 1, None, None, 12]


def test_json_repair(spark):
    assert each(spark, ['x {"a":1} y', "no json", None, '{"a":1}', "} {", "{bad}"], fx.json_between_braces) == ['{"a":1}', None, None, '{"a":1}', None, None]


def test_commas(spark):
    assert each(spark, [" 7,5, bien "], fx.commas_to_points) == ["7.5. bien"]
    assert each(spark, [" 7,5, bien 1,2,3 "], fx.number_commas_to_points) == ["7.5, bien 1.2.3"]


def test_summaries(spark):
    texts = ['{"resume": " ", "summary": " v "}', ' "net" ', "a \n b", '{"autre":  1}', None, "", "['x']", '[1,  2]', "{bad  one}", '{"résumé": 5, "text": "ok"}']
    assert each(spark, texts, fx.unwrap_summary) == ["v", "net", "a b", '{"autre": 1}', "", "", "['x']", "[1, 2]", "{bad one}", "ok"]
    assert each(spark, [None, " x ", '{"output": "y"}', '{"z":1}', '["a", 2, {"k": 1}]'], fx.response_text) == ["", "x", "y", '{"z":1}', 'a 2 {"k":1}']


def test_cells(one):
    strings = T.ArrayType(T.StringType())
    assert one(lambda c: fx.cell(c, strings), v=F.array(F.lit("a"), F.lit(""), F.lit(None), F.lit(" "), F.lit("b"))) == "a • b"
    assert one(lambda c: fx.cell(c, T.StringType()), v=F.lit(None).cast("string")) == ""
    assert one(lambda c: fx.cell(c, T.DoubleType()), v=1.0) == "1.0"
    assert one(lambda c: fx.cell(c, T.BooleanType()), v=True) == "True"


def test_truthy_coalesce(one):
    assert one(lambda a, b: fx.truthy_coalesce(T.DoubleType(), a, b), a=0.0, b=3.0) == 3.0
    assert one(lambda a, b: fx.truthy_coalesce(T.StringType(), a, b), a="", b="") == ""
    assert one(lambda a, b: fx.truthy_coalesce(T.StringType(), a, b), a="0.0/10", b="x") == "0.0/10"


def test_scores(spark):
    assert each(spark, ["Note : 8,5 / 10", "9/10", "8/100", None, "x"], fx.score_of_ten) == [8.5, 9.0, None, None, None]
    assert each(spark, ["+ 1,25 / 10", "1,25 / 10"], fx.progression) == [1.25, None]
    assert each(spark, ["Oui", " NON ", "peut-être", None], fx.yes_no) == ["oui", "non", None, None]
    assert each(spark, ["Évaluation  À froid"], fx.fold) == ["evaluation a froid"]


def test_clean_comments(spark, one):
    given = [" RAS ", "Très bien", "très bien", "- ras", None, "ok", "a  b c", "-–-"]
    rows = spark.createDataFrame([(given,), (None,), ([],)], "v array<string>")
    assert [r.o for r in rows.select(lists.clean_list(F.col("v")).alias("o")).collect()] == [["Très bien", "ras", "a b c"], [], []]


def test_clean_is_idempotent_without_hidden_noise(spark):
    r = random.Random(2)
    given = [["".join(r.choice("ab •- É") for _ in range(r.randint(0, 9))) for _ in range(6)] for _ in range(60)]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, v array<string>")
    once = rows.select("i", lists.clean_list(F.col("v")).alias("v"))
    for a, b in zip(once.orderBy("i").collect(), once.select("i", lists.clean_list(F.col("v")).alias("v")).orderBy("i").collect(), strict=True):
        assert [x for x in a.v if len(x) > 2] == b.v
        assert len({x.lower() for x in a.v}) == len(a.v)


def test_file_names_and_hash(one):
    assert one(fx.safe_file_name, a=" AFG 1 ", b="S1 2025") == "AFG_1_S1_2025.json"
    assert one(lambda a: fx.payload_hash(a), a="x") == one(lambda a: fx.payload_hash(a), a="x")


@pytest.mark.parametrize("space", [" ", "　", "\x1c", "\u0085"])
def test_unicode_white_space(one, space):
    assert one(fx.strip, a=f"{space}x{space}") == "x"
    assert one(fx.collapse, a=f"x{space}{space}y") == "x y"
