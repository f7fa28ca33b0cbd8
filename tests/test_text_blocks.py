from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import narrative, text_blocks as tb


def test_histogram_lines(spark):
    df = spark.createDataFrame([("5 ........... 10   13 %",), ("1 .. 0 0,5 %",), ("6 .... 1 2 %",), ("51 votants",), (None,), ("4 ...... 13 %",)], "l string")
    out = [tuple(r) for r in df.select(*tb.histogram_line(F.col("l"))).collect()]
    assert out == [(5, 10, 13.0), (1, 0, 0.5), (None,) * 3, (None,) * 3, (None,) * 3, (None,) * 3]


def test_pages(spark):
    df = spark.createDataFrame([(["\n a", None, "b \n"],), ([],), (None,)], "p array<string>")
    assert [r.o for r in df.select(tb.join_pages(F.col("p")).alias("o")).collect()] == ["a\n\nb", "", ""]


def test_segments_and_islands(spark):
    rows = [(1, 0, "x", None), (1, 1, "A", "A"), (1, 2, "y", None), (1, 3, "B", "B"), (2, 0, "z", None)]
    df = spark.createDataFrame(rows, "d int, pos int, l string, anchor string")
    cut = tb.segment(df, ["d"], "pos", F.col("anchor")).orderBy("d", "pos")
    assert [r.bloc for r in cut.collect()] == [None, "A", "A", "B", None]
    near = tb.nearest_after(df, ["d"], "pos", F.col("anchor")).orderBy("d", "pos")
    assert [r.proche for r in near.collect()] == ["A", "A", "B", "B", None]
    runs = tb.islands(df, ["d"], "pos", F.col("anchor").isNull(), "l").orderBy("d", "ilot").collect()
    assert [(r.d, r.ilot, r.groupe, r.n, r.texte) for r in runs] == [(1, 1, True, 1, "x"), (1, 2, False, 1, "A"), (1, 3, True, 1, "y"), (1, 4, False, 1, "B"), (2, 1, True, 1, "z")]


def test_repeated_lines(spark):
    df = spark.createDataFrame([(1, "h"), (2, "h"), (2, "h"), (3, "x"), (3, None)], "d int, l string")
    assert {tuple(r) for r in tb.without_repeated(df, "d", "l", 2).select("d", "l").collect()} == {(3, "x"), (3, None)}


def test_prefer(spark):
    a, b = spark.createDataFrame([(1, 5)], "k int, v int"), spark.createDataFrame([(1, 9), (2, 8)], "k int, v int")
    assert {tuple(r) for r in tb.prefer(a, b, ["k"], "v").collect()} == {(1, 5), (2, 8)}


def test_prompt(spark):
    text = narrative.prompt("a {{PDF_TEXT}} b {{PDF_METADATA}}", F.lit("x {{PDF_METADATA}}"), F.lit("M"))
    assert spark.range(1).select(text).first()[0] == "a x M b M"


def test_summaries(spark):
    df = spark.createDataFrame([(1, "un"), (2, ""), (3, None), (4, "boum")], "i int, t string")

    def make():
        def ask(t):
            if t == "boum":
                raise RuntimeError
            return f' "{t} !" '

        return ask

    out = {r.i: r.s for r in narrative.by_function(df, "t", "s", make).collect()}
    assert out == {1: "un !", 2: narrative.NO_INFO, 3: narrative.NO_INFO, 4: narrative.NO_INFO}
    lists = spark.createDataFrame([(["RAS", "Bien", "bien", "Long"],), (None,)], "v array<string>")
    assert [r[0] for r in lists.select(narrative.summary(F.col("v"), "extractive")).collect()] == ["Bien ; Long", narrative.NO_INFO]
