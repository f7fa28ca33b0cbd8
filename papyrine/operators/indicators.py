"""Indicators of a report, on one document's arrays and as aggregations over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.scalar import let, note, one_decimal, percent_text, whole

LEVELS = ("5", "4", "3", "2", "1")


def rebalance(a: Column, b: Column, c: Column) -> Column:
    """struct(x, y, z) of whole numbers that sum to 100: the difference goes to the largest, the first one on ties."""

    def share(t: Column) -> Column:
        rest = 100 - (t["x"] + t["y"] + t["z"])
        first = (t["x"] >= t["y"]) & (t["x"] >= t["z"])
        second = ~first & (t["y"] >= t["z"])
        add = lambda name, test: (t[name] + F.when(test, rest).otherwise(0)).alias(name)
        return F.struct(add("x", first), add("y", second), add("z", ~first & ~second))

    return let(F.struct(whole(a).alias("x"), whole(b).alias("y"), whole(c).alias("z")), share)


def willingness_text(a: Column, b: Column, c: Column) -> Column:
    text = lambda t: F.concat(t["x"].cast("string"), F.lit(" % favorables, "), t["y"].cast("string"), F.lit(" % neutre, "), t["z"].cast("string"), F.lit(" % non favorables"))
    return let(rebalance(a, b, c), text)


def _text_of_levels(levels: Column) -> Column:
    """From a struct of p5..p1 and c5..c1 and total, all doubles without nulls."""

    def text(t: Column) -> Column:
        p, c = [t[f"p{k}"] for k in LEVELS], [t[f"c{k}"] for k in LEVELS]
        by_votes = (p[0] + p[1] + p[2] + p[3] + p[4] == 0) & (t["total"] > 0) & (c[0] + c[1] + c[2] + c[3] + c[4] > 0)
        q = [F.when(by_votes, 100.0 * (v / F.nullif(t["total"], F.lit(0.0)))).otherwise(x) for x, v in zip(p, c, strict=True)]
        return willingness_text(q[0] + q[1], q[2], q[3] + q[4])

    return let(levels, text)


def willingness_from_levels(pct: dict[str, Column], votes: dict[str, Column], total: Column) -> Column:
    """Percentages first; where all are 0, votes over the total."""
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return _text_of_levels(F.struct(*(number(pct[k]).alias(f"p{k}") for k in LEVELS), *(number(votes[k]).alias(f"c{k}") for k in LEVELS), number(total).alias("total")))


def willingness(items: Column, total: Column, prefix: str = "echele_") -> Column:
    """From the array of distribution items. An item's level is its first filled field; the last item of a level counts."""
    zeros = F.struct(*(F.lit(0.0).alias(f"{what}{k}") for what in "pc" for k in LEVELS))

    def add(acc: Column, d: Column) -> Column:
        level = F.coalesce(*(F.when(d[f"{prefix}{k}"].isNotNull(), F.lit(k)) for k in LEVELS))
        pct = [F.when(level == k, F.coalesce(d["pourcentage"].cast("double"), F.lit(0.0))).otherwise(acc[f"p{k}"]).alias(f"p{k}") for k in LEVELS]
        votes = [F.when((level == k) & d["nb_votants"].isNotNull(), d["nb_votants"].cast("double")).otherwise(acc[f"c{k}"]).alias(f"c{k}") for k in LEVELS]
        return F.struct(*pct, *votes)

    held = F.aggregate(F.filter(items, lambda d: d.isNotNull()), zeros, add)
    told = lambda t: F.struct(*(F.coalesce(t[f"{what}{k}"], F.lit(0.0)).alias(f"{what}{k}") for what in "pc" for k in LEVELS), F.coalesce(total.cast("double"), F.lit(0.0)).alias("total"))
    return _text_of_levels(let(held, told))


def willingness_by(df: DataFrame, keys: list[str], level: str, pct: str, votes: str, total: str, pos: str) -> DataFrame:
    """(keys, volonte) from one row per distribution item; partial aggregation before the one shuffle."""
    last = lambda value, k: F.max_by(F.col(value), F.when((F.col(level) == k) & F.col(value).isNotNull(), F.col(pos)))
    at = lambda k: F.max_by(F.coalesce(F.col(pct), F.lit(0.0)), F.when(F.col(level) == k, F.col(pos)))
    sums = df.groupBy(*keys).agg(*(at(k).alias(f"_p{k}") for k in LEVELS), *(last(votes, k).alias(f"_c{k}") for k in LEVELS), F.max(total).alias("_total"))
    text = willingness_from_levels({k: F.col(f"_p{k}") for k in LEVELS}, {k: F.col(f"_c{k}") for k in LEVELS}, F.col("_total"))
    return sums.select(*keys, text.alias("volonte"))


def mean_note(objectives: Column) -> Column:
    """Mean of the numeric notes of an array of objectives, as ``7.2/10``; null without any."""
    notes = F.filter(F.transform(objectives, lambda o: o["note_sur_10"]), lambda x: x.isNotNull())
    add = lambda t, x: F.struct((t["n"] + 1).alias("n"), (t["sum"] + x).alias("sum"))
    text = lambda t: F.when(t["n"] > 0, note(t["sum"] / F.nullif(t["n"], F.lit(0))))
    return F.aggregate(notes, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum")), add, text)


#: The labels that count as satisfied.
POSITIVE = ("Très satisfait(e)", "Satisfait(e)")


def satisfaction(items: Column) -> Column:
    """Share of satisfied answers; without any counts, the sum of their percentages; null without items."""
    number = lambda x: F.coalesce(x, F.lit(0.0))
    zeros = F.struct(F.lit(0).alias("n"), *(F.lit(0.0).alias(x) for x in ("all", "happy", "percent")))

    def add(t: Column, i: Column) -> Column:
        happy = F.coalesce(i["label"].isin(*POSITIVE), F.lit(False))
        return F.struct(
            (t["n"] + 1).alias("n"), (t["all"] + number(i["count"])).alias("all"),
            (t["happy"] + F.when(happy, number(i["count"])).otherwise(0.0)).alias("happy"), (t["percent"] + F.when(happy, number(i["percent"])).otherwise(0.0)).alias("percent"),
        )

    text = lambda t: F.when(t["n"] > 0, F.when(t["all"] == 0, percent_text(t["percent"])).otherwise(percent_text(t["happy"] / F.nullif(t["all"], F.lit(0.0)) * 100)))
    return F.aggregate(F.filter(items, lambda i: i.isNotNull()), zeros, add, text)


def satisfaction_by(df: DataFrame, keys: list[str], label: str, positive: tuple[str, ...]) -> DataFrame:
    """(keys, satisfaction) from one row per answer."""
    share = F.sum(F.when(F.col(label).isin(*positive), 1).otherwise(0)) / F.count("*") * 100
    return df.groupBy(*keys).agg(percent_text(share).alias("satisfaction"))


def fill_percent(percent: Column, votes: Column, total: Column) -> Column:
    """The percentage, or where it is null and votes and total are known, votes over total with one decimal."""
    filled = one_decimal(votes / F.nullif(total.cast("double"), F.lit(0.0)) * 100).try_cast("double")
    return F.coalesce(percent, F.when(F.coalesce(total, F.lit(0)) != 0, filled))
