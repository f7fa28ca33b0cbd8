"""Deterministic reading of report text: blocks, scores near labels, histogram lines, speakers, repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.scalar import strip


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, ligne): the lines of each text; null gives none."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "ligne"))


def join_pages(pages: Column) -> Column:
    """Pages joined by newline and stripped; null pages are empty, null pages array gives an empty text."""
    return strip(F.array_join(F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit(""))), "\n"))


def needs_ocr(text: Column, least: int = 30) -> Column:
    """Whether a read text is so short that the document must be read as images."""
    return F.length(text) < least


def is_large(pages: Column, chars: Column, most_pages: int = 80, most_chars: int = 180_000) -> Column:
    return (pages > most_pages) | (chars > most_chars)


def segment(df: DataFrame, doc: list[str], pos: str, anchor: Column) -> DataFrame:
    """``df`` with ``bloc``: the anchor of the last line at or before this one that has one; null before the first."""
    order = Window.partitionBy(*doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("bloc", F.last(anchor, ignorenulls=True).over(order))


def nearest_after(df: DataFrame, doc: list[str], pos: str, value: Column) -> DataFrame:
    """``df`` with ``proche``: the first value on this line or after it in the document."""
    order = Window.partitionBy(*doc).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("proche", F.first(value, ignorenulls=True).over(order))


#: level, dots or blanks, votes, percentage; level and percentage are never one number.
HISTOGRAM = r"^\s*([1-5])\s*[.\s]+\s(\d+)\s+(\d+(?:[.,]\d+)?)\s*%"


def histogram_line(text: Column) -> tuple[Column, Column, Column]:
    """(level, votes, percentage) of a chart line, nulls for other lines."""
    part = lambda k: F.regexp_extract(text, HISTOGRAM, k)
    return part(1).try_cast("int"), part(2).try_cast("int"), F.replace(part(3), F.lit(","), F.lit(".")).try_cast("double")


def chart_is_consistent(votes: Column, total: Column, percents: Column) -> Column:
    """Votes sum to the total and percentages to 99..101."""
    return (votes == total) & percents.between(99, 101)


def repeated_lines(df: DataFrame, doc: str, line: str, least: int) -> DataFrame:
    """Lines that stand in at least ``least`` documents."""
    return df.groupBy(line).agg(F.countDistinct(doc).alias("n")).where(F.col("n") >= least).select(line)


def without_repeated(df: DataFrame, doc: str, line: str, least: int, salts: int = 16) -> DataFrame:
    """``df`` without the lines that stand in at least ``least`` documents. A line may be most of all lines, so both sides are salted."""
    salt = "_salt"
    while salt in df.columns:
        salt += "_"
    known = repeated_lines(df, doc, line, least).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn(salt, F.pmod(F.xxhash64(doc), F.lit(salts)).cast("int")).join(known, [line, salt], "left_anti").select(df.columns)


def islands(df: DataFrame, doc: list[str], pos: str, group: Column, text: str, glue: str = " ") -> DataFrame:
    """Runs of lines of the same group joined in order: (doc, ilot, groupe, debut, n, texte)."""
    order = Window.partitionBy(*doc).orderBy(pos)
    marked = df.withColumn("_g", group).withColumn("_new", (~F.col("_g").eqNullSafe(F.lag("_g").over(order)) | (F.row_number().over(order) == 1)).cast("int"))
    marked = marked.withColumn("ilot", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*doc, "ilot").agg(
        F.first("_g").alias("groupe"), F.min(pos).alias("debut"), F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), glue).alias("texte"),
    )


def prefer(detail: DataFrame, summary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full join of two tables of the same value: the detail's where there is one."""
    d, s = detail.withColumnRenamed(value, "_d"), summary.withColumnRenamed(value, "_s")
    return d.join(s, keys, "full").select(*keys, F.coalesce("_d", "_s").alias(value))
