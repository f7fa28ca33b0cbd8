"""Summaries of comments: none, extractive (native, deterministic) or by a function of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.lists import clean_list
from papyrine.functions.scalar import json_between_braces, unwrap_summary
from papyrine.operators.records import payload_check

#: The sentences that stand for missing content.
NO_INFO = "Aucune remarque – les données indiquent l’absence d’informations."
NO_REMARK = "Aucune remarque."
NO_DATA = "Données indisponibles"


def summary(items: Column, provider: str = "none", empty: str = NO_INFO, most: int = 3) -> Column:
    """Sentence for a list of comments. ``none`` gives the fixed sentence, ``extractive`` the first ``most`` comments."""
    if provider == "none":
        return F.lit(empty)
    if provider != "extractive":
        raise ValueError(f"unknown provider: {provider}")
    kept = F.slice(clean_list(items), 1, most)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ; ")).otherwise(F.lit(empty))


def top_lines(df: DataFrame, group: str, line: str, most: int = 3) -> DataFrame:
    """(group, rang, ligne, n): the most frequent lines of each group, ties by text."""
    counts = df.groupBy(group, line).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), line))
    return counts.withColumn("rang", rank).where(F.col("rang") <= most).select(group, "rang", F.col(line).alias("ligne"), "n")


def prompt(template: str, text: Column, meta: Column) -> Column:
    """The template with the text put in first, then the metadata, so a placeholder inside the text is filled too."""
    filled = F.replace(F.lit(template), F.lit("{{PDF_TEXT}}"), text)
    return F.replace(filled, F.lit("{{PDF_METADATA}}"), meta)


def metadata(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def by_function(df: DataFrame, text: str, out: str, make: Callable[[], Callable[[str], str | None]], empty: str = NO_INFO, raw: bool = False) -> DataFrame:
    """``df`` with ``out``: what the function that ``make`` builds once per task says about ``text``.

    Empty texts never reach it; with ``raw`` the answer is left as it is, else unwrapped to a sentence; an exception or an empty answer gives ``empty``. A task may run twice after a failure, so
    the function must be repeatable.
    """

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = make()

        def one(t: str | None) -> str | None:
            try:
                return ask(t) if t else None
            except Exception:  # noqa: BLE001 - a failed summary must not fail the table
                return None

        for batch in batches:
            yield batch.map(one)

    asked = df.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn(out, call(text))
    told = F.col(out) if raw else F.nullif(unwrap_summary(F.col(out)), F.lit(""))
    asked = asked.withColumn(out, F.coalesce(told, F.lit(empty)))
    rest = df.where(F.coalesce(F.col(text), F.lit("")) == "").withColumn(out, F.lit(empty))
    return asked.unionByName(rest)


def records_of_responses(df: DataFrame, response: str) -> DataFrame:
    """``df`` with ``json`` and ``erreurs``, the record a model's response holds and what is wrong with it, and ``debut``, the first
    500 characters of a response without a record.

    The JSON may stand between other text; commas of its texts are read as points and their ends stripped, then the whole record is
    checked against the declared schema. A null response or one without JSON has the error ``json`` and no record.
    """
    read = df.withColumn("_r", payload_check(json_between_braces(F.col(response)), commas=True))
    read = read.withColumn("json", F.col("_r.json")).withColumn("erreurs", F.col("_r.erreurs"))
    return read.withColumn("debut", F.when(F.col("json").isNull(), F.left(F.col(response), F.lit(500)))).drop("_r")


def read_prompt(path: str) -> str:
    """The template in a file; a missing one is an error that names it."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError as e:
        raise FileNotFoundError(f"no prompt at {path}") from e


def extract_records(df: DataFrame, text: str, meta: Column, template: str, make: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """The whole way from report to record: the filled prompt goes to the function that ``make`` builds once per task, and its
    response is read by :func:`records_of_responses`. Reports without text aren't asked about and have the error ``json``."""
    asked = df.withColumn("_prompt", F.when(F.length(F.trim(text)) > 0, prompt(template, F.col(text), meta)))
    return records_of_responses(by_function(asked, "_prompt", "reponse", make, "", raw=True).drop("_prompt"), "reponse")
