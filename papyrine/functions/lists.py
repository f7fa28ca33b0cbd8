"""Column functions over arrays of comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.scalar import collapse, let, norm, strip

#: Answers that say nothing.
NOISE = (
    "ras", "r.a.s", "aucun", "aucune", "aucuns", "aucunes", "rien", "néant", "x", "-", "/", ".", "..", "...", "ok", "0",
    "je ne sais pas", "ne sait pas", "je sais pas", "pas de sujet", "pas de sujet particulier", "pas de particulier",
    "pas d'idée", "pas d’idée", "pas d'idée particulière", "pas d’idée particulière", "pas concerné", "sans réponse", "non", "merci",
    "pas de suggestion", "aucune suggestion", "je n'en ai pas", "pas à ma connaissance",
)
#: Characters taken off both ends of a comment.
BULLETS = " -–—·•"


def is_noise(text: Column) -> Column:
    """Blank, a known non-answer, or two characters at most."""
    longest = max(map(len, NOISE))
    return let(strip(text), lambda t: (F.length(t) <= 2) | ((F.length(t) <= longest) & F.lower(t).isin(*NOISE)))


def clean_comment(text: Column) -> Column:
    """The comment without noise, bullets and double blanks; null where nothing is left."""
    return let(norm(text), lambda t: F.when(~is_noise(t), F.nullif(F.btrim(collapse(t), F.lit(BULLETS)), F.lit(""))))


def dedup_ignoring_case(items: Column) -> Column:
    """First spelling of each comment, in order. By sorting, so a long list costs little more than its length."""

    def firsts(s: Column) -> Column:
        new = F.filter(s, lambda e, k: (k == 0) | (F.get(s, k - 1)["low"] != e["low"]))
        return F.transform(F.array_sort(F.transform(new, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])

    return let(F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x")))), firsts)


def clean_list(items: Column) -> Column:
    """Cleaned comments without repetitions, in order; null becomes an empty list."""
    return F.coalesce(dedup_ignoring_case(F.array_compact(F.transform(items, clean_comment))), F.array().cast("array<string>"))


def missing_or_empty(value: Column, sized: bool) -> Column:
    """Null, or an array or map without elements. Empty text is not missing."""
    return value.isNull() | (F.size(value) == 0) if sized else value.isNull()
