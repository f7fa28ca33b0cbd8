"""Records against schemas: legacy layout to current, validation with reasons, completeness, header alignment."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions.scalar import cell, lenient_float, let, one_decimal, parse_float, truthy_coalesce, votes_number, votes_text
from papyrine.schema import ANSWERS, LABELS, MODES, PAYLOAD

#: Spellings of satisfaction labels and what they stand for.
LABEL_MAP = {
    "Très satisfait-e": "Très satisfait(e)", "Tres satisfait(e)": "Très satisfait(e)", "Satisfait-e": "Satisfait(e)",
    "Déçu-e": "Déçu(e)", "Deçu(e)": "Déçu(e)", "Sans-opinion": "Sans opinion", "Sans opinion ": "Sans opinion",
}


def canonical_label(label: Column, mapping: dict[str, str] | None = None) -> Column:
    """The label a spelling stands for; an unknown one is left as it is."""
    pairs = [F.lit(x) for kv in (LABEL_MAP if mapping is None else mapping).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


# --- legacy layout -----------------------------------------------------------------------------------------------------


def is_current(raw: Column) -> Column:
    """Whether ``pre_formation`` has the key ``volonte_suivi_formation``, be it null."""
    keys = F.json_object_keys(F.get_json_object(raw, "$.pre_formation"))
    return F.coalesce(F.array_contains(keys, "volonte_suivi_formation"), F.lit(False))


_TEXT = T.StringType()


def _get(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, path)


def legacy_distribution(raw: Column) -> Column:
    """Five items in the order 5..1, of each label the last one given; absent labels give null fields."""
    given = F.from_json(_get(raw, "$.pre_formation.souhaitez_vous_suivre_distribution"), "array<struct<label:string,count:double,percent:string>>")

    def item(k: str) -> Column:
        d = F.try_element_at(F.filter(given, lambda x: x["label"] == k), F.lit(-1))
        return F.struct(F.lit(k).alias("niveau"), votes_text(d["count"]).alias("texte"), lenient_float(d["percent"]).alias("pourcentage"))

    return F.array(*(item(k) for k in "54321"))


def _array(text: Column) -> Column:
    """JSON texts of the elements of a JSON array, keys sorted; null for anything else."""
    return F.transform(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), lambda e: F.coalesce(F.to_json(e), F.lit("null")))


def _with(text: Column, key: str, value: Column) -> Column:
    """A JSON object with ``key`` set to the JSON text ``value``; without a value it stays as it is."""
    kept = F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: k != key)
    return F.when(value.isNull(), text).otherwise(F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(value)))))


def canonical_labels(items: Column) -> Column:
    """A JSON array of satisfaction items with the labels their spellings stand for; items that are no objects stay."""

    def one(item: Column) -> Column:
        label = F.get_json_object(item, "$.label")
        meant = F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_MAP.items() for x in kv]), label)
        return F.when(meant.isNotNull(), _with(item, "label", F.concat(F.lit('"'), meant, F.lit('"')))).otherwise(item)

    return F.concat(F.lit("["), F.array_join(F.transform(_array(items), one), ",", "null"), F.lit("]"))


def filled_percentages(items: Column, total: Column) -> Column:
    """A JSON array of distribution items, where an item without percentage whose level reads "n votants" gets n over the total,
    with one decimal. Without a total nothing is filled."""

    def one(item: Column) -> Column:
        level = F.try_element_at(F.filter(F.json_object_keys(item), lambda k: k.startswith("echele ")), F.lit(1))
        votes = votes_number(F.try_element_at(F.from_json(item, "map<string,string>"), level))
        share = one_decimal(votes / F.nullif(total, F.lit(0.0)) * 100)
        return F.when(F.get_json_object(item, "$.pourcentage").isNull() & share.isNotNull(), _with(item, "pourcentage", share)).otherwise(item)

    return F.concat(F.lit("["), F.array_join(F.transform(_array(items), one), ",", "null"), F.lit("]"))


def legacy_to_current(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with ``v2``, the record in the current layout as a JSON text, and ``etait_v2``.

    Of a record in either layout satisfaction labels become the canonical ones, missing percentages are filled from votes
    and the version is stamped. Null raw and a text that is no JSON object give null.
    """
    held = "_r"
    while held in df.columns:
        held += "_"
    # a projection of its own: the check is made once, however often the text is read below
    df = df.withColumn(held, F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(raw))), F.lit("")).startswith("OBJECT"), F.col(raw)))
    r = F.col(held)
    told = truthy_coalesce(_TEXT, *(F.nullif(_get(r, f"$.pre_formation.souhaitez_vous_suivre.{k}"), F.lit("0")) for k in ("voters_total", "votants")))
    voters = parse_float(told)
    pick = lambda *paths: truthy_coalesce(_TEXT, *(_get(r, p) for p in paths))
    variant = lambda c: F.try_parse_json(c)
    asjson = lambda *paths: variant(truthy_coalesce(_TEXT, *(F.when(~F.coalesce(_get(r, p), F.lit("")).isin("[]", "{}", "0"), _get(r, p)) for p in paths)))
    number = lambda *paths: truthy_coalesce(T.DoubleType(), *(_get(r, p).try_cast("double") for p in paths))
    number_text = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x.cast("string"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    item = lambda d: F.concat(F.lit('{"echele '), d["niveau"], F.lit('":'), F.coalesce(quoted(d["texte"]), F.lit("null")), F.lit(',"pourcentage":'), F.coalesce(number_text(d["pourcentage"]), F.lit("null")), F.lit("}"))
    scale = F.concat(F.lit("["), F.array_join(F.transform(legacy_distribution(r), item), ","), F.lit("]"))
    pre = F.struct(
        F.struct(F.coalesce(F.try_parse_json(told), F.try_parse_json(quoted(told))).alias("nb votants")).alias("volonte_suivi_formation"),
        F.parse_json(filled_percentages(scale, voters)).alias("souhaitez_vous_suivre_distribution"),
        asjson("$.pre_formation.sujets_a_aborder", "$.pre_formation.demande_sujets_a_aborder").alias("demande_sujets_a_aborder"),
        F.struct(
            pick("$.pre_formation.maitrise_objectifs.mode", "$.pre_formation.maitrise_objectifs_preformation.mode").alias("mode"),
            asjson("$.pre_formation.maitrise_objectifs.par_objectif", "$.pre_formation.maitrise_objectifs_preformation.par_objectif").alias("par_objectif"),
            number("$.pre_formation.maitrise_objectifs.note_globale_objectifs_sur_10", "$.pre_formation.maitrise_objectifs_preformation.note_globale_objectifs_preformation").alias("note_globale_objectifs_preformation"),
        ).alias("maitrise_objectifs_preformation"),
    )
    hot_mastery = F.when(_get(r, "$.a_chaud.maitrise_objectifs").isNotNull(), F.struct(
        _get(r, "$.a_chaud.maitrise_objectifs.mode").alias("mode"), variant(_get(r, "$.a_chaud.maitrise_objectifs.par_objectif")).alias("par_objectif"),
        _get(r, "$.a_chaud.maitrise_objectifs.note_globale_objectifs_sur_10").try_cast("double").alias("note_globale_objectifs_a_chaud")))
    hot = F.struct(
        variant(_get(r, "$.a_chaud.profitable")).alias("formation_profitable"), F.coalesce(variant(canonical_labels(_get(r, "$.a_chaud.satisfaction_contenu"))), variant(_get(r, "$.a_chaud.satisfaction_contenu"))).alias("satisfaction_contenu"),
        number("$.a_chaud.impression_globale_note_sur_10", "$.a_chaud.note_globale_a_chaud").alias("note_globale_a_chaud"),
        *(variant(_get(r, f"$.a_chaud.{n}")).alias(n) for n in ("points_forts", "points_a_ajuster", "appreciations_intervenants")),
        asjson("$.a_chaud.suggestions_complement", "$.a_chaud.suggestions_complement_sur_formation").alias("suggestions_complement_sur_formation"),
        hot_mastery.alias("maitrise_objectifs_a_chaud"),
    )
    cold_mastery = F.when(_get(r, "$.a_froid.maitrise_objectifs").isNotNull() | _get(r, "$.a_froid.maitrise_objectifs_a_froid").isNotNull(), F.struct(
        _get(r, "$.a_froid.maitrise_objectifs.mode").alias("mode"), variant(_get(r, "$.a_froid.maitrise_objectifs.par_objectif")).alias("par_objectif"),
        number("$.a_froid.maitrise_objectifs.note_globale_objectifs_sur_10", "$.a_froid.note_globale_objectifs_a_froid").alias("note_globale_objectifs_a_froid")))
    cold = F.struct(_get(r, "$.a_froid.note_sur_10").try_cast("double").alias("note_sur_10"), cold_mastery.alias("maitrise_objectifs_a_froid"), variant(_get(r, "$.a_froid.elements_les_plus_utiles")).alias("elements_les_plus_utiles"))
    # get_json_object can't read a key that begins with a blank, so the two names are read through a map
    root = F.from_json(r, "map<string,string>")
    mapped = F.struct(
        F.try_element_at(root, F.lit("Nom formation")).alias("Nom formation"), F.try_element_at(root, F.lit(" semestre")).alias(" semestre"),
        pre.alias("pre_formation"), hot.alias("a_chaud"), cold.alias("a_froid"),
        variant(_get(r, "$.intervenants")).alias("intervenants"), variant(_get(r, "$.resultats_evaluations")).alias("resultats_evaluations"),
        _get(r, "$.lien_vers_formation").alias("lien_vers_formation"), F.lit("v2.1").alias("version_prompt"),
    )
    # a record in the current layout is only written anew where a label or a percentage changes
    items, levels = _get(r, "$.a_chaud.satisfaction_contenu"), _get(r, "$.pre_formation.souhaitez_vous_suivre_distribution")
    volunteers = F.from_json(_get(r, "$.pre_formation.volonte_suivi_formation"), "map<string,string>")
    total = truthy_coalesce(T.DoubleType(), *(parse_float(F.try_element_at(volunteers, F.lit(k))) for k in ("nb votants", "nb_votants")))
    labelled = let(F.when(F.exists(_array(items), lambda x: F.get_json_object(x, "$.label").isin(*LABEL_MAP)), canonical_labels(items)), lambda x: _with(r, "a_chaud", _with(_get(r, "$.a_chaud"), "satisfaction_contenu", x)))
    lacks = F.exists(_array(levels), lambda x: x.contains("votant") & F.get_json_object(x, "$.pourcentage").isNull())
    both = let(F.struct(labelled.alias("t"), F.when(lacks, filled_percentages(levels, total)).alias("f")), lambda x: F.when(x["f"].isNull(), x["t"]).otherwise(_with(x["t"], "pre_formation", _with(_get(x["t"], "$.pre_formation"), "souhaitez_vous_suivre_distribution", x["f"]))))
    stamped = _with(F.coalesce(both, r), "version_prompt", F.lit('"v2.1"'))
    current = is_current(r)
    return df.withColumn("etait_v2", current).withColumn("v2", F.when(r.isNotNull(), F.when(F.col("etait_v2"), stamped).otherwise(F.to_json(mapped)))).drop(held)


def with_identity(raw: Column, name: Column, term: Column, link: Column) -> Column:
    """The record with training name, term and link as they were asked for, whatever was extracted. A null value is put in as null."""
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    inner = lambda c: F.regexp_replace(text(c), r"^\[|\]$", "")
    return _with(_with(_with(raw, "Nom formation", inner(name)), " semestre", inner(term)), "lien_vers_formation", inner(link))


# --- validation --------------------------------------------------------------------------------------------------------


def _checked(leaf: Column, kind: T.DataType, path: str, required: bool, domain: tuple[str, ...] | None) -> Column:
    """struct(value, message) of a scalar leaf; the message is null where the leaf is fine."""

    def read(t: Column) -> Column:
        v, told = t["v"], t["told"]
        if isinstance(kind, T.StringType):
            return F.when(told == "STRING", F.try_variant_get(v, "$", "string"))
        if isinstance(kind, T.BooleanType):
            return F.try_variant_get(v, "$", "boolean")
        number = F.coalesce(F.try_variant_get(v, "$", "double"), F.when(told == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")))
        if isinstance(kind, (T.IntegerType, T.LongType)):
            return let(number, lambda x: F.when(x == F.floor(x), x.cast("bigint")))
        return number

    def judge(t: Column) -> Column:
        message = F.when(t["void"], F.lit(f"{path}: absent") if required else F.lit(None)).when(t["value"].isNull(), F.lit(f"{path}: type"))
        if domain:
            message = F.when(~t["value"].isin(*domain), F.lit(f"{path}: domaine")).otherwise(message)
        return F.struct(t["value"].alias("value"), message.alias("message"))

    def typed(t: Column) -> Column:
        void = t["v"].isNull() | (t["told"] == "VOID")
        return F.struct(void.alias("void"), F.when(~void, read(t)).alias("value"))

    bound = let(leaf, lambda v: F.struct(v.alias("v"), F.schema_of_variant(v).alias("told")))
    return let(let(bound, typed), judge)


def validate(df: DataFrame, raw: str, fields: dict[str, tuple[T.DataType, bool, tuple[str, ...] | None]]) -> DataFrame:
    """``df`` with a typed column per field and ``erreurs`` (empty for an accepted record).

    ``fields``: JSON path -> (type, required, allowed values). Numbers are read from numeric text and booleans, text only
    from text; an integer must be whole. A record that isn't a JSON object has the one error ``json``. The document is
    parsed once.
    """
    names = [path.rsplit(".", 1)[-1].strip("$.[]'\" ").replace(" ", "_") for path in fields]

    def body(v: Column) -> Column:
        each = [_checked(F.try_variant_get(v, path, "variant"), kind, path, required, domain) for path, (kind, required, domain) in fields.items()]
        checked = F.struct(*(c.alias(f"f{k}") for k, c in enumerate(each)))
        messages = lambda t: F.array_compact(F.array(*(t[f"f{k}"]["message"] for k in range(len(each)))))
        is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        return let(checked, lambda t: F.struct(*(t[f"f{k}"]["value"].alias(n) for k, n in enumerate(names)), F.when(is_object, messages(t)).otherwise(F.array(F.lit("json"))).alias("erreurs")))

    held = "_checked"
    while held in df.columns:
        held += "_"
    return df.withColumn(held, let(F.try_parse_json(F.col(raw)), body)).select("*", f"{held}.*").drop(held)


def exactly_one(values: list[Column]) -> Column:
    """Whether exactly one of the values isn't null."""
    return reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values]) == 1


DOMAINS = {"mode": MODES, "label": LABELS, "reponse": ANSWERS}
#: Fields that must be there, fields that are also read under another name, and those of which one item has one.
REQUIRED = {"Nom formation", " semestre", "lien_vers_formation", "objectif_label", "label"}
ALIASES = {"Nom formation": "Nom_formation", " semestre": "semestre", "nb votants": "nb_votants", **{f"echele {k}": f"echele_{k}" for k in "54321"}}
ONE_OF = frozenset(f"echele {k}" for k in "54321")


#: Reads a JSON value: (value, messages) -> typed value. A value of None is absent or null.
Reader = Callable[[object, list[str]], object]
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:nan|inf|infinity)", re.IGNORECASE)


def _scalar_reader(kind: T.DataType, path: str, domain: tuple[str, ...] | None, commas: bool) -> Reader:
    """Text only from text, numbers also from numeric text and booleans, whole numbers from numbers without a fraction."""

    def typed(v: object) -> object:
        if isinstance(v, str) and commas:
            v = v.replace(",", ".").strip()
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else None
        if isinstance(kind, T.BooleanType):
            return v if isinstance(v, bool) else None
        if isinstance(v, str):
            v = float(v) if _NUMBER.fullmatch(v := v.strip()) else None
        if not isinstance(v, (int, float)):
            return None
        if isinstance(kind, T.DoubleType):
            return float(v)
        return int(v) if isinstance(v, int) or v.is_integer() else None

    def read(v: object, messages: list[str]) -> object:
        value = typed(v)
        if value is None:
            messages.append(f"{path}: type")
        elif domain and value not in domain:
            messages.append(f"{path}: domaine")
        return value

    return read


def _reader(kind: T.DataType, path: str, required: bool, domain: tuple[str, ...] | None, commas: bool) -> Reader:
    """Reader of a declared type and all below it. Elements of an array have the path of ``[]``, values of a map that of ``.*``."""
    if isinstance(kind, T.StructType):
        fields = [(f.name, ALIASES.get(f.name, f.name), f.name in ONE_OF, _reader(f.dataType, f"{path}.{f.name}", f.name in REQUIRED, DOMAINS.get(f.name), commas)) for f in kind.fields]
        names, levels, expected = set(kind.names), bool(ONE_OF & set(kind.names)), dict

        def inner(v: dict, messages: list[str]) -> dict:
            out, filled = {}, 0
            for name, other, one_of, read in fields:
                given = v.get(name)
                if name not in v and other not in names:
                    given = v.get(other)
                filled += one_of and given is not None
                out[name] = read(given, messages)
            if levels and filled != 1:
                messages.append(f"{path}: exactement un")
            return out

    elif isinstance(kind, T.ArrayType):
        element, expected = _reader(kind.elementType, path + "[]", True, None, commas), list

        def inner(v: list, messages: list[str]) -> list:
            return [element(x, messages) for x in v]

    elif isinstance(kind, T.MapType):
        value, expected = _reader(kind.valueType, path + ".*", False, None, commas), dict

        def inner(v: dict, messages: list[str]) -> dict:
            return {k: value(x, messages) for k, x in v.items()}

    else:
        inner, expected = _scalar_reader(kind, path, domain, commas), object

    def read(v: object, messages: list[str]) -> object:
        if v is None:
            if required:
                messages.append(f"{path}: absent")
            return None
        if not isinstance(v, expected):
            messages.append(f"{path}: type")
            return None
        return inner(v, messages)

    return read


def _no_constant(name: str) -> float:
    raise ValueError(name)


def _without_nulls(v: object, kind: T.DataType) -> object:
    """A record without its null fields; null values of maps and null elements stay."""
    if isinstance(v, dict) and isinstance(kind, T.StructType):
        return {f.name: _without_nulls(v[f.name], f.dataType) for f in kind.fields if v[f.name] is not None}
    if isinstance(v, list):
        return [_without_nulls(x, kind.elementType) for x in v]
    return v


def _records(schema: T.StructType, commas: bool, nulls: bool):
    """Arrow batches of JSON texts -> struct(erreurs, json). One pass of plain Python over each document: the rules of a
    nested record as column expressions are thousands of interpreted nodes, many times slower."""
    read = _reader(schema, "$", True, None, commas)

    @F.pandas_udf("erreurs array<string>, json string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                doc = json.loads(text, parse_constant=_no_constant)
            except (ValueError, TypeError, RecursionError):
                doc = None
            if not isinstance(doc, dict):
                rows.append((["json"], None))
                continue
            messages: list[str] = []
            value = read(doc, messages)
            rows.append((list(dict.fromkeys(messages)), json.dumps(value if nulls else _without_nulls(value, schema), ensure_ascii=False)))
        return pd.DataFrame(rows, columns=["erreurs", "json"])

    return run


def payload_check(raw: Column, schema: T.StructType = PAYLOAD, commas: bool = False, nulls: bool = False) -> Column:
    """struct(erreurs, json): what is wrong with a whole record against the declared schema, arrays and maps included (empty if it
    is accepted), and the record as JSON under its declared (alias) names, with numbers as numbers and without unknown keys.

    Checked are types, required fields, domains and the one level of a distribution item. Unknown keys are no fault. A text that isn't
    a JSON object has the one error ``json`` and no record; what can't be read is null in the record. With ``commas``, commas of texts are
    read as points and their ends stripped. With ``nulls`` null fields are written, else only null values of maps.
    """
    return _records(schema, commas, nulls)(raw)


def payload_errors(raw: Column, schema: T.StructType = PAYLOAD, commas: bool = False) -> Column:
    return payload_check(raw, schema, commas)["erreurs"]


def payload_json(raw: Column, schema: T.StructType = PAYLOAD, commas: bool = False, nulls: bool = False) -> Column:
    return payload_check(raw, schema, commas, nulls)["json"]


def payload_value(raw: Column, schema: T.StructType = PAYLOAD, commas: bool = False) -> Column:
    """The record as a struct of the declared schema."""
    return F.from_json(payload_json(raw, schema, commas, True), schema)


def canonical_json(raw: Column) -> Column:
    """A JSON text with sorted keys and without layout, so that equal records are equal texts; null for no JSON."""
    return F.to_json(F.try_parse_json(raw))


def record_hash(raw: Column) -> Column:
    """SHA-256 of a record whatever the order of its keys; null for no JSON."""
    return F.sha2(canonical_json(raw), 256)


def holds_something(raw: Column) -> Column:
    """Whether a record is a JSON object with at least one key; an empty one is not taken in."""
    return F.coalesce(F.size(F.json_object_keys(raw)) > 0, F.lit(False))


def section_messages(sections: dict[str, tuple[Column, Column]]) -> Column:
    """Messages on sections: name -> (is missing, is present but empty)."""
    return F.array_compact(F.array(*(F.when(gone, F.lit(f"{n} : absente")).when(empty, F.lit(f"{n} : vide")) for n, (gone, empty) in sections.items())))


# --- target headers ------------------------------------------------------------------------------------------------------


def align_to_headers(df: DataFrame, headers: list[str], last_duplicate_only: bool = False) -> DataFrame:
    """One text column ``c<k>`` per header: the cell of the column with the header's stripped name, else empty.

    Of a repeated header every column is filled, or with ``last_duplicate_only`` only the last one.
    """
    if not headers:
        raise ValueError("the target has no header")
    names = [h.strip() for h in headers]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    filled = [n in kinds and (not last_duplicate_only or n not in names[k + 1 :]) for k, n in enumerate(names)]
    return df.select(*((cell(F.col(f"`{n}`"), kinds[n]) if yes else F.lit("")).alias(f"c{k}") for k, (n, yes) in enumerate(zip(names, filled, strict=True))))


def key_differences(keys: Column, headers: Column) -> tuple[Column, Column]:
    """(keys without a column, columns without a value), each sorted."""
    return F.array_sort(F.array_except(keys, headers)), F.array_sort(F.array_except(headers, keys))


def new_payloads(df: DataFrame, ledger: DataFrame, key: str = "hash") -> DataFrame:
    """Rows whose key the ledger doesn't have. Null keys are new."""
    return df.join(ledger.select(key).distinct(), key, "left_anti")
