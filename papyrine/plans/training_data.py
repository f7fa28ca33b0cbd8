"""Queries p2_... and p7_... (nested records, drifting schemas), over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.operators import drift, nested
from papyrine.operators.dedup import latest_by_key
from papyrine.schema import COLD, HOT, PAYLOAD, PRE, TRAINERS, D, S as TEXT, struct

PATHS = {
    "distribution": "pre_formation.souhaitez_vous_suivre_distribution",
    "satisfaction": "a_chaud.satisfaction_contenu",
    "objectifs": "a_chaud.maitrise_objectifs_a_chaud.par_objectif",
}


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["payload_id", "ingere_le", "pre_formation", "a_chaud", "a_froid"]
    return latest_by_key(spark.read.parquet(f"{sf}/payload_v2.parquet").select(*columns), ["payload_id"], ["ingere_le"]).drop("ingere_le")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.nodes(_payloads(spark, sf), "payload_id", list(PATHS.values())).select("payload_id", "tableau", "rang")


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dewey", F.array_join("dewey", ".")).withColumn("parent", F.array_join("parent", "."))


def p2_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every element of every array of the sections, with its label and its parent's."""
    return _as_text(nested.nodes(_payloads(spark, sf), "payload_id"))


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """The table of the payloads themselves, to which all others are related."""
    rows = latest_by_key(spark.read.parquet(f"{sf}/payload_v2.parquet"), ["payload_id"], ["ingere_le"])
    return nested.record_table(rows.drop("ingere_le", "extrait_le"), "payload_id")


def _flat(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _as_text(nested.flat_table(_payloads(spark, sf), "payload_id", PATHS[name]))

    query.__name__ = f"p2_{name}"
    return query


S = drift.SEP
DECLARED = {
    "version_prompt": ("", "version_prompt"),
    "nb_votants": (S + "pre_formation" + S + "souhaitez_vous_suivre_distribution" + S + drift.EACH, "nb_votants"),
    "retards_apprenants": (S + "intervenants", "retards_apprenants"),
}


def _followed(spark: SparkSession, sf: str) -> DataFrame:
    return drift.follow_schemas(drift.file_facts(spark.read.parquet(f"{sf}/payload_raw.parquet"), "flux", "rang_fichier", "contenu"), PAYLOAD, DECLARED)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _followed(spark, sf).where("changement <> 'place'").select("flux", F.col("rang").alias("rang_fichier"), "champ", "changement")


def _version(text: Column) -> Column:
    parts = F.from_json(text, "majeure int, mineure int")
    number = F.regexp_extract(text, r"^\s*v?(\d+(?:\.\d+)*)\s*$", 1)
    return F.when(text.startswith("{"), F.concat(F.lit("v"), parts["majeure"], F.lit("."), parts["mineure"])).when(number != "", F.concat(F.lit("v"), number)).otherwise(text)


def _count(text: Column) -> Column:
    return F.when(text.startswith("{"), F.get_json_object(text, "$.valeur").cast("int")).otherwise(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"))


def _answer(text: Column, which: str) -> Column:
    told = F.filter(F.from_json(text, "array<struct<reponse:string,nombre:double>>"), lambda x: F.lower(F.trim(x["reponse"])) == which)
    plain = F.regexp_extract(text, rf"(?i)(\d+(?:\.\d+)?)\s*{which}", 1).try_cast("double")
    bare = text.try_cast("double") if which == "oui" else F.lit(None).cast("double")
    return F.when(text.startswith("{"), F.get_json_object(text, f"$.{which}").try_cast("double")).when(text.startswith("["), F.try_element_at(told, F.lit(1))["nombre"]).otherwise(F.coalesce(bare, plain))


def p7_table(spark: SparkSession, sf: str) -> DataFrame:
    """All files as one table with the declared names and types; a record delivered twice is one."""
    raw = latest_by_key(spark.read.parquet(f"{sf}/payload_raw.parquet"), ["raw_id"], ["depose_le"])
    places = _followed(spark, sf).where("changement = 'place'")
    place = {c: F.max(F.when(F.col("champ") == c, F.struct("avant", "apres"))) for c in DECLARED}
    by_file = places.groupBy("flux", F.col("rang").alias("rang_fichier")).agg(*(v.alias("_" + c) for c, v in place.items()))
    rows = raw.join(by_file, ["flux", "rang_fichier"], "left")
    version = drift.value_at(F.col("contenu"), F.col("_version_prompt.avant"), F.col("_version_prompt.apres"))
    late = drift.value_at(F.col("contenu"), F.col("_retards_apprenants.avant"), F.col("_retards_apprenants.apres"))
    votes = drift.items_at(F.col("contenu"), F.col("_nb_votants.avant"), F.col("_nb_votants.apres"))
    return rows.select(
        "raw_id", "flux", "rang_fichier", _version(version).alias("version_prompt"), F.transform(votes, _count).alias("nb_votants"),
        _answer(late, "oui").alias("retards_oui"), _answer(late, "non").alias("retards_non"),
    )


QUERIES = {"p2_found": p2_found, "p2_nodes": p2_nodes, "p2_records": p2_records, **{f"p2_{n}": _flat(n) for n in PATHS}, "p7_found": p7_found, "p7_table": p7_table}

_LATEST = "p as (select * from (select *, row_number() over (partition by payload_id order by ingere_le desc nulls last) rn from payload_v2) where rn = 1)"


def _unnested(section: str, name: str) -> str:
    # An alias with a name of its own: a struct of the table may be named like a column
    return f"(select payload_id, unnest({section}) as e, generate_subscripts({section}, 1) - 1 as rang from p)"


def _in_tables(kind: T.DataType) -> T.DataType:
    """A declared type as the payload table has it: no blanks in names, yes/no maps as structs."""
    if isinstance(kind, T.MapType):
        return struct(oui=D, non=D)
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_in_tables(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name.replace(" ", "_"), _in_tables(f.dataType)) for f in kind.fields])
    return kind


def _leaves(kind: T.DataType, path: str) -> list[str]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return [] if isinstance(kind, T.ArrayType) else [path]


_SECTIONS = _in_tables(struct(pre_formation=PRE, a_chaud=HOT, a_froid=COLD))
_PLAIN = struct(session_code=TEXT, organisme=TEXT, version_prompt=TEXT, nom_formation=TEXT, semestre=TEXT, graphique_non_lisible=TEXT, lien_vers_formation=TEXT)
_RECORD = T.StructType([*_PLAIN.fields, *_SECTIONS.fields, *_in_tables(struct(intervenants=TRAINERS, resultats_evaluations=struct(progression_competences_plus_sur_10=D))).fields])


def _label(path: str) -> str:
    kind, out = _SECTIONS, []
    for step in path.split("."):
        out.append(str(kind.fieldNames().index(step) + 1))
        kind = kind[step].dataType
    return ".".join(out)


ORACLES = {
    "p2_records": f"with {_LATEST} select payload_id, " + ", ".join(f"{x} as {x.replace('.', '_')}" for x in _leaves(_RECORD, "")) + " from p",
    "p2_nodes": f"with {_LATEST} " + " union all ".join(
        f"select payload_id, '{x.name}' as tableau, '{x.path}' as chemin, '{_label(x.path)}.' || rang as dewey, '' as parent, cast(rang as integer) as rang from {_unnested(x.path, '')} where e is not null" for x in nested.array_paths(_SECTIONS)),
    "p2_found": f"with {_LATEST} " + " union all ".join(f"select payload_id, '{path.rsplit('.', 1)[1]}' as tableau, cast(rang as integer) as rang from {_unnested(path, '')} where e is not null" for path in PATHS.values()),
    "p2_distribution": f"with {_LATEST} select payload_id, '1.2.' || rang as dewey, '' as parent, cast(rang as integer) as rang, e.* from {_unnested(PATHS['distribution'], '')} where e is not null",
    "p2_satisfaction": f"with {_LATEST} select payload_id, '2.2.' || rang as dewey, '' as parent, cast(rang as integer) as rang, e.* from {_unnested(PATHS['satisfaction'], '')} where e is not null",
    "p2_objectifs": f"with {_LATEST} select payload_id, '2.8.2.' || rang as dewey, '' as parent, cast(rang as integer) as rang, e.objectif_label as objectif_label, e.levels.totalement as levels_totalement, e.levels.en_partie as levels_en_partie, e.levels.insuffisamment as levels_insuffisamment, e.levels.pas_du_tout as levels_pas_du_tout, e.note_sur_10 as note_sur_10 from {_unnested(PATHS['objectifs'], '')} where e is not null",
}
