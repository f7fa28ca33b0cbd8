"""Queries pN_... of the llm problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import formatting_copies as fc
from papyrine.llm import leaked_items, mixing, pii, reference_list, scan_noise, shared_spans, splitting
from papyrine.operators.dedup import latest_by_key

LISTS = ("points_forts", "suggestions_complement_sur_formation", "elements_les_plus_utiles")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return fc.formatting_copies(table(spark, sf, "avis_brut"), "avis_id", "contenu", "session", LISTS)


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fc.copy_counts(p1_found(spark, sf))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items.leaked_items(table(spark, sf, "documents"), table(spark, sf, "items_evaluation"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("n_fenetres_egales > 0 and mots_passage = 12").select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item whole or nearly so, with the similarity of the best window of its length."""
    return _leaks(spark, sf).where(F.col("similarite") >= leaked_items.SIMILAR).select("doc_id", "item_id", F.round("similarite", 6).alias("similarite"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each leaked item stands in."""
    return p8_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.shared_runs(table(spark, sf, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.sharing_pairs(_shared(spark, sf))


def p10_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of p10_found in compact form: the sets of documents that share a span, one row per member."""
    return shared_spans.sharing_sets(_shared(spark, sf))


def p10_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where the shared spans stand and in how many documents."""
    return shared_spans.shared_spans(_shared(spark, sf))


def p10_shared_part(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return shared_spans.shared_part(_shared(spark, sf), docs, "doc_id", "text")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    reports = latest_by_key(table(spark, sf, "report_text").select("report_id", "pages", "full_text", "ingere_le"), ["report_id"], ["ingere_le"])
    return splitting.split_texts(reports, "report_id", "full_text", "pages").withColumnRenamed("id", "report_id")


def p3_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each report add up to: without their overlaps the text again, none too long, no overlap too large, and
    each overlap the end of the piece before."""
    pieces = p3_pieces(spark, sf)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rang", "texte", "chevauchement"))), lambda x: F.substring(x["texte"], x["chevauchement"] + 1, F.length(x["texte"]))), "")
    listed = F.array_sort(F.collect_list(F.struct("rang", "texte", "chevauchement")))
    follows = F.forall(F.sequence(F.lit(1), F.greatest(F.size(listed) - 1, F.lit(1))), lambda i: (i >= F.size(listed)) | F.coalesce(F.endswith(F.get(listed, i - 1)["texte"], F.left(F.get(listed, i)["texte"], F.get(listed, i)["chevauchement"])), F.lit(False)))
    return pieces.groupBy("report_id").agg(
        F.sha2(text, 256).alias("hash"), (F.count("*") > 1).alias("coupe"), (F.max(F.length("texte")) <= 6000).alias("assez_courts"), (F.max("chevauchement") <= 300).alias("chevauchements_bornes"), follows.alias("reprises"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The reports that were cut. A report delivered twice is the same report, so ids are made distinct at the end."""
    pieces = splitting.split_texts(table(spark, sf, "report_text"), "report_id", "full_text", "pages")
    return pieces.where("n_morceaux > 1").select(F.col("id").alias("report_id")).distinct()


def _personal(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "verbatims").select("verbatim_id", "texte", "ingere_le")
    return pii.personal_data(latest_by_key(rows, ["verbatim_id"], ["ingere_le"]), "verbatim_id", "texte").withColumnRenamed("id", "verbatim_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("verbatim_id", F.inline("donnees")).select("verbatim_id", "genre", "debut")


def p4_masked(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("verbatim_id", "texte_masque", F.size("donnees").alias("n_donnees"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "payload_v2").select("payload_id", "ingere_le", "nom_formation", F.col("a_chaud.satisfaction_contenu.label").alias("labels"))
    rows = latest_by_key(rows, ["payload_id"], ["ingere_le"])
    one = F.struct(F.lit("nom_formation").alias("champ"), F.lit(0).alias("rang"), F.col("nom_formation").alias("valeur"))
    many = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("label").alias("champ"), i.alias("rang"), x.alias("valeur")))
    typed = rows.select("payload_id", F.inline(F.concat(F.array(one), many)))
    return reference_list.map_to_reference(typed, table(spark, sf, "referentiel"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("payload_id", "champ", "rang", "ref_id")


def p5_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry within the distance a value's length allows, not the nearest only."""
    return _mapped(spark, sf).select("payload_id", "champ", "rang", F.inline("candidats"))


def p5_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return reference_list.unmatched(_mapped(spark, sf))


CONTEXT = ("organisme", "nom_formation", "semestre")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """A report delivered twice has the same lines twice, so rows are made distinct at the end."""
    lines = scan_noise.noise_lines(table(spark, sf, "report_text"), "report_id", "full_text", "pages", CONTEXT)
    return lines.select(F.col("id").alias("report_id"), "ligne", "genre").distinct()


def p6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    reports = latest_by_key(table(spark, sf, "report_text").select("report_id", "full_text", "pages", "ingere_le", *CONTEXT), ["report_id"], ["ingere_le"])
    return scan_noise.repaired_texts(reports, "report_id", "full_text", "pages", CONTEXT).withColumnRenamed("id", "report_id")


def _mix(spark: SparkSession, sf: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "cibles_sources"), "doc_id", "source", "text", whole=whole)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p9_whole_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix as large as the corpus, where sources run out."""
    return _mix(spark, sf, whole=True)[0]


def p9_whole_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf, whole=True)[1]


def p9_checked(spark: SparkSession, sf: str) -> DataFrame:
    """For each target of both mixes: the tokens reached are those aimed at, but for one document, or all there are as often as allowed;
    no document is used more often than allowed, and none is chosen twice."""
    caps = table(spark, sf, "cibles_sources").select("source", "repetitions_max")
    told = []
    for whole in (False, True):
        chosen, shares = _mix(spark, sf, whole)
        used = chosen.groupBy("source").agg(F.max("repetitions").alias("most"), F.max("n_tokens").alias("largest"), (F.count("*") == F.countDistinct("doc_id")).alias("once"))
        rows = shares.join(caps, "source").join(used, "source", "left")
        out = F.col("n_tokens") == F.col("n_disponibles") * F.col("repetitions_max")
        near = F.abs(F.col("n_tokens") - F.col("n_vises")) <= F.coalesce("largest", F.lit(0)) + 1
        told.append(rows.select("source", F.lit(whole).alias("entier"), (out | near).alias("tient"), F.coalesce(F.col("most") <= F.col("repetitions_max"), F.lit(True)).alias("plafond_tenu"), F.coalesce("once", F.lit(True)).alias("sans_doublon")))
    return told[0].unionByName(told[1])


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_pieces, p3_checked, p4_found, p4_masked, p5_found, p5_candidates, p5_unmatched, p6_found, p6_repaired, p9_mix, p9_shares, p9_whole_mix, p9_whole_shares, p9_checked, p8_found, p8_near, p8_items, p10_found, p10_sets, p10_spans, p10_shared_part)}


def _folded(name: str) -> str:
    return f"list_transform(list_filter(coalesce(from_json(json_extract(contenu, '$.{name}'), '[\"VARCHAR\"]'), []), lambda x: x is not null), lambda x: regexp_replace(lower(x), '[\\s\\p{{Z}}\\p{{P}}\\p{{Cc}}\\p{{Cf}}]', '', 'g'))"


_COPIES = f"select min(avis_id) over (partition by json_extract_string(contenu, '$.session'), {', '.join(map(_folded, LISTS))}) as garde_id, avis_id as copie_id from avis_brut"
_WORDS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "select {id}, array_to_string(w[i:i + 11], ' ') as g from (select {id}, w, unnest(range(1, len(w) - 10)) as i from (select {id}, {words} as w from {table}))"
_LEAKS = f"""select distinct doc_id, item_id from ({_GRAMS.format(id='doc_id', words=_WORDS.format('text'), table='documents')}) join
  ({_GRAMS.format(id='item_id', words=_WORDS.format('texte'), table='items_evaluation')}) using (g)"""
_WINDOWS = """w as (select doc_id, i, substr(text, i, 250) as t from (select doc_id, text, unnest(range(1, length(text) - 248)) as i from documents where length(text) >= 250)),
  g as (select t from w group by t having min(doc_id) < max(doc_id)), s as (select w.* from w semi join g using (t))"""
ORACLES: dict[str, str] = {
    "p1_found": f"select * from ({_COPIES}) where garde_id < copie_id",
    "p1_counts": f"select garde_id, count(*) as n_exemplaires from ({_COPIES}) group by garde_id having count(*) > 1",
    "p3_found": "select distinct report_id from report_text where length(full_text) > 6000",
    "p3_checked": """select report_id, sha256(full_text) as hash, length(full_text) > 6000 as coupe, true as assez_courts, true as chevauchements_bornes, true as reprises
  from (select *, row_number() over (partition by report_id order by ingere_le desc nulls last) as k from report_text) where k = 1 and full_text is not null""",
    "p9_checked": "select source, entier, true as tient, true as plafond_tenu, true as sans_doublon from cibles_sources, (values (false), (true)) as t(entier)",
    "p8_found": _LEAKS,
    "p8_items": f"select item_id, count(*) as n_documents from ({_LEAKS}) group by item_id",
    "p10_found": f"with {_WINDOWS} select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from s a join s b on a.t = b.t and a.doc_id < b.doc_id",
    "p10_spans": f"""with {_WINDOWS}, x as (select distinct doc_id, i, docs from s join (select t, list_sort(list(distinct doc_id)) as docs from s group by t) using (t)),
  y as (select *, case when lag(i) over o = i - 1 and lag(docs) over o = docs then 0 else 1 end as neu from x window o as (partition by doc_id order by i)), z as (select *, sum(neu) over (partition by doc_id order by i) as k from y)
  select doc_id, min(i) - 1 as debut, max(i) + 249 as fin, any_value(len(docs)) as n_textes from z group by doc_id, k""",
    "p10_shared_part": f"""with {_WINDOWS}, c as (select doc_id, sum(least(250, coalesce(suivant - i, 250))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as suivant from (select distinct doc_id, i from s)) group by doc_id)
  select doc_id, length(text) as n_caracteres, cast(coalesce(n, 0) as bigint) as n_partages, case when length(text) > 0 then coalesce(n, 0) / length(text)::double else 0.0 end as part_partagee from documents left join c using (doc_id)""",
}
