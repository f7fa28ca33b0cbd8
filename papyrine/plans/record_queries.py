"""Queries q44 to q51: records from the text of reports and from a model's responses, repaired, checked and hashed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import extraction, narrative, records
from papyrine.operators.dedup import latest_by_key
from papyrine.plans.report_queries import _FOLD, _HIST, _REPORT_LINES, WS, query, table

_FOLDED = f"trim(regexp_replace({_FOLD.replace('regexp_replace(ligne,', 'regexp_replace(trim(ligne),')}, '[^\\p{{L}}\\p{{N}}/]+', ' ', 'g'))"


def _near_sql(known: list[str]) -> str:
    """The known text a folded line spells, the nearest first."""
    told = []
    for i, k in enumerate(known):
        b = " ".join("".join(c if c.isalnum() or c == "/" else " " for c in k).split())
        far = f" when abs(length(f) - {len(b)}) <= {extraction.MISSPELLED} and levenshtein(f, '{b}') <= {extraction.MISSPELLED} then {{'d': levenshtein(f, '{b}'), 'i': {i}, 'k': '{k}'}}" if len(b) >= 8 and not any(map(str.isdigit, b)) else ""
        told.append(f"case when f = '{b}' then {{'d': 0, 'i': {i}, 'k': '{k}'}}{far} end")
    return f"list_sort(list_filter([{', '.join(told)}], lambda x: x is not null))[1].k"


_SECTION_SQL = "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in extraction.TITLES.items()) + " end"
_RESULT_TITLES = ", ".join(f"'{k}'" for k, v in extraction.TITLES.items() if v == "resultats_evaluations")
_ANSWER_SQL = f"""with a as (select report_id, pos, ligne, {_FOLDED} as f from {_REPORT_LINES} where length(trim(ligne)) > 0),
  b as (select *, {_near_sql(list(extraction.TITLES))} as titre, {_near_sql([q.text for q in extraction.QUESTIONS])} as d0 from a), c as (select *, case when titre is null then d0 end as demande from b),
  d as (select *, count(titre) over (partition by report_id order by pos) as b from c), e as (select *, sum(case when titre is null then length(trim(ligne)) else 0 end) over (partition by report_id, b) as size from d),
  g as (select *, case when size >= {extraction.LEAST_BLOCK} then titre end as opens from e),
  h as (select *, case when opens in ({_RESULT_TITLES}) then 'progression des competences' when opens is not null then '' else demande end as heading from g),
  j as (select *, last_value(opens ignore nulls) over w as t, nullif(last_value(heading ignore nulls) over w, '') as question from h window w as (partition by report_id order by pos rows between unbounded preceding and current row)),
  answers as (select report_id, pos, ligne, {_SECTION_SQL} as bloc, question from j where titre is null and demande is null)"""


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "report_text").select("report_id", "full_text").distinct()


@query(f"{_ANSWER_SQL} select report_id, bloc, question, count(*) as n_lignes, min(pos) as debut, max(pos) as fin from answers where question is not null group by all")
def q44_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Which lines of a report answer which question of which block."""
    rows = extraction.answers(_reports(spark, sf), "report_id", "full_text").where("question is not null")
    return rows.groupBy("report_id", "bloc", "question").agg(F.count("*").alias("n_lignes"), F.min("pos").alias("debut"), F.max("pos").alias("fin"))


_CHART = extraction.QUESTIONS[0].text
_LEVELS = range(5, 0, -1)
_VOTES_SQL, _PARTS_SQL = (" + ".join(f"coalesce({x}{n}, 0)" for n in _LEVELS) for x in "vp")


@query(f"""{_ANSWER_SQL}, k as (select report_id, bloc, pos, cast(nullif(regexp_extract(ligne, '{_HIST}', 1), '') as integer) as niveau, cast(nullif(regexp_extract(ligne, '{_HIST}', 2), '') as integer) as v, cast(replace(nullif(regexp_extract(ligne, '{_HIST}', 3), ''), ',', '.') as double) as p,
  cast(nullif(regexp_extract(ligne, '([0-9]+){WS}+votant', 1), '') as bigint) as total from answers where question = '{_CHART}'),
  l as (select report_id, bloc, arg_min(total, pos) filter (total is not null) as votants_total, {', '.join(f"arg_max(v, pos) filter (niveau = {n}) as v{n}, arg_max(p, pos) filter (niveau = {n}) as p{n}" for n in _LEVELS)} from k group by all)
  select report_id, bloc, votants_total, cast({_VOTES_SQL} as bigint) as votants, coalesce({_VOTES_SQL} = votants_total and {_PARTS_SQL} between 99 and 101, false) as lisible from l""")
def q45_charts(spark: SparkSession, sf: str) -> DataFrame:
    """The chart of levels of each block, checked against the total printed below it."""
    read = extraction.readings(_reports(spark, sf), "report_id", "full_text").where(F.col("question") == _CHART)
    votes = F.aggregate("echelons", F.lit(0).cast("bigint"), lambda a, x: a + x["votants"])
    return read.select("report_id", "bloc", "votants_total", votes.alias("votants"), extraction.chart_is_readable(F.col("echelons"), F.col("votants_total")).alias("lisible"))


@query()
def q46_records_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """Reports as records in the declared layout, with what is wrong with each."""
    reports = latest_by_key(table(spark, sf, "report_text").select("report_id", "full_text", "nom_formation", "semestre", "filename", "ingere_le"), ["report_id"], ["ingere_le"])
    made = extraction.records_from_text(reports, "report_id", "full_text", F.col("nom_formation"), F.col("semestre"), F.col("filename"))
    return made.select("report_id", "json", F.array_join(records.payload_errors(F.col("json")), "|").alias("erreurs"))


_NAMES = ("Totalement", "En partie", "Insuffisamment", "Pas du tout")


@query("select p_partkey, " + ", ".join(f"case when p_partkey % {k + 2} <> 0 then {('p_size', 'p_size / 2.0::double')[k % 2]} end::double as {f}" for k, f in enumerate(extraction.FOUR_LEVELS.values())) + " from part")
def q47_four_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of four levels where some are missing."""
    half = F.replace((F.col("p_size") / 2.0).cast("string"), F.lit("."), F.lit(","))
    part = lambda k: F.when(F.col("p_partkey") % (k + 2) != 0, F.concat(F.lit(_NAMES[k] + " : "), half if k % 2 else F.col("p_size").cast("string"), F.lit(" %")))
    return table(spark, sf, "part").select("p_partkey", F.inline(F.array(extraction.four_levels(F.concat_ws("\n", *(part(k) for k in range(4)))))))


_COUNTED = "select user_id, count(*) as n, sum(count(*)) over (partition by user_id) as total, event_type from events group by user_id, event_type"
_EVENT_LEVEL = "case event_type when 'click' then '5' when 'view' then '4' when 'signup' then '3' when 'purchase' then '2' else '1' end"
_SPELLED = ("Satisfait-e", "Déçu-e", "Sans opinion", "Tres satisfait(e)")
_MEANT = ("Satisfait(e)", "Déçu(e)", "Sans opinion", "Très satisfait(e)")


@query(f"""select user_id, user_id % 2 = 0 as etait_v2, case user_id % 4 {' '.join(f"when {k} then '{v}'" for k, v in enumerate(_MEANT))} end as libelle, niveau,
  cast(case when niveau = '3' then 12.5 else cast(format('{{:.1f}}', (n::double / total) * 100) as double) end as double) as pourcentage from (select *, {_EVENT_LEVEL} as niveau from ({_COUNTED}))""")
def q48_repaired_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records in the legacy (odd users) and the current layout with spelled labels, and percentages given for level 3 only."""
    level = F.create_map(*[F.lit(x) for kv in (("click", "5"), ("view", "4"), ("signup", "3"), ("purchase", "2")) for x in kv])
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("niveau", F.coalesce(F.try_element_at(level, F.col("event_type")), F.lit("1")))
    given = lambda x: F.when(F.col("niveau") == "3", F.lit(x)).otherwise(F.lit("null"))
    n = F.col("n").cast("string")
    legacy = F.concat(F.lit('{"label":"'), F.col("niveau"), F.lit('","count":'), n, F.lit(',"percent":'), given('"12,5 %"'), F.lit("}"))
    current = F.concat(F.lit('{"echele '), F.col("niveau"), F.lit('":"'), n, F.lit(' votants","pourcentage":'), given("12.5"), F.lit("}"))
    joined = counts.groupBy("user_id").agg(F.array_join(F.collect_list(legacy), ",").alias("old"), F.array_join(F.collect_list(current), ",").alias("new"), F.sum("n").cast("string").alias("total"))
    label = F.element_at(F.array(*(F.lit(x) for x in _SPELLED)), (F.col("user_id") % 4 + 1).cast("int"))
    hot = F.concat(F.lit(']},"a_chaud":{"satisfaction_contenu":[{"label":"'), label, F.lit('"}]}}'))
    raw = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"pre_formation":{"volonte_suivi_formation":{"nb votants":'), "total", F.lit('},"souhaitez_vous_suivre_distribution":['), "new", hot)).otherwise(
        F.concat(F.lit('{"pre_formation":{"souhaitez_vous_suivre":{"votants":'), "total", F.lit('},"souhaitez_vous_suivre_distribution":['), "old", hot))
    out = records.legacy_to_current(joined.select("user_id", raw.alias("raw")), "raw")
    items = F.from_json(F.get_json_object("v2", "$.pre_formation.souhaitez_vous_suivre_distribution"), "array<map<string,string>>")
    rows = out.select("user_id", "etait_v2", F.get_json_object("v2", "$.a_chaud.satisfaction_contenu[0].label").alias("libelle"), F.explode(items).alias("d"))
    key = F.try_element_at(F.filter(F.map_keys("d"), lambda k: k.startswith("echele ")), F.lit(1))
    rows = rows.select("user_id", "etait_v2", "libelle", F.substring(key, 8, 1).alias("niveau"), F.try_element_at("d", key).alias("texte"), F.try_element_at("d", F.lit("pourcentage")).cast("double").alias("pourcentage"))
    return rows.where("texte is not null").drop("texte")


#: What is put into a record, and what is wrong with it then.
_FAULTS = (
    ("", ""), ('"Nom formation":null,', "$.Nom formation: absent"), ('"a_froid":[1],', "$.a_froid: type"), ('"a_froid":{"note_sur_10":"8.5"},', ""), ('"a_froid":{"note_sur_10":"8,5"},', "$.a_froid.note_sur_10: type"),
    ('"a_chaud":{"satisfaction_contenu":[{"label":"Ravi"},{"label":"Satisfait(e)","count":"x"}]},', "$.a_chaud.satisfaction_contenu[].count: type|$.a_chaud.satisfaction_contenu[].label: domaine"),
    ('"pre_formation":{"souhaitez_vous_suivre_distribution":[{"echele 5":"1","echele_4":"2"}]},', "$.pre_formation.souhaitez_vous_suivre_distribution[]: exactement un"),
    ('"pre_formation":{"volonte_suivi_formation":{"nb votants":17.5}},', "$.pre_formation.volonte_suivi_formation.nb votants: type"), ('"intervenants":{"retards_apprenants":{"oui":true,"non":null}},', ""),
    ('"a_chaud":{"maitrise_objectifs_a_chaud":{"mode":"5_niveaux","par_objectif":[{"note_sur_10":1}]}},', "$.a_chaud.maitrise_objectifs_a_chaud.mode: domaine|$.a_chaud.maitrise_objectifs_a_chaud.par_objectif[].objectif_label: absent"),
)


@query(f"select event_id, case event_id % {len(_FAULTS)} " + " ".join(f"when {k} then '{v}'" for k, (_, v) in enumerate(_FAULTS)) + " end as erreurs from events")
def q49_whole_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Whole records with a fault of every kind against the declared schema."""
    fault = F.element_at(F.array(*(F.lit(x) for x, _ in _FAULTS)), (F.col("event_id") % len(_FAULTS) + 1).cast("int"))
    name = F.when(fault.contains("Nom formation"), F.lit("")).otherwise(F.lit('"Nom formation":"A",'))
    raw = F.concat(F.lit("{"), fault, name, F.lit('" semestre":"S1","lien_vers_formation":"x","inconnu":[1]}'))
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(records.payload_errors(raw)), "|").alias("erreurs"))


@query("""select event_id, case when event_id % 4 = 3 then 'json' else '' end as erreurs, case when event_id % 4 <> 3 then 'A.B ' || event_id end as nom, case when event_id % 4 <> 3 then (event_id % 100) / 10.0::double end as note from events""")
def q50_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of a model with text around the JSON and decimal commas, as typed records; every fourth has no JSON."""
    note = F.replace((F.col("event_id") % 100 / 10.0).cast("string"), F.lit("."), F.lit(","))
    body = F.concat(F.lit('{"Nom formation": " A,B '), F.col("event_id").cast("string"), F.lit('", " semestre": "S1", "lien_vers_formation": "x", "a_froid": {"note_sur_10": "'), note, F.lit('"}}'))
    text = F.when(F.col("event_id") % 4 == 3, F.lit("désolé")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Voici : "), body, F.lit(" Fin."))).otherwise(body)
    read = narrative.records_of_responses(table(spark, sf, "events").select("event_id", text.alias("reponse")), "reponse")
    return read.select("event_id", F.array_join("erreurs", "|").alias("erreurs"), F.from_json("json", "map<string,string>")["Nom formation"].alias("nom"), F.get_json_object("json", "$.a_froid.note_sur_10").cast("double").alias("note"))


@query("select user_id, count(*) as n, count(distinct event_type) as n_types from events group by user_id")
def q51_key_sorted_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose keys come in two orders count once by their hash."""
    kind, user = F.concat(F.lit('"t":"'), F.col("event_type"), F.lit('"')), F.concat(F.lit('"u":'), F.col("user_id").cast("string"))
    raw = F.concat(F.lit("{"), F.when(F.col("event_id") % 2 == 0, F.concat(kind, F.lit(","), user)).otherwise(F.concat(user, F.lit(" , "), kind)), F.lit("}"))
    hashed = table(spark, sf, "events").select("user_id", records.record_hash(raw).alias("h"))
    return hashed.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_types"))
