"""Queries q.. over the relational tables and the payload tables, with their SQL.

The tables have few nulls, commas and scores, so some queries make the texts an operator reads from numeric columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import lists, scalar as fx
from papyrine.operators import indicators as ind
from papyrine.operators import narrative, records, text_blocks as tb
from papyrine.operators.dedup import latest_by_key
from papyrine.plans.report_row import report_rows, trainer_comment
from papyrine.schema import LABELS, OUTPUT_COLUMNS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _semester(ts: Column) -> Column:
    return F.concat(F.when(F.month(ts) <= 6, F.lit("S1 ")).otherwise(F.lit("S2 ")), F.year(ts).cast("string"))


# --- SQL pieces --------------------------------------------------------------------------------------------------------

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SEM = "case when month(o_orderdate) <= 6 then 'S1 ' else 'S2 ' end || year(o_orderdate)"
LATEST = "p as (select * from (select *, row_number() over (partition by payload_id order by ingere_le desc nulls last) rn from payload_v2) where rn = 1)"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_whole(x: str) -> str:
    return f"cast(round_even({x}, 0) as bigint)"


def s_note(x: str) -> str:
    return f"format('{{:.1f}}/10', {x})"


def s_float(x: str) -> str:
    return f"try_cast({s_strip(f'''replace(replace({x}, ',', '.'), '%', '')''')} as double)"


def s_willing(a: str, b: str, c: str, source: str, keys: str) -> str:
    """select keys, volonte from source, whose columns a, b, c are the shares."""
    return f"""select {keys}, (x + case when x >= y and x >= z then 100 - x - y - z else 0 end) || ' % favorables, '
      || (y + case when not (x >= y and x >= z) and y >= z then 100 - x - y - z else 0 end) || ' % neutre, '
      || (z + case when not (x >= y and x >= z) and not (y >= z) then 100 - x - y - z else 0 end) || ' % non favorables' as volonte
    from (select *, {s_whole(a)} as x, {s_whole(b)} as y, {s_whole(c)} as z from ({source}))"""


# --- A1, A2: willingness -------------------------------------------------------------------------------------------------

_BALLOTS = f"""select c_mktsegment as formation, {SEM} as semestre, left(o_orderpriority, 1) as niveau, count(*) as n
  from orders join customer on c_custkey = o_custkey group by all"""


@query(s_willing("p5 + p4", "p3", "p2 + p1", f"""select formation, semestre, {', '.join(f"100.0 * (coalesce(sum(n) filter (niveau = '{k}'), 0)::double / sum(n)) as p{k}" for k in '54321')}
  from ({_BALLOTS}) group by formation, semestre""", "formation, semestre"))
def q01_willingness(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ballots: priority is the level, segment the training, half-year the term. The flagship."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    ballots = table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).alias("niveau"))
    counts = (
        ballots.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("formation"), _semester(F.col("o_orderdate")).alias("semestre"))
        .agg(*(F.count(F.when(F.col("niveau") == k, 1)).alias(f"n{k}") for k in ind.LEVELS), F.count("*").alias("total"))
    )
    none = {k: F.lit(0.0) for k in ind.LEVELS}
    return counts.select("formation", "semestre", ind.willingness_from_levels(none, {k: F.col(f"n{k}") for k in ind.LEVELS}, F.col("total")).alias("volonte"))


_CUST_LEVELS = """select *, sum(n) over (partition by o_custkey) as total from (select o_custkey, left(o_orderpriority, 1) as niveau, count(*) as n from orders group by all)"""


@query(s_willing("p5 + p4", "p3", "p2 + p1", f"""select o_custkey, {', '.join(f"coalesce(max(case when niveau = '{k}' then p end), 0.0) as p{k}" for k in '54321')} from (
  select *, case when o_custkey % 2 = 1 then 100.0 * (n::double / total) else round_even(n * 1000.0 / total, 0) / 10 end as p from ({_CUST_LEVELS})) group by o_custkey""", "o_custkey"))
def q02_willingness_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The aggregation over a long table; odd customers have no percentages, so votes count."""
    rows = table(spark, sf, "orders").groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).alias("niveau")).agg(F.count("*").alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("o_custkey"))
    rows = rows.withColumn("total", total).withColumn("pct", F.when(F.col("o_custkey") % 2 == 1, F.lit(0.0)).otherwise(F.bround(F.col("votes") * 1000.0 / F.col("total"), 0) / 10)).withColumn("pos", F.lit(0))
    return ind.willingness_by(rows, ["o_custkey"], "niveau", "pct", "votes", "total", "pos")


def _lv(k: str, what: str) -> str:
    test = " and ".join([*(f"d.echele_{j} is null" for j in "54321" if j > k), f"d.echele_{k} is not null"])
    extra = " and d.nb_votants is not null" if what == "nb_votants" else ""
    return f"coalesce(list_filter(coalesce(pre_formation.souhaitez_vous_suivre_distribution, []), lambda d: d is not null and {test}{extra})[-1].{what}, 0)::double"


_LEVELS_SQL = ", ".join(f"{_lv(k, 'pourcentage')} as p{k}, {_lv(k, 'nb_votants')} as c{k}" for k in "54321")
_SHARES_SQL = ", ".join(f"case when p5 + p4 + p3 + p2 + p1 = 0 and total > 0 and c5 + c4 + c3 + c2 + c1 > 0 then 100.0 * (c{k} / total) else p{k} end as q{k}" for k in "54321")
_WILLING_SQL = s_willing("q5 + q4", "q3", "q2 + q1", f"select payload_id, {_SHARES_SQL} from l", "payload_id")
_WITH_LEVELS = f"with {LATEST}, l as (select payload_id, {_LEVELS_SQL}, coalesce(pre_formation.volonte_suivi_formation.nb_votants, 0)::double as total from p)"


@query(f"{_WITH_LEVELS} {_WILLING_SQL}")
def q02b_willingness_of_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The same indicator on the nested arrays of the payloads."""
    rows = latest_by_key(table(spark, sf, "payload_v2").select("payload_id", "ingere_le", "pre_formation"), ["payload_id"], ["ingere_le"])
    pre = F.col("pre_formation")
    return rows.select("payload_id", ind.willingness(pre["souhaitez_vous_suivre_distribution"], pre["volonte_suivi_formation"]["nb_votants"]).alias("volonte"))


@query(s_willing("f", "o", "p", """select c_custkey, coalesce(100.0 * count(*) filter (o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 0) as f,
  coalesce(100.0 * count(*) filter (o_orderstatus = 'O') / nullif(count(o_orderkey), 0), 0) as o, coalesce(100.0 * count(*) filter (o_orderstatus = 'P') / nullif(count(o_orderkey), 0), 0) as p
  from customer left join orders on o_custkey = c_custkey group by c_custkey""", "c_custkey"))
def q03_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    """Three shares per customer; customers without orders have three zeros."""
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(*(F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(s) for s in "FOP"), F.count("*").alias("n"))
    rows = table(spark, sf, "customer").select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    share = lambda s: F.coalesce(100.0 * F.col(s) / F.col("n"), F.lit(0.0))
    return rows.select("c_custkey", ind.willingness_text(share("F"), share("O"), share("P")).alias("volonte"))


# --- numbers and formats --------------------------------------------------------------------------------------------------

_TYPED = "case when event_id % 7 = 0 then 'n/a' else replace(cast(value as varchar), '.', ',') || ' %' end"


@query(f"select event_id, {s_float(_TYPED)} as valeur, coalesce({s_float(_TYPED)}, 0.0) as valeur_ou_0 from events")
def q04_lenient_numbers(spark: SparkSession, sf: str) -> DataFrame:
    typed = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit(" %")))
    return table(spark, sf, "events").select("event_id", fx.lenient_float(typed).alias("valeur"), fx.lenient_number(typed).alias("valeur_ou_0"))


def _mean_sql(path: str) -> str:
    notes = f"list_filter(list_transform({path}, lambda o: o.note_sur_10), lambda x: x is not null)"
    return f"case when len({notes}) > 0 then format('{{:.1f}}/10', list_reduce({notes}, lambda a, x: a + x) / len({notes})) end"


@query(f"with {LATEST} select payload_id, {_mean_sql('a_chaud.maitrise_objectifs_a_chaud.par_objectif')} as moyenne from p")
def q05_mean_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_by_key(table(spark, sf, "payload_v2").select("payload_id", "ingere_le", "a_chaud"), ["payload_id"], ["ingere_le"])
    return rows.select("payload_id", ind.mean_note(F.col("a_chaud.maitrise_objectifs_a_chaud.par_objectif")).alias("moyenne"))


@query("select l_orderkey, format('{:.1f}/10', sum(cast(round(l_discount * 100) as bigint)) / count(*)::double) as moyenne from lineitem group by l_orderkey")
def q05b_mean_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Integer sums, so the mean doesn't depend on the order of addition."""
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(fx.note(F.sum(cents).cast("double") / F.count("*")).alias("moyenne"))


@query(f"select p_partkey, {s_note('p_size / 5.0::double')} as note_taille, {s_note('p_retailprice % 10')} as note_prix, {s_note('-p_size / 8.0::double')} as note_negative from part")
def q06_format_note(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", fx.note(F.col("p_size") / 5.0).alias("note_taille"), fx.note(F.col("p_retailprice") % 10).alias("note_prix"), fx.note(-F.col("p_size") / 8.0).alias("note_negative"))


_POS = "('Très satisfait(e)', 'Satisfait(e)')"


def _sum_sql(field: str, happy: bool) -> str:
    test = f"i is not null and i.label in {_POS}" if happy else "i is not null"
    return f"coalesce(list_reduce(list_transform(list_filter(a_chaud.satisfaction_contenu, lambda i: {test}), lambda i: coalesce(i.{field}, 0.0)), lambda a, x: a + x, 0.0), 0.0)"


_SATISFACTION = f"""case when len(list_filter(a_chaud.satisfaction_contenu, lambda i: i is not null)) > 0 then
  case when {_sum_sql('count', False)} = 0 then {s_whole(_sum_sql('percent', True))} || ' %' else {s_whole(f"{_sum_sql('count', True)} / {_sum_sql('count', False)} * 100")} || ' %' end end"""


@query(f"with {LATEST} select payload_id, {_SATISFACTION} as satisfaction from p")
def q07_satisfaction(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_by_key(table(spark, sf, "payload_v2").select("payload_id", "ingere_le", "a_chaud"), ["payload_id"], ["ingere_le"])
    return rows.select("payload_id", ind.satisfaction(F.col("a_chaud.satisfaction_contenu")).alias("satisfaction"))


@query(f"select user_id, {s_whole('''sum(case when event_type in ('signup', 'purchase') then 1 else 0 end)::double / count(*) * 100''')} || ' %' as satisfaction from events group by user_id")
def q07b_satisfaction_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ind.satisfaction_by(table(spark, sf, "events"), ["user_id"], "event_type", ("signup", "purchase"))


@query("select o_custkey, format('{:.0f} %', count(*) filter (o_orderpriority like '5%') * 100.0 / count(*)) as profitable from orders group by o_custkey")
def q08_percent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(fx.percent_text(F.count(F.when(F.col("o_orderpriority").startswith("5"), 1)) * 100.0 / F.count("*")).alias("profitable"))


@query("select l_tax, l_quantity, '+' || regexp_replace(cast(round_even(cast(l_tax * l_quantity / 8 as varchar)::decimal(38,18), 2)::decimal(22,2) as varchar), '\\.?0+$', '') || '/10' as impact from (select distinct l_tax, l_quantity from lineitem)")
def q09_impact(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_tax", "l_quantity").distinct()
    return rows.select("l_tax", "l_quantity", fx.impact((F.col("l_tax") * F.col("l_quantity") / 8)).alias("impact"))


# --- comments ---------------------------------------------------------------------------------------------------------------

_NOISE = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in lists.NOISE) + ")"


def s_clean(x: str) -> str:
    t = s_strip(x)
    return f"case when not (lower({t}) in {_NOISE} or length({t}) <= 2) then nullif(trim(regexp_replace({t}, '{WS}+', ' ', 'g'), ' -–—·•'), '') end"


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as ligne, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)"


@query(f"""select doc_id, rang, propre from (select doc_id, propre, row_number() over (partition by doc_id order by pos) - 1 as rang from (
  select doc_id, pos, propre, row_number() over (partition by doc_id, lower(propre) order by pos) as k from (select doc_id, pos, {s_clean('ligne')} as propre from {_LINES}) where propre is not null) where k = 1)""")
def q10_clean_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned lines of each document without repetitions, as arrays."""
    rows = table(spark, sf, "documents").select("doc_id", lists.clean_list(F.split("text", "\n")).alias("propres"))
    return rows.select("doc_id", F.posexplode("propres").alias("rang", "propre"))


@query(f"""select doc_id, rang, propre from (select doc_id, propre, row_number() over (partition by doc_id order by pos) - 1 as rang from (
  select doc_id, pos, propre, row_number() over (partition by doc_id, lower(propre) order by pos) as k from (select doc_id, pos, {s_clean('ligne')} as propre from {_LINES}) where propre is not null) where k = 1)""")
def q10b_clean_comments_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a relational plan, for comments that come as rows."""
    rows = tb.lines(table(spark, sf, "documents"), ["doc_id"], "text")
    # an exploded value is computed once, however many later steps read it
    rows = rows.select("doc_id", "pos", F.explode(F.array(lists.clean_comment(F.col("ligne")))).alias("propre")).where("propre is not null")
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower("propre")).orderBy("pos"))
    rows = rows.withColumn("k", first).where("k = 1")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("rang"), "propre")


@query(f"select champ, lower({s_strip('texte')}) in {_NOISE} or length({s_strip('texte')}) <= 2 as bruit, count(distinct verbatim_id) as n from verbatims where texte is not null group by all")
def q11_noise(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "verbatims").where("texte is not null").select("verbatim_id", "champ", lists.is_noise(F.col("texte")).alias("bruit"))
    return rows.groupBy("champ", "bruit").agg(F.countDistinct("verbatim_id").alias("n"))


@query(f"""select payload_id, coalesce(string_agg(texte, ' • ' order by champ, rang) filter ({s_strip('texte')} <> ''), '') as cellule
  from (select distinct payload_id, champ, rang, texte, verbatim_id from verbatims) group by payload_id""")
def q12_cell_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "verbatims").select("payload_id", "champ", "rang", "texte", "verbatim_id").distinct()
    listed = rows.groupBy("payload_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("champ", "rang", "verbatim_id", "texte"))), lambda x: x["texte"]).alias("v"))
    return listed.select("payload_id", fx.cell(F.col("v"), T.ArrayType(T.StringType())).alias("cellule"))


@query("select event_id, case when event_id % 5 = 0 then null else cast(json_extract_string(props, '$.k') as bigint) end as k from events")
def q12a_json_between_braces(spark: SparkSession, sf: str) -> DataFrame:
    """JSON inside other text; every fifth text has none."""
    text = F.when(F.col("event_id") % 5 == 0, F.lit("aucun objet")).when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit("Voici : "), F.col("props"), F.lit(" fin.")))
    return table(spark, sf, "events").select("event_id", F.get_json_object(fx.json_between_braces(text), "$.k").cast("bigint").alias("k"))


# --- headers and ledger --------------------------------------------------------------------------------------------------------

HEADERS = ["s_name ", "inconnu", " s_suppkey", "s_name", "s_acctbal"]


@query("select s_name as c0, '' as c1, cast(s_suppkey as varchar) as c2, s_name as c3, cast(s_acctbal as varchar) as c4 from supplier")
def q13_align_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Padded, unknown and repeated headers; the missing column is left out."""
    return records.align_to_headers(table(spark, sf, "supplier"), HEADERS)


@query("select '' as c0, '' as c1, cast(s_suppkey as varchar) as c2, s_name as c3, cast(s_acctbal as varchar) as c4 from supplier")
def q13b_align_last_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    return records.align_to_headers(table(spark, sf, "supplier"), HEADERS, last_duplicate_only=True)


@query("""select avis_id, array_to_string(list_sort(list_filter(json_keys(contenu), lambda k: not list_contains(['canal', 'points_forts', 'session'], k))), ',') as sans_colonne,
  array_to_string(list_sort(list_filter(['canal', 'points_forts', 'session'], lambda k: not list_contains(json_keys(contenu), k))), ',') as sans_valeur from avis_brut""")
def q14_key_differences(spark: SparkSession, sf: str) -> DataFrame:
    extra, missing = records.key_differences(F.json_object_keys("contenu"), F.array(*(F.lit(x) for x in ("canal", "points_forts", "session"))))
    return table(spark, sf, "avis_brut").select("avis_id", F.array_join(extra, ",").alias("sans_colonne"), F.array_join(missing, ",").alias("sans_valeur"))


@query("""select user_id, niveau, case when niveau <> '1' then n || ' votants' end as texte, case when niveau <> '1' then pct end as pourcentage from (
  select user_id, niveau, max(n) filter (event_type = t) as n, max(v) filter (event_type = t) as pct from (
    select user_id, event_type, count(*) as n, count(*)::double / 2 as v from events group by all)
  , (values ('5','click'), ('4','view'), ('3','signup'), ('2','purchase'), ('1','none')) as l(niveau, t) group by user_id, niveau)""")
def q15_legacy_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Legacy items with gaps (level 1 never comes), rebuilt as five items in order."""
    level = F.create_map(*[F.lit(x) for kv in (("click", "5"), ("view", "4"), ("signup", "3"), ("purchase", "2")) for x in kv])
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    item = F.struct(F.coalesce(F.try_element_at(level, F.col("event_type")), F.lit("autre")).alias("label"), F.col("n").alias("count"), F.replace((F.col("n") / 2).cast("string"), F.lit("."), F.lit(",")).alias("percent"))
    raw = counts.groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("souhaitez_vous_suivre_distribution")).alias("pre_formation"))).alias("raw"))
    return raw.select("user_id", F.inline(records.legacy_distribution(F.col("raw"))))


_MAP = {"1-URGENT": "Très satisfait(e)", "2-HIGH": "Satisfait(e)", "5-LOW": "Déçu(e)"}


@query("select o_orderkey, " + "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in _MAP.items()) + " else o_orderpriority end as libelle from orders")
def q16_canonical_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", records.canonical_label(F.col("o_orderpriority"), _MAP).alias("libelle"))


_FIVE = "[" + ", ".join(f"case when c_custkey % {k} = 0 then 1 end" for k in (2, 3, 5, 7, 11)) + "]"


@query(f"select c_custkey, len(list_filter({_FIVE}, lambda x: x is not null)) = 1 as exactement_un from customer")
def q17_exactly_one(spark: SparkSession, sf: str) -> DataFrame:
    five = [F.when(F.col("c_custkey") % k == 0, F.lit(1)) for k in (2, 3, 5, 7, 11)]
    return table(spark, sf, "customer").select("c_custkey", records.exactly_one(five).alias("exactement_un"))


_RULES = {"$.n": (T.LongType(), True, None), "$.d": (T.DoubleType(), False, None), "$.s": (T.StringType(), False, LABELS)}


@query("""select event_id, case e when 0 then null when 2 then null when 3 then null else event_id end as n, case when e = 4 then null else value end as d,
  case e when 5 then null else case when event_id % 2 = 0 then 'Satisfait(e)' else 'Autre' end end as s,
  array_to_string(list_filter([case when e = 2 then '$.n: type' end, case when e in (0, 3) then '$.n: absent' end, case when e = 4 then '$.d: type' end, case when e = 5 then '$.s: type' end,
    case when e <> 5 and event_id % 2 = 1 then '$.s: domaine' end], lambda x: x is not null), '|') as erreurs from (select *, event_id % 7 as e from events)""")
def q18_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a missing, fractional, null, badly spelled or wrongly typed field, a number as text, and good ones."""
    e = F.col("event_id") % 7
    n = F.when(e == 0, F.lit("")).when(e == 2, F.lit('"n":17.5,')).when(e == 3, F.lit('"n":null,')).when(e == 6, F.concat(F.lit('"n":"'), F.col("event_id"), F.lit('.0",'))).otherwise(F.concat(F.lit('"n":'), F.col("event_id"), F.lit(",")))
    d = F.when(e == 4, F.lit('"d":"8,5",')).otherwise(F.concat(F.lit('"d":'), F.col("value"), F.lit(",")))
    s = F.when(e == 5, F.lit('"s":5')).otherwise(F.when(F.col("event_id") % 2 == 0, F.lit('"s":"Satisfait(e)"')).otherwise(F.lit('"s":"Autre"')))
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("{"), n, d, s, F.lit("}")).alias("raw"))
    return records.validate(rows, "raw", _RULES).drop("raw").withColumn("erreurs", F.array_join("erreurs", "|"))


def _current(spark: SparkSession, sf: str) -> DataFrame:
    raw = latest_by_key(table(spark, sf, "payload_raw").select("raw_id", "contenu", "depose_le"), ["raw_id"], ["depose_le"])
    return records.legacy_to_current(raw, "contenu")


@query()
def q15_legacy_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Whole payloads in the current layout."""
    return _current(spark, sf).select("raw_id", "etait_v2", "v2")


@query()
def q18_validate_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Whole payloads, brought to the current layout, against the declared schema; accepted ones have no error."""
    return _current(spark, sf).select("raw_id", F.array_join(records.payload_errors(F.col("v2")), "|").alias("erreurs"))


_SECTIONS = ("pre_formation", "a_chaud", "a_froid", "intervenants", "resultats_evaluations")


@query(f"""with {LATEST} select payload_id, array_to_string(list_filter([{', '.join(f"case when {s} is null then '{s} : absente' end" for s in _SECTIONS)},
  case when a_froid.elements_les_plus_utiles is null then 'utiles : absente' when len(a_froid.elements_les_plus_utiles) = 0 then 'utiles : vide' end], lambda x: x is not null), ' / ') as messages from p""")
def q19_completeness(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_by_key(table(spark, sf, "payload_v2").select("payload_id", "ingere_le", *_SECTIONS), ["payload_id"], ["ingere_le"])
    useful = F.col("a_froid.elements_les_plus_utiles")
    tests = {s: (F.col(s).isNull(), F.lit(False)) for s in _SECTIONS} | {"utiles": (useful.isNull(), lists.missing_or_empty(useful, True))}
    return rows.select("payload_id", F.array_join(records.section_messages(tests), " / ").alias("messages"))


@query("""select distinct report_id, coalesce(len(pages), 0) as pages, coalesce(length(full_text), 0) as caracteres,
  case when coalesce(len(pages), 0) > 20 or coalesce(length(full_text), 0) > 25000 then 'grand' else 'standard' end as modele from report_text""")
def q20_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Model by size, with thresholds that some reports pass."""
    pages, chars = F.size(F.coalesce("pages", F.array().cast("array<string>"))), F.coalesce(F.length("full_text"), F.lit(0))
    large = tb.is_large(pages, chars, 20, 25_000)
    return table(spark, sf, "report_text").select("report_id", pages.alias("pages"), chars.alias("caracteres"), F.when(large, F.lit("grand")).otherwise(F.lit("standard")).alias("modele")).distinct()


@query(f"select doc_id, length({s_strip('text')}) < 30 as a_relire from documents")
def q21_ocr_needed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tb.needs_ocr(fx.strip(F.col("text"))).alias("a_relire"))


_JOINED = s_strip("coalesce(array_to_string(list_transform(pages, lambda p: coalesce(p, '')), chr(10)), '')")


@query(f"select distinct report_id, {_JOINED} as texte from report_text")
def q22_join_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "report_text").select("report_id", tb.join_pages(F.col("pages")).alias("texte")).distinct()


@query("select sha256(text) as hash, min(doc_id) as doc_id from documents group by text having min(doc_id) % 3 <> 0")
def q23_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """First document of each text that the ledger (the texts whose first document is divisible by 3) doesn't know."""
    firsts = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"))
    return records.new_payloads(firsts, firsts.where("doc_id % 3 = 0"))


@query(f"select o_custkey, semestre, o_orderkey, o_totalprice from (select *, {SEM} as semestre, row_number() over (partition by o_custkey, {SEM} order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1")
def q24_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Last write of each (customer, term)."""
    rows = table(spark, sf, "orders").withColumn("semestre", _semester(F.col("o_orderdate")))
    return latest_by_key(rows, ["o_custkey", "semestre"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "semestre", "o_orderkey", "o_totalprice")


@query(f"select c_custkey, replace({s_strip('''c_name || ' bis ' ''')}, ' ', '_') || '_' || replace(c_mktsegment, ' ', '_') || '.json' as nom from customer")
def q25_file_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", fx.safe_file_name(F.concat("c_name", F.lit(" bis ")), F.col("c_mktsegment")).alias("nom"))


@query("select doc_id, length(substr(text, 1, 500)) as n, substr(text, 1, 500) as apercu from documents")
def q26_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length(F.substring("text", 1, 500)).alias("n"), F.substring("text", 1, 500).alias("apercu"))


@query(f"select doc_id, {s_strip('''replace(text || ' note 7,5', ',', '.')''')} as tous, {s_strip('''regexp_replace(text || ' note 7,5', '([0-9]),([0-9])', '\\1.\\2', 'g')''')} as nombres from documents")
def q27_commas(spark: SparkSession, sf: str) -> DataFrame:
    """Both policies for decimal commas."""
    text = F.concat("text", F.lit(" note 7,5"))
    return table(spark, sf, "documents").select("doc_id", fx.commas_to_points(text).alias("tous"), fx.number_commas_to_points(text).alias("nombres"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber % 3 = 0 then null else cast(l_quantity as bigint) end as votants from lineitem")
def q28_votes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_quantity").cast("bigint").cast("string")
    text = F.when(F.col("l_linenumber") % 3 == 0, n).otherwise(F.concat(F.lit("Total : "), n, F.lit("  votants")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fx.votes_number(text).alias("votants"))


_REPORT_LINES = "(select report_id, unnest(string_split(full_text, chr(10))) as ligne, generate_subscripts(string_split(full_text, chr(10)), 1) - 1 as pos from (select distinct report_id, full_text from report_text))"
_HIST = r"^\s*([1-5])\s*[.\s]+\s(\d+)\s+(\d+(?:[.,]\d+)?)\s*%"


def _report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tb.lines(table(spark, sf, "report_text").select("report_id", "full_text").distinct(), ["report_id"], "full_text")


@query(f"select report_id, pos, cast(regexp_extract(ligne, '{_HIST}', 1) as integer) as niveau, cast(regexp_extract(ligne, '{_HIST}', 2) as integer) as votants, cast(regexp_extract(ligne, '{_HIST}', 3) as double) as pourcentage from {_REPORT_LINES} where regexp_matches(ligne, '{_HIST}')")
def q28b_histogram(spark: SparkSession, sf: str) -> DataFrame:
    level, votes, percent = tb.histogram_line(F.col("ligne"))
    return _report_lines(spark, sf).select("report_id", "pos", level.alias("niveau"), votes.alias("votants"), percent.alias("pourcentage")).where("niveau is not null")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_linenumber % 2 = 0 then l_discount else cast(format('{:.1f}', l_quantity / 51.0::double * 100) as double) end as pourcentage from lineitem")
def q29_fill_percent(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", ind.fill_percent(given, F.col("l_quantity"), F.lit(51.0)).alias("pourcentage"))


# --- text blocks -------------------------------------------------------------------------------------------------------------------

#: Titles of the blocks, folded.
ANCHORS = ("evaluation pre-formation", "evaluation a chaud", "evaluation a froid", "questionnaire pour les intervenants", "resultats des evaluations")
_FOLD = f"translate(lower(regexp_replace(ligne, '{WS}+', ' ', 'g')), 'àâäáãéèêëíìîïóòôöõúùûüçñÿ’', 'aaaaaeeeeiiiiooooouuuucny''')"
_ANCHOR = f"case when trim({_FOLD}) in ({', '.join(repr(a) for a in ANCHORS)}) then trim({_FOLD}) end"


@query(f"select bloc, count(*) as n_lignes, count(distinct report_id) as n_rapports from (select report_id, last_value({_ANCHOR} ignore nulls) over (partition by report_id order by pos rows between unbounded preceding and current row) as bloc from {_REPORT_LINES}) group by bloc")
def q30_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each block of the reports, titles matched without case and accents."""
    folded = F.trim(fx.fold(F.col("ligne")))
    cut = tb.segment(_report_lines(spark, sf), ["report_id"], "pos", F.when(folded.isin(*ANCHORS), folded))
    return cut.groupBy("bloc").agg(F.count("*").alias("n_lignes"), F.countDistinct("report_id").alias("n_rapports"))


_SCORE = r"([+-]?\d+(?:[.,]\d+)?)\s*/\s*10\b"


@query(f"""select report_id, pos, note from (select report_id, pos, ligne, first_value(case when ligne not like '%page%' then try_cast(replace(regexp_extract(ligne, '{_SCORE}', 1), ',', '.') as double) end ignore nulls)
  over (partition by report_id order by pos rows between current row and unbounded following) as note from {_REPORT_LINES}) where trim({_FOLD}) in ({', '.join(repr(a) for a in ANCHORS)})""")
def q31_score_near_label(spark: SparkSession, sf: str) -> DataFrame:
    """The first score at or after each block title."""
    folded = F.trim(fx.fold(F.col("ligne")))
    near = tb.nearest_after(_report_lines(spark, sf), ["report_id"], "pos", F.when(~F.col("ligne").contains("page"), fx.score_of_ten(F.col("ligne"))))
    return near.where(folded.isin(*ANCHORS)).select("report_id", "pos", F.col("proche").alias("note"))


@query(f"select report_id, count(*) as n from {_REPORT_LINES} where ligne not in (select ligne from {_REPORT_LINES} group by ligne having count(distinct report_id) >= 5) group by report_id")
def q32_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines left in each report without those that stand in five reports or more."""
    return tb.without_repeated(_report_lines(spark, sf), "report_id", "ligne", 5).groupBy("report_id").agg(F.count("*").alias("n"))


@query("""with r as (select distinct verbatim_id, payload_id, champ, texte from verbatims), g as (select *, case when champ like 'demande%' then 'avant' else 'apres' end as groupe from r),
  k as (select *, row_number() over (partition by payload_id order by verbatim_id) - row_number() over (partition by payload_id, groupe order by verbatim_id) as ecart from g),
  i as (select payload_id, groupe, ecart, min(verbatim_id) as debut, count(*) as n, coalesce(string_agg(texte, ' ' order by verbatim_id), '') as texte from k group by all)
  select payload_id, row_number() over (partition by payload_id order by debut) as ilot, groupe, debut, n, texte from i""")
def q33_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive answers of the same kind joined."""
    rows = table(spark, sf, "verbatims").select("verbatim_id", "payload_id", "champ", "texte").distinct()
    return tb.islands(rows, ["payload_id"], "verbatim_id", F.when(F.col("champ").startswith("demande"), F.lit("avant")).otherwise(F.lit("apres")), "texte")


_YN = "(['Oui ', 'NON', 'o', 'faux', 'peut-être'])[1 + (p_partkey % 5)::int]"


@query(f"select p_partkey, case when lower(trim({_YN})) in ('oui', 'o', 'vrai') then 'oui' when lower(trim({_YN})) in ('non', 'faux') then 'non' end as reponse from part")
def q34_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    told = F.element_at(F.array(*(F.lit(x) for x in ("Oui ", "NON", "o", "faux", "peut-être"))), (1 + F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf, "part").select("p_partkey", fx.yes_no(told).alias("reponse"))


@query("select p_partkey, case when p_partkey % 4 = 0 then null else p_size / 4.0::double end as progression from part")
def q35_progression(spark: SparkSession, sf: str) -> DataFrame:
    value = F.replace((F.col("p_size") / 4.0).cast("string"), F.lit("."), F.lit(","))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(value, F.lit(" / 10"))).otherwise(F.concat(F.lit("Progression : + "), value, F.lit(" / 10")))
    return table(spark, sf, "part").select("p_partkey", fx.progression(text).alias("progression"))


@query("""select cle, coalesce(d.total, s.total) as total from (select l_orderkey as cle, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as total from lineitem group by all) d
  full join (select o_orderkey as cle, cast(round(o_totalprice * 100) as bigint) as total from orders) s using (cle)""")
def q36_prefer_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the details where there are any, else the total of the order, in hundredths."""
    detail = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cle")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("total"))
    total = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cle"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"))
    return tb.prefer(detail, total, ["cle"], "total")


@query("""select user_id, sum(n) = max(annonce) and sum(p) between 99 and 101 as coherent, cast(sum(p) as bigint) as somme from (
  select *, cast(round_even(n * 100.0 / total, 0) as bigint) as p from (select *, sum(n) over (partition by user_id) as total from (select user_id, event_type, count(*) as n from events group by all)))
  join (select user_id, count(*) - max(case when user_id % 3 = 0 then 1 else 0 end) as annonce from events group by user_id) using (user_id) group by user_id""")
def q37_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each user's events are as many as announced (one too few for every third user) and their rounded percentages sum to 99..101."""
    events = table(spark, sf, "events")
    announced = events.groupBy("user_id").agg((F.count("*") - F.max(F.when(F.col("user_id") % 3 == 0, 1).otherwise(0))).alias("annonce"))
    rows = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("user_id")))
    rows = rows.withColumn("p", fx.whole(F.col("n") * 100.0 / F.col("total")))
    sums = rows.groupBy("user_id").agg(F.sum("n").alias("votes"), F.sum("p").alias("somme")).join(announced, "user_id")
    return sums.select("user_id", tb.chart_is_consistent(F.col("votes"), F.col("annonce"), F.col("somme")).alias("coherent"), "somme")


def _or_none(x: str, *more: str) -> str:
    return "coalesce(" + ", ".join((x, *more, f"'{narrative.NO_DATA}'")) + ")"


def _mastery_sql(section: str, name: str) -> str:
    at = f"{section}.maitrise_objectifs_{name}"
    return _or_none(_mean_sql(f"{at}.par_objectif"), f"case when {at}.note_globale_objectifs_{name} is not null then {s_note(f'{at}.note_globale_objectifs_{name}')} end")


def _note_sql(x: str) -> str:
    return _or_none(f"case when {x} is not null then {s_note(x)} end")


_IMPACT = "resultats_evaluations.progression_competences_plus_sur_10"
_TOLD = {k: f"'{narrative.NO_INFO}'" for k in ("Points forts", "Points faibles", OUTPUT_COLUMNS[10], "Evaluation formateurs", "Avec le recul", "Problématiques remontées", "Adaptations de programme")}
_ROW_SQL = {
    "Formation": f"coalesce({s_strip('nom_formation')}, '')", "Semestre": f"coalesce({s_strip('semestre')}, '')", "Volonté de suivre cette session": "volonte",
    "Demande particulière de sujet à aborder": f"'{narrative.NO_REMARK}'", "AutoEvaluation compétence pré-formation": _mastery_sql("pre_formation", "preformation"),
    "formation Profitable": _or_none("case when a_chaud.formation_profitable.oui_percent is not null then format('{:.0f} %', a_chaud.formation_profitable.oui_percent) end"),
    "Satisfaction du contenu": _or_none(_SATISFACTION), "Note /10 à chaud": _note_sql("a_chaud.note_globale_a_chaud"),
    "Autoanalyse compétence": _mastery_sql("a_chaud", "a_chaud"), "Note /10 à froid": _note_sql("a_froid.note_sur_10"), "Auto-analyse progression": _mastery_sql("a_froid", "a_froid"),
    "Impact / Progression des compétences": _or_none(f"'+' || regexp_replace(cast(round_even(cast({_IMPACT} as varchar)::decimal(38,18), 2)::decimal(22,2) as varchar), '\\.?0+$', '') || '/10'"),
    **_TOLD, "Synthese": "''", "Lien du rapport qualité": "''", "Actions correctrices": "''",
}


_ROW_COLUMNS = ", ".join(f'{_ROW_SQL[c]} as "{c}"' for c in OUTPUT_COLUMNS)


@query(f"{_WITH_LEVELS}, v as ({_WILLING_SQL}) select payload_id, {_ROW_COLUMNS} from p join v using (payload_id)")
def q38_output_row(spark: SparkSession, sf: str) -> DataFrame:
    """The whole output row of every payload, without a provider of summaries."""
    columns = ["payload_id", "ingere_le", "nom_formation", "semestre", "pre_formation", "a_chaud", "a_froid", "intervenants", "resultats_evaluations"]
    return report_rows(latest_by_key(table(spark, sf, "payload_v2").select(*columns), ["payload_id"], ["ingere_le"]), "none", ["payload_id"])


META = {"auteur": "papyrine", "mode": "rédaction harmonisée"}


@query(f"{_WITH_LEVELS}, v as ({_WILLING_SQL}) select payload_id, volonte as \"Volonté de suivre cette session\", '{META['auteur']}' as auteur, '{META['mode']}' as mode from p join v using (payload_id)")
def q38b_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Who made an output row and how, beside a column of it."""
    columns = ["payload_id", "ingere_le", "nom_formation", "semestre", "pre_formation", "a_chaud", "a_froid", "intervenants", "resultats_evaluations"]
    rows = report_rows(latest_by_key(table(spark, sf, "payload_v2").select(*columns), ["payload_id"], ["ingere_le"]), "none", ["payload_id"], meta=META)
    return rows.select("payload_id", "Volonté de suivre cette session", "meta_generation.*")


@query("select time_bucket(interval '1 hour', ts) as debut, event_type, count(*) as n from events group by all")
def q39_streaming(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per hour and type by a stream over the file, run to its end."""
    import uuid

    from papyrine.streaming.flows import windowed_counts
    from papyrine.worktable import shared_folder

    at = f"{shared_folder(spark)}/papyrine/q39-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)

    def keep(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/batch={k}")

    counts = windowed_counts(source, "ts", "event_type")
    done = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")


@query(f"""select source, cast(rang as integer) as rang, ligne, n from (select *, row_number() over (partition by source order by n desc, ligne) as rang from (select source, ligne, count(*) as n
  from (select source, unnest(string_split(text, chr(10))) as ligne from documents) where length(ligne) > 2 group by all)) where rang <= 3""")
def q40_extractive(spark: SparkSession, sf: str) -> DataFrame:
    """The three most frequent lines of each source."""
    rows = tb.lines(table(spark, sf, "documents"), ["source"], "text").where(F.length("ligne") > 2)
    return narrative.top_lines(rows, "source", "ligne")


@query("""select doc_id, length(p) as n, sha256(p) as hash from (select doc_id, replace(replace('Texte : {{PDF_TEXT}} / {{PDF_METADATA}}', '{{PDF_TEXT}}', text), '{{PDF_METADATA}}',
  '{"source":' || to_json(source) || ',"n_chars":' || n_chars || ',"semestre":' || coalesce(to_json(semestre)::varchar, 'null') || '}') as p from documents)""")
def q41_prompt(spark: SparkSession, sf: str) -> DataFrame:
    meta = narrative.metadata(source=F.col("source"), n_chars=F.col("n_chars"), semestre=F.col("semestre"))
    text = narrative.prompt("Texte : {{PDF_TEXT}} / {{PDF_METADATA}}", F.col("text"), meta)
    return table(spark, sf, "documents").select("doc_id", F.length(text).alias("n"), F.sha2(text, 256).alias("hash"))


@query("""select event_id, case event_id % 4 when 0 then 'v' || event_id when 1 then event_type when 2 then 'net ' || event_type else '{"autre": 1}' end as texte from events""")
def q42_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries under one of the known keys, quoted, plain with double blanks, and JSON without a known key."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('{"resume": " ", "summary": " v'), F.col("event_id").cast("string"), F.lit(' "}'))).when(k == 1, F.concat(F.lit(' "'), F.col("event_type"), F.lit('" '))).when(
        k == 2, F.concat(F.lit("net \n "), F.col("event_type"))).otherwise(F.lit('{"autre":  1}'))
    return table(spark, sf, "events").select("event_id", fx.unwrap_summary(raw).alias("texte"))


def _norm_sql(x: str) -> str:
    return f"coalesce({s_strip(x)}, '')"


_I = "intervenants.commentaire_"


@query(f"with {LATEST} select payload_id, " + s_strip(f"{_norm_sql(_I + 'conditions_materielles')} || ' ' || {_norm_sql(_I + 'groupe_apprenants')} || ' ' || {_norm_sql(_I + 'organisation_generale')}") + " as texte from p")
def q43_comments(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_by_key(table(spark, sf, "payload_v2").select("payload_id", "ingere_le", "intervenants"), ["payload_id"], ["ingere_le"])
    return rows.select("payload_id", F.coalesce(trainer_comment(F.col("intervenants")), F.lit("")).alias("texte"))
