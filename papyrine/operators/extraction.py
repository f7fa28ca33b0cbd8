"""From the text of a report to a record in the declared layout, deterministically.

Lines are cut into blocks at the titles of the five sessions and into answers at the questions inside a block; titles and questions are
matched without case, accents and punctuation and with a few misspelled letters. Every answer is then read by the reader of its
question (comments, a chart of levels, a score out of ten, yes or no with percentages, four levels) and the readings of a report
are put together. Lines of a report meet in its own partition; nothing else is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.scalar import fold, let, progression, score_of_ten, votes_number, yes_no
from papyrine.operators.records import canonical_label
from papyrine.operators.text_blocks import histogram_line, lines
from papyrine.schema import LABELS

#: Titles of the blocks, folded, and the section of the record they open.
TITLES = {
    "evaluation preformation": "pre_formation", "evaluation pre-formation": "pre_formation", "evaluation a chaud": "a_chaud", "evaluation a froid": "a_froid",
    "questionnaire pour les intervenants": "intervenants", "resultats des evaluations": "resultats_evaluations", "progression des competences": "resultats_evaluations",
}
#: Most misspelled letters of a title or question.
MISSPELLED = 2
#: A block with fewer characters is an entry of a table of contents.
LEAST_BLOCK = 10
#: The four levels of an objective, folded, with the field of each.
FOUR_LEVELS = {"totalement": "totalement", "en partie": "en_partie", "insuffisamment": "insuffisamment", "pas du tout": "pas_du_tout"}


@dataclass(frozen=True)
class Question:
    """A question as printed (folded), its field and how its answer is read."""

    text: str
    field: str
    kind: str  # lines, chart, score, profit, labels, progression


#: Questions and the fields their answers go to.
QUESTIONS = (
    Question("souhaitez-vous suivre cette formation ?", "distribution", "chart"),
    Question("quels sont les sujets que vous aimeriez aborder ?", "demande_sujets_a_aborder", "lines"),
    Question("formation profitable ?", "formation_profitable", "profit"), Question("satisfaction du contenu ?", "satisfaction_contenu", "labels"),
    Question("note /10", "note", "score"), Question("note sur 10", "note", "score"),
    Question("points forts", "points_forts", "lines"), Question("points a ajuster", "points_a_ajuster", "lines"),
    Question("suggestions de complement", "suggestions_complement_sur_formation", "lines"), Question("appreciation des intervenants", "appreciations_intervenants", "lines"),
    Question("elements les plus utiles", "elements_les_plus_utiles", "lines"), Question("commentaire sur le groupe", "commentaire_groupe_apprenants", "lines"),
    Question("maitrise des objectifs", "maitrise_objectifs", "score"), Question("progression des competences", "progression_competences_plus_sur_10", "progression"),
)


def near(folded: Column, known: list[str], most: int = MISSPELLED) -> Column:
    """The known text a folded line spells, exactly or with up to ``most`` letters wrong (none in a text under 8 or with figures); else null. The
    nearest is taken, of equally near ones the first."""

    def bare(x: str) -> str:
        return " ".join("".join(c if c.isalnum() or c == "/" else " " for c in x).split())

    def pick(t: Column) -> Column:
        told = F.array(*(F.struct(F.when(t == bare(k), F.lit(0)).when(F.lit(len(bare(k)) >= 8 and not any(map(str.isdigit, k))) & (F.abs(F.length(t) - len(bare(k))) <= most), F.levenshtein(t, F.lit(bare(k)), most)).otherwise(F.lit(-1)).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(known)))
        return F.try_element_at(F.array_sort(F.filter(told, lambda x: x["d"] >= 0)), F.lit(1))["k"]

    return let(F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}/]+", " ")), pick)


def answers(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, ligne, bloc, question): every line that isn't blank, nor a title or question itself, with the section its block
    belongs to and the question it answers (null before the first). A title whose block has under ``LEAST_BLOCK`` characters opens none.
    """
    rows = lines(df, [doc], text).where(F.length(F.trim("ligne")) > 0)
    folded = fold(F.trim("ligne"))
    rows = rows.withColumn("titre", near(folded, list(TITLES))).withColumn("demande", F.when(F.col("titre").isNull(), near(folded, [q.text for q in QUESTIONS])))
    order = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_b", F.count("titre").over(order))
    size = F.sum(F.when(F.col("titre").isNull(), F.length(F.trim("ligne"))).otherwise(0)).over(Window.partitionBy(doc, "_b"))
    opens = F.when(F.col("_size") >= LEAST_BLOCK, F.col("titre"))
    rows = rows.withColumn("_size", size).withColumn("_t", F.last(opens, ignorenulls=True).over(order))
    # the block of the results answers one question, which needs no heading of its own
    asks = F.when(opens.isin(*(t for t, x in TITLES.items() if x == "resultats_evaluations")), F.lit("progression des competences")).otherwise(F.lit(""))
    heading = F.when(opens.isNotNull(), asks).otherwise(F.col("demande"))
    rows = rows.withColumn("_q", F.nullif(F.last(heading, ignorenulls=True).over(order), F.lit("")))
    section = F.try_element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), F.col("_t"))
    return rows.where("titre is null and demande is null").select(doc, "pos", "ligne", section.alias("bloc"), F.col("_q").alias("question"))


def comments(listed: Column) -> Column:
    """Lines of an answer, in order, with a line that begins without a dash or bullet joined to the one before if that began with one."""
    bullet = r"^\s*[-–—•·]\s*"

    def add(told: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(told, F.lit(-1)), F.lit(""))
        goes_on = last.rlike(bullet) & ~x.rlike(bullet)
        return F.when(goes_on, F.concat(F.slice(told, F.lit(1), F.greatest(F.size(told) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), F.trim(x))))).otherwise(F.concat(told, F.array(x)))

    joined = F.aggregate(listed, F.array().cast("array<string>"), add)
    return F.transform(joined, lambda x: F.trim(F.regexp_replace(x, bullet, "")))


def four_levels(text: Column) -> Column:
    """struct(totalement, en_partie, insuffisamment, pas_du_tout): the number printed behind each level's name; null where there is none."""
    folded = fold(text)

    def value(label: str) -> Column:
        found = F.regexp_extract(folded, rf"\b{label}\b[\s.:]*(\d+(?:[.,]\d+)?)", 1)
        return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")

    return F.struct(*(value(label).alias(field) for label, field in FOUR_LEVELS.items()))


def readings(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, bloc, question, lignes, note, oui, non, niveaux, echelons, votants_total, progression): one row per answered question, with
    every reading there is; which one counts is told by the question's kind. ``echelons`` are the chart lines as (niveau, votants,
    pourcentage), one per level, the last one printed; ``lignes`` the comments."""
    rows = answers(df, doc, text).where("question is not null")
    level, votes, percent = histogram_line(F.col("ligne"))
    rows = rows.withColumns({"niveau": level, "votants": votes, "pourcentage": percent, "total": votes_number(F.col("ligne")), "score": score_of_ten(F.col("ligne")), "plus": progression(F.col("ligne")),
                             "reponse": yes_no(F.regexp_extract("ligne", r"(?i)^\W*(oui|non)\b", 1)), "part": F.replace(F.regexp_extract("ligne", r"(\d+(?:[.,]\d+)?)\s*%", 1), F.lit(","), F.lit(".")).try_cast("double")})
    plain = F.when(F.col("niveau").isNull() & F.col("total").isNull(), F.struct("pos", "ligne"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    grouped = rows.groupBy(doc, "bloc", "question").agg(
        F.transform(F.array_sort(F.collect_list(plain)), lambda x: x["ligne"]).alias("brut"), first("score").alias("note"), first("plus").alias("progression"), first("total").alias("votants_total"),
        F.max(F.when(F.col("reponse") == "oui", F.col("part"))).alias("oui"), F.max(F.when(F.col("reponse") == "non", F.col("part"))).alias("non"),
        *(F.max_by(F.struct("votants", "pourcentage"), F.when(F.col("niveau") == k, F.col("pos"))).alias(f"_{k}") for k in (5, 4, 3, 2, 1)),
    )
    scale = F.array_compact(F.array(*(F.when(F.col(f"_{k}").isNotNull(), F.struct(F.lit(k).alias("niveau"), F.col(f"_{k}.votants").alias("votants"), F.col(f"_{k}.pourcentage").alias("pourcentage"))) for k in (5, 4, 3, 2, 1))))
    return grouped.select(doc, "bloc", "question", comments(F.col("brut")).alias("lignes"), "note", "oui", "non", four_levels(F.array_join("brut", " ")).alias("niveaux"), scale.alias("echelons"), "votants_total", "progression")


def chart_is_readable(scale: Column, total: Column) -> Column:
    """Whether the votes of a chart sum to the total printed below it and its percentages to 99..101."""
    votes = F.aggregate(scale, F.lit(0).cast("bigint"), lambda a, x: a + x["votants"])
    parts = F.aggregate(scale, F.lit(0.0), lambda a, x: a + x["pourcentage"])
    return F.coalesce((votes == total) & parts.between(99, 101), F.lit(False))


def records_from_text(df: DataFrame, doc: str, text: str, name: Column, term: Column, link: Column) -> DataFrame:
    """(doc, json): the record of each report that answers any question, with the fields of the questions found in it; what isn't printed is absent.
    ``name``, ``term`` and ``link`` are columns of ``df`` put in as they are."""
    read = readings(df, doc, text)
    at = lambda value, bloc, *questions: F.max_by(value, F.when(F.col("question").isin(*questions) & (F.lit(True) if bloc is None else F.col("bloc") == bloc), F.lit(1)))
    q = {x.field: x.text for x in QUESTIONS}
    notes = ("note /10", "note sur 10")
    listed = lambda bloc, field: at(F.col("lignes"), bloc, q[field])
    level = lambda x: F.concat(F.lit('{"echele '), x["niveau"].cast("string"), F.lit('":"'), x["niveau"].cast("string"), F.lit('","nb_votants":'), x["votants"].cast("string"), F.lit(',"pourcentage":'), x["pourcentage"].cast("string"), F.lit("}"))
    scale = F.transform("echelons", level)
    folded_lines = F.filter(F.transform("lignes", lambda x: F.struct(canonical_label(F.trim(F.regexp_extract(x, r"^(.*?)[\s.:]*\d", 1))).alias("label"), F.regexp_extract(x, r"(\d+(?:[.,]\d+)?)\s*%", 1).try_cast("double").alias("percent"), F.regexp_extract(x, r"\b(\d+)\b(?!\s*%|[.,]\d)", 1).try_cast("double").alias("count"))), lambda x: x["label"].isin(*LABELS))
    grouped = read.groupBy(doc).agg(
        at(scale, None, q["distribution"]).alias("scale"), at(F.col("votants_total"), None, q["distribution"]).alias("voters"), at(chart_is_readable(F.col("echelons"), F.col("votants_total")), None, q["distribution"]).alias("readable"),
        listed(None, "demande_sujets_a_aborder").alias("subjects"), at(F.col("note"), "pre_formation", q["maitrise_objectifs"]).alias("pre_mastery"),
        at(F.struct("oui", "non"), "a_chaud", q["formation_profitable"]).alias("profit"), at(folded_lines, "a_chaud", q["satisfaction_contenu"]).alias("content"), at(F.col("note"), "a_chaud", *notes).alias("hot"),
        *(listed(None, f).alias(f) for f in ("points_forts", "points_a_ajuster", "suggestions_complement_sur_formation", "appreciations_intervenants", "elements_les_plus_utiles", "commentaire_groupe_apprenants")),
        at(F.col("note"), "a_chaud", q["maitrise_objectifs"]).alias("hot_mastery"), at(F.col("note"), "a_froid", *notes).alias("cold"), at(F.col("note"), "a_froid", q["maitrise_objectifs"]).alias("cold_mastery"),
        F.max("progression").alias("plus"),
    )
    parsed = F.transform("scale", lambda x: F.parse_json(x))
    mastery = lambda c, field: F.when(F.col(c).isNotNull(), F.struct(F.lit("notes_sur_10").alias("mode"), F.col(c).alias(field)))
    body = F.struct(
        F.lit("v2.2").alias("version_prompt"), F.col("_name").alias("Nom formation"), F.col("_term").alias(" semestre"),
        F.struct(F.struct(F.col("voters").alias("nb votants")).alias("volonte_suivi_formation"), parsed.alias("souhaitez_vous_suivre_distribution"), F.col("subjects").alias("demande_sujets_a_aborder"), mastery("pre_mastery", "note_globale_objectifs_preformation").alias("maitrise_objectifs_preformation")).alias("pre_formation"),
        F.struct(F.struct(F.col("profit.oui").alias("oui_percent"), F.col("profit.non").alias("non_percent")).alias("formation_profitable"), F.col("content").alias("satisfaction_contenu"), F.col("hot").alias("note_globale_a_chaud"),
                 *("points_forts points_a_ajuster suggestions_complement_sur_formation appreciations_intervenants".split()), mastery("hot_mastery", "note_globale_objectifs_a_chaud").alias("maitrise_objectifs_a_chaud")).alias("a_chaud"),
        F.struct(F.col("cold").alias("note_sur_10"), mastery("cold_mastery", "note_globale_objectifs_a_froid").alias("maitrise_objectifs_a_froid"), "elements_les_plus_utiles").alias("a_froid"),
        F.struct(F.array_join("commentaire_groupe_apprenants", " ").alias("commentaire_groupe_apprenants")).alias("intervenants"),
        F.struct(F.col("plus").alias("progression_competences_plus_sur_10")).alias("resultats_evaluations"),
        F.when(~F.col("readable"), F.create_map(F.lit("graphique_non_lisible"), F.lit(True))).alias("meta_extraction"), F.col("_link").alias("lien_vers_formation"),
    )
    named = df.select(F.col(doc), name.alias("_name"), term.alias("_term"), link.alias("_link"))
    return grouped.join(named, doc).select(doc, F.to_json(body).alias("json"))
