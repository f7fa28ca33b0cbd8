"""The output row of a report: one projection over the payload, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import scalar as fx
from papyrine.operators import indicators as ind
from papyrine.operators.narrative import NO_DATA, NO_REMARK, summary


def _note_or(*values: Column) -> Column:
    return F.coalesce(*values, F.lit(NO_DATA))


def trainer_comment(inter: Column) -> Column:
    """The three comments stripped and joined by a blank, ends stripped; inner blanks of empty ones stay."""
    parts = (inter["commentaire_conditions_materielles"], inter["commentaire_groupe_apprenants"], inter["commentaire_organisation_generale"])
    return fx.strip(F.concat(fx.norm(parts[0]), F.lit(" "), fx.norm(parts[1]), F.lit(" "), fx.norm(parts[2])))


def report_rows(df: DataFrame, provider: str = "none", key: list[str] | None = None, meta: dict[str, str] | None = None) -> DataFrame:
    """The 22 columns, with ``meta`` (who made the row and how: ``auteur``, ``mode``) also the struct ``meta_generation`` of it, of each payload (columns nom_formation, semestre, pre_formation, a_chaud, a_froid, intervenants,
    resultats_evaluations), after the ``key`` columns. Null sections give the fixed sentences."""
    pre, hot, cold, inter = (F.col(c) for c in ("pre_formation", "a_chaud", "a_froid", "intervenants"))
    text = {
        "Points forts": hot["points_forts"], "Points faibles": hot["points_a_ajuster"],
        "Sujets non traité à reboucler avec formateur ou nouvelle formation ou attendu": hot["suggestions_complement_sur_formation"],
        "Evaluation formateurs": hot["appreciations_intervenants"], "Avec le recul": cold["elements_les_plus_utiles"],
    }
    told = {k: summary(v, provider) for k, v in text.items()}
    mastery = lambda s, name: (ind.mean_note(s[f"maitrise_objectifs_{name}"]["par_objectif"]), fx.note(s[f"maitrise_objectifs_{name}"][f"note_globale_objectifs_{name}"]))
    adapt = F.concat(F.coalesce(F.to_json(inter["adaptation_horaires"]), F.lit("{}")), F.lit(" "), fx.norm(inter["explication_modification_programme"]))
    columns = {
        "Formation": fx.norm(F.col("nom_formation")), "Semestre": fx.norm(F.col("semestre")),
        "Volonté de suivre cette session": ind.willingness(pre["souhaitez_vous_suivre_distribution"], pre["volonte_suivi_formation"]["nb_votants"]),
        "Demande particulière de sujet à aborder": summary(pre["demande_sujets_a_aborder"], provider, NO_REMARK),
        "AutoEvaluation compétence pré-formation": _note_or(*mastery(pre, "preformation")),
        "formation Profitable": _note_or(fx.percent_text(hot["formation_profitable"]["oui_percent"])),
        "Satisfaction du contenu": _note_or(ind.satisfaction(hot["satisfaction_contenu"])),
        "Note /10 à chaud": _note_or(fx.note(hot["note_globale_a_chaud"])),
        **{k: told[k] for k in list(text)[:4]},
        "Autoanalyse compétence": _note_or(*mastery(hot, "a_chaud")),
        "Note /10 à froid": _note_or(fx.note(cold["note_sur_10"])),
        "Auto-analyse progression": _note_or(*mastery(cold, "a_froid")),
        "Impact / Progression des compétences": _note_or(fx.impact(F.col("resultats_evaluations.progression_competences_plus_sur_10"))),
        "Avec le recul": told["Avec le recul"],
        "Problématiques remontées": summary(F.array(trainer_comment(inter)), provider),
        "Adaptations de programme": summary(F.array(fx.strip(adapt)), provider),
        "Synthese": F.lit(""), "Lien du rapport qualité": F.lit(""), "Actions correctrices": F.lit(""),
    }
    if meta:
        columns["meta_generation"] = F.struct(*(F.lit(v).alias(k) for k, v in meta.items()))
    return df.select(*(key or []), *(v.alias(k) for k, v in columns.items()))
