"""Declared schemas: the payload (current and legacy), and the output row."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()  # noqa: E741


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LEVELS = struct(totalement=D, en_partie=D, insuffisamment=D, pas_du_tout=D)
OBJECTIVE = struct(objectif_label=S, levels=LEVELS, note_sur_10=D)
SCALE = T.StructType([*(T.StructField(f"echele {k}", S) for k in (5, 4, 3, 2, 1)), T.StructField("nb_votants", I), T.StructField("pourcentage", D)])
YES_NO = T.MapType(S, D, True)


def mastery(note: str) -> T.StructType:
    return struct(mode=S, par_objectif=T.ArrayType(OBJECTIVE), **{note: D})


PRE = struct(
    volonte_suivi_formation=T.StructType([T.StructField("nb votants", I)]),
    souhaitez_vous_suivre_distribution=T.ArrayType(SCALE),
    demande_sujets_a_aborder=T.ArrayType(S),
    maitrise_objectifs_preformation=mastery("note_globale_objectifs_preformation"),
)
HOT = struct(
    formation_profitable=struct(oui=D, non=D, oui_percent=D, non_percent=D),
    satisfaction_contenu=T.ArrayType(struct(label=S, count=D, percent=D)),
    note_globale_a_chaud=D,
    points_forts=T.ArrayType(S), points_a_ajuster=T.ArrayType(S),
    suggestions_complement_sur_formation=T.ArrayType(S), appreciations_intervenants=T.ArrayType(S),
    maitrise_objectifs_a_chaud=mastery("note_globale_objectifs_a_chaud"),
)
COLD = struct(note_sur_10=D, maitrise_objectifs_a_froid=mastery("note_globale_objectifs_a_froid"), elements_les_plus_utiles=T.ArrayType(S))
TRAINERS = struct(
    commentaire_conditions_materielles=S, commentaire_groupe_apprenants=S, commentaire_organisation_generale=S,
    adaptation_horaires=struct(reponse=S, precisions=S),
    precisions_a_noter=S, explication_modification_programme=S,
    contenu_non_prevu=struct(reponse=S, de_quoi_s_agissait_il=S),
    retards_apprenants=YES_NO, handicap_signale=YES_NO,
)
PAYLOAD = T.StructType([
    T.StructField("version_prompt", S), T.StructField("Nom formation", S), T.StructField(" semestre", S),
    T.StructField("pre_formation", PRE), T.StructField("a_chaud", HOT), T.StructField("a_froid", COLD),
    T.StructField("intervenants", TRAINERS), T.StructField("resultats_evaluations", struct(progression_competences_plus_sur_10=D)),
    T.StructField("meta_extraction", T.MapType(S, T.BooleanType(), True)), T.StructField("lien_vers_formation", S),
])

#: Domains of the literal fields.
MODES = ("4_niveaux", "notes_sur_10")
LABELS = ("Très satisfait(e)", "Satisfait(e)", "Déçu(e)", "Sans opinion")
ANSWERS = ("oui", "non")

#: Columns of the output row, in order.
OUTPUT_COLUMNS = (
    "Formation", "Semestre", "Volonté de suivre cette session", "Demande particulière de sujet à aborder",
    "AutoEvaluation compétence pré-formation", "formation Profitable", "Satisfaction du contenu", "Note /10 à chaud",
    "Points forts", "Points faibles", "Sujets non traité à reboucler avec formateur ou nouvelle formation ou attendu",
    "Evaluation formateurs", "Autoanalyse compétence", "Note /10 à froid", "Auto-analyse progression",
    "Impact / Progression des compétences", "Avec le recul", "Problématiques remontées", "Adaptations de programme",
    "Synthese", "Lien du rapport qualité", "Actions correctrices",
)
