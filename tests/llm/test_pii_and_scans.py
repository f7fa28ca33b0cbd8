from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import pii, pii_table, scan_noise as sn

# --- personal data -----------------------------------------------------------------------------------------------------


def frequent(texts, least=8):
    from collections import Counter

    counts = Counter(w.lower() for t in texts for w in pii.WORD.findall(t))
    return frozenset(w for w, n in counts.items() if n >= least)


def test_held_out_accuracy():
    rows = pii_table.labelled_table(900, seed=123)
    texts = [t for t, _ in rows]
    right = told = true = 0
    for (_, spans), found in zip(rows, pii.decode(pii.trained(), texts, frequent(texts)), strict=True):
        a, b = {(k, s) for s, _, k in spans}, {(k, s) for s, _, k in found}
        right, told, true = right + len(a & b), told + len(b), true + len(a)
    assert right / told > 0.97 and right / true > 0.97


def test_telephones_with_slashes():
    texts = ["sms possible : 04/65/71/28/70, le soir", "tél. O1/99/00/21/02", "noter 12/03/2025 et 14/03/2025 au planning", "noter 01/02/2025 03 au planning"]
    found = pii.decode(pii.trained(), texts, frequent(texts, 1))
    assert [[t[a:b] for a, b, k in f if k == "telephone"] for t, f in zip(texts, found, strict=True)] == [["04/65/71/28/70"], ["O1/99/00/21/02"], [], []]
    assert pii.mask(texts[0], found[0]) == "sms possible : [TELEPHONE], le soir"


@pytest.mark.parametrize(
    ("text", "kind", "finds"),
    [
        ("639 98 11 18", "telephone", ["639 98 11 18"]), ("+32 470 12 34 56", "telephone", ["+32 470 12 34 56"]), ("06 12 34 56 78 06 98 76 54 32", "telephone", ["06 12 34 56 78", "06 98 76 54 32"]),
        ("06 12 34 56 78 / +32 475 12 34 56", "telephone", ["06 12 34 56 78", "+32 475 12 34 56"]), ("06 12 34 56 78 poste 12", "telephone", ["06 12 34 56 78"]),
        ("a.b@exemple.fr c.d@exemple.fr", "courriel", ["a.b@exemple.fr", "c.d@exemple.fr"]), ("a.b chez exemple", "courriel", ["a.b chez exemple"]), ("12 venelle du Four", "adresse", ["12 venelle du Four"]),
        ("rue du Four", "adresse", []), ("12 rue du Four, 14 rue du Moulin", "adresse", ["12 rue du Four", "14 rue du Moulin"]), ("AB-12-CD", "identite", ["AB-12-CD"]),
    ],
)
def test_a_find_is_kept_whether_or_not_its_form_is_known(text, kind, finds):
    whole = f"noter ({text}) ici"
    found = pii.formed(whole, [[7, 7 + len(text), kind]], pii.form_matches(whole))
    assert [(whole[a:b], k) for a, b, k in found] == [(f, kind) for f in finds]


@pytest.mark.parametrize(("text", "hidden"), [
    ("me rappeler au 06 12 34 56 78 06 98 76 54 32", "0123456789"), ("écrire à paul.durand@exemple.fr l.petit@exemple.fr", "@"), ("joignable au +32 475 12 34 56", "0123456789"), ("j'habite 12 venelle du Four", "12"),
])
def test_nothing_is_left_in_clear(text, hidden):
    masked = pii.mask(text, pii.decode(pii.trained(), [text], frequent([text], 1))[0])
    assert not set(hidden) & set(masked)


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(1)
    n = len(pii.LABELS)
    steps, first = r.normal(size=(n, n)), r.normal(size=n)
    scores = [r.normal(size=(k, n)) for k in (1, 3, 2, 0)]
    got = pii.viterbi(scores, steps, first)
    for e, path in zip(scores, got, strict=True):
        def value(p, e=e):
            return (first + pii.FIRST_FORBIDDEN)[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum((steps + pii.FORBIDDEN)[a, b] for a, b in itertools.pairwise(p))

        if len(e):
            assert value(tuple(path)) == pytest.approx(max(map(value, itertools.product(range(n), repeat=len(e)))))
    assert len(got[3]) == 0


def test_scores_from_tables_equal_plain_features():
    field = pii.trained()
    for text in ("Merci à M. Paul Durand, 06 12 34 56 78", "x", "", "j'habite 12 rue du Four"):
        tokens, begins = pii.tokenise(text)
        known = [t.islower() for t in tokens]
        marks = pii.pattern_marks(pii.form_matches(text), begins)
        plain = [field._vector(row) for row in field.names(tokens, known, marks)]
        assert np.allclose(field.scores([(tokens, known, marks)])[0], np.array(plain).reshape(len(tokens), len(pii.LABELS)))


def test_table(spark):
    common = "le support est à revoir avec la salle et le groupe pour la suite du module"
    rows = [(i, common) for i in range(30)] + [
        (100, "écrire à a.durand@exemple.fr pour la suite"), (101, None), (102, ""), (103, "joignable au O6 12 34 56 78 après 17 h"), (104, "la salle Bréhonnec est trop petite"),
        (105, "merci à Mme Camille Durand pour sa patience"), (105, "merci à Mme Camille Durand pour sa patience"), (106, common * 3000), (None, "x"),
    ]
    df = spark.createDataFrame(rows, "v long, t string").withColumns({"id": F.lit("clash"), "texte": F.lit(0)})
    out = {r.id: r for r in pii.personal_data(df, "v", "t", 1200).collect()}
    assert out[100].texte_masque == "écrire à [COURRIEL] pour la suite" and (out[100].donnees[0].genre, out[100].donnees[0].debut) == ("courriel", 10)
    assert out[103].texte_masque == "joignable au [TELEPHONE] après 17 h" and out[103].donnees[0].debut == 14
    assert out[105].texte_masque == "merci à Mme [NOM] pour sa patience" and out[104].donnees == [] and out[106].donnees == []
    assert out[101].texte_masque is None and out[101].donnees == [] and out[102].texte_masque == ""
    assert pii.personal_data(df.limit(0), "v", "t", 1200).count() == 0


# --- scanned text --------------------------------------------------------------------------------------------------------


def test_alignment_explains_misreadings():
    r = random.Random(2)
    for _ in range(300):
        word = "".join(r.choice("abcdeéfghilmnostuv") for _ in range(r.randint(1, 9)))
        seen, _ = sn.misread(word, 0.4, r)
        assert word.translate(sn.SKELETON) == seen.translate(sn.SKELETON)
        ops = sn.align(word, seen)
        out = "".join(o[8:] if o.startswith("replace:") else c if o == "keep" else "" for c, o in zip(seen, ops, strict=True))
        assert out == word
    assert sn.align("clés", "des") is None


def test_misreadings_in_long_runs_of_letters():
    run = "lavisitedusiteannexeétaitutileetleformateurrestaitdisponible"
    lexicon = sn.Lexicon({run: 50}, {})
    assert sn.edit_word(run, lexicon, sn.editor()) is None
    for seen, letter in ((run.replace("v", "y", 1), "v"), (run.replace("o", "0", 1), "o")):
        assert [o for o in sn.edit_word(seen, lexicon, sn.editor()) if o != "keep"] == [f"replace:{letter}"]
    n = 20_000
    assert sn.align("v" * n + "m", "y" * n + "rn") == [*["replace:v"] * n, "replace:m", "delete"]


def repaired(token, lexicon):
    ops = sn.edit_word(token, lexicon, sn.editor())
    edits = {}
    sn.Repairer._edit(edits, 0, 0, token, ops or [])
    return edits[0][0][2] if edits else token


def test_lost_letters_are_inserted():
    lexicon = sn.Lexicon({"formation": 900, "organisation": 200, "participants": 500, "rare": 25, "matériel": 60}, {})
    assert lexicon.source("formaton")[1] == ["keep"] * 5 + ["insert:i"] + ["keep"] * 2
    assert [repaired(t, lexicon) for t in ("formaton", "organisaton", "partcipants", "matérel")] == ["formation", "organisation", "participants", "matériel"]
    assert [repaired(t, lexicon) for t in ("ormation", "formatio", "rre", "formation", "participants")] == ["ormation", "formatio", "rre", "formation", "participants"]


def test_predicted_operations_are_applied():
    lexicon = sn.Lexicon({"formation": 900, "comment": 300}, {})

    class Keeps:
        def predict(self, features, allowed):
            return "keep"

    class First(Keeps):
        def predict(self, features, allowed):
            return list(allowed)[-1] if "c=r" in features else "keep"

    assert sn.edit_word("forrnation", lexicon, Keeps()) is None
    assert [o for o in sn.edit_word("cornment", lexicon, First()) if o != "keep"] == ["replace:m"]  # the dictionary would also delete the n
    assert repaired("forrnation", lexicon) == "formation" and repaired("cornment", lexicon) == "comment"


def test_skeleton_of_a_column(spark):
    words = ["formation", "clés", "hélium", "é61l@ç0q9y5f2bvd", "", "mnhdu"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(sn.skeleton(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [w.translate(sn.SKELETON) for w in words]


def test_inferred_pages():
    lines = [x for p in range(1, 7) for x in ("Institut Zeta - bilan", "", *(f"ligne {chr(96 + k)} de la page {'abcdef'[p - 1]}" for k in range(1, 9)), f"- {p} -")]
    pages = sn.inferred_pages(lines, [sn.line_key(x, ()) for x in lines], {})
    assert len(pages) == 6 and all(len(p) == 11 for p in pages)
    assert len(sn.inferred_pages(["a", "b\f", "c"], ["a", "b", "c"], {})) == 2
    titles = [x for k in (3, 9, 4, 17, 5) for x in ("Points forts", *(f"mot {k}{i} et autre chose" for i in range(k)))]
    assert len(sn.inferred_pages(titles, [sn.line_key(x, ()) for x in titles], {})) == 1


def test_limits_and_missing_pages_change_nothing(spark):
    r = random.Random(9)
    rows = []
    for i in range(30):
        text, pages, _ = make_report(r, r.randint(3, 6), "Institut Zeta – Bilan", r.choice(["", "Ne pas diffuser"]), r.choice(["- @ -", "Page @ / 9"]))
        rows.append((i, text, pages, "Institut Zeta"))
    rows += [(60, "une organisation\nl'organisation", None, None), (61, "une organisation", None, None), (None, None, None, None), (62, rows[0][1], None, "Institut Zeta"), (62, rows[1][1], ["x"], None)]
    df = spark.createDataFrame(rows, "i long, t string, p array<string>, o string")
    found = lambda df, **limits: {tuple(x) for x in sn.noise_lines(df, "i", "t", "p", ("o",), **limits).collect()}
    whole = found(df)
    assert found(df, base_words=5, base_lines=0) == whole and found(df, base_words=60, base_lines=1) == whole
    fixed = lambda **limits: sorted(map(str, sn.repaired_texts(df, "i", "t", "p", ("o",), **limits).collect()))
    assert fixed(base_words=5, base_lines=0) == fixed()
    without = found(df.withColumn("p", F.lit(None).cast("array<string>")))
    for genre in ("entete", "page", "cesure", "erreur"):
        a, b = {x for x in whole if x[2] == genre and x[0] < 30}, {x for x in without if x[2] == genre and x[0] < 30}
        assert len(a & b) >= 0.9 * len(a) and len(b - a) <= 0.15 * len(a), genre


def make_report(r, n, head, foot, number):
    clean = [s.lower() for s in sn.SENTENCES]
    pages, lines, kinds = [], [], []
    for p in range(1, n + 1):
        rows = [(head.replace("@", str(p)), {"entete"})] if head else []
        for _ in range(12):
            words = r.choice(clean).split()
            for w in list(words):
                if len(w) > 4 and r.random() < 0.03:
                    words[words.index(w)] = sn.misread(w, 0.5, r)[0]
            line = " ".join(words)
            rows.append((line, {"erreur"} if line not in clean else set()))
        if r.random() < 0.8:
            k = r.randint(1, len(rows) - 2)
            if not rows[k][1] and not rows[k + 1][1]:
                rows[k], rows[k + 1] = (rows[k][0] + " organi-", {"cesure"}), ("sation " + rows[k + 1][0], set())
        if foot:
            rows.append((foot.replace("@", str(p)), {"entete"}))
        if number:
            rows.append((number.replace("@", str(p)), {"page"}))
        pages.append("\n".join(t for t, _ in rows))
        lines += [t for t, _ in rows]
        kinds += [k for _, k in rows]
    return "\n".join(pages), pages, kinds


def test_lines_of_reports(spark):
    r = random.Random(7)
    rows, truth = [], set()
    for i in range(40):
        text, pages, kinds = make_report(r, r.randint(2, 6), r.choice(["", "Institut Zeta – Bilan", "INSTITUT ZETA | page @"]), r.choice(["", "Ne pas diffuser"]), r.choice(["", "- @ -", "@", "Page @"]))
        rows.append((i, text, pages, "Institut Zeta"))
        truth |= {(i, k + 1, g) for k, kind in enumerate(kinds) for g in kind}
    rows += [(60 + k, "une organisation\nl'organisation", None, None) for k in range(5)]
    rows += [(100, None, None, None), (101, "", [], None), (102, "mot " * 50_000, None, "x"), (103, "seule", ["autre"], "x")]
    df = spark.createDataFrame(rows, "i long, t string, p array<string>, o string").withColumn("id", F.lit("clash"))
    got = {tuple(x) for x in sn.noise_lines(df, "i", "t", "p", ("o",)).collect()}
    for genre in ("entete", "page", "cesure", "erreur"):
        a, b = {x for x in truth if x[2] == genre}, {x for x in got if x[2] == genre and x[0] < 40}
        assert len(a & b) >= 0.9 * len(a) and len(b - a) <= 0.1 * len(a), genre
    fixed = {r.id: r.texte for r in sn.repaired_texts(df, "i", "t", "p", ("o",)).collect()}
    assert fixed[100] is None and fixed[101] == "" and fixed[103] == "seule" and "Ne pas diffuser" not in "".join(fixed[i] for i in range(40))
    assert "organi-" not in "".join(fixed[i] for i in range(40))
    assert sn.noise_lines(df.limit(0), "i", "t", "p", ("o",)).count() == 0


def test_page_lines():
    assert sn.page_lines(["\na", None, "b\nc"], "a\n\nb\nc") == [[0], [1], [2, 3]]
    assert sn.page_lines(["x"], "a\nb") == [[0, 1]] and sn.page_lines(None, "a") == [[0]]


def test_numbers_alone():
    for line, n in (("- 3 -", 3), ("[12]", 12), ("Page l0 / 2O", 10), ("7", 7), ("p. 4", 4), ("3/9", 3)):
        assert sn.number_of(sn.NUMBER_LINE.match(line)[1]) == n
    for line in ("12 votants", "l", "Note 4", "", "S1 2024"):
        assert not sn.NUMBER_LINE.match(line)
