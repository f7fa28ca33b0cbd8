from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from papyrine.llm import mixing, reference_list as rl, splitting

# --- splitting ---------------------------------------------------------------------------------------------------------


def random_text(r, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(r.choice(["mot", "a", "é", "\n", "\n\n", ". ", " ", "long" * r.randint(1, 30), "!", "\f"]))
    return "".join(out)[:n]


@pytest.mark.parametrize("seed", range(12))
def test_pieces_join_up_again(seed):
    r = random.Random(seed)
    text = random_text(r, r.choice([0, 99, 100, 101, 1000, 5000]))
    pieces = splitting.cut(text, 100, 20, splitting.page_starts(None, text))
    assert "".join(text[a:b] for a, b, _, _ in pieces) == text
    for (begin, end, first, _), before in zip(pieces, [None, *pieces], strict=False):
        assert end - first <= 100 and begin - first <= 20 and (before is None or first >= before[0])
    assert len(text) <= 100 or len(pieces) > 1


def test_strongest_boundary_wins():
    text = "a b. c\n" * 10 + "\n" + "a b. c\n" * 10
    place, strength = splitting.midpoint_cut(text, 0, len(text), [])
    assert strength == 1 and text[:place].endswith("\n\n")
    assert splitting.midpoint_cut("x" * 100, 0, 100, []) == (50, 5)
    assert splitting.midpoint_cut(text, 0, len(text), [60])[1] == 0


def test_overlap_begins_at_a_word():
    text = "mots entiers ici " * 40
    for begin, _, first, _ in splitting.cut(text, 120, 30, [])[1:]:
        assert text[first - 1] == " " and 30 - 8 < begin - first <= 30


def test_page_starts():
    assert splitting.page_starts(["ab", None, "cd"], "ab\n\ncd") == [3, 4]
    assert splitting.page_starts(["ab", "cd"], "other") == []
    assert splitting.page_starts(["", "ab"], "ab") == []


def test_split_texts(spark):
    rows = [(1, None), (2, ""), (3, "court"), (4, "z" * 30_000), (5, "a b " * 5000), (5, "a b " * 5000)]
    df = spark.createDataFrame(rows, "r long, t string").withColumns({"id": F.lit("clash"), "pages": F.lit(1)})
    out = splitting.split_texts(df, "r", "t").collect()
    assert {r.id for r in out} == {2, 3, 4, 5} and max(len(r.texte) for r in out) <= 6000
    assert [r.texte for r in out if r.id == 3] == ["court"] and sum(r.id == 5 for r in out) % 2 == 0
    whole = "".join(r.texte[r.chevauchement :] for r in sorted((r for r in out if r.id == 4), key=lambda r: r.rang))
    assert whole == "z" * 30_000
    with pytest.raises(ValueError):
        splitting.split_texts(df, "r", "t", limit=10, overlap=9)
    assert splitting.split_texts(df.limit(0), "r", "t").count() == 0


# --- mixing ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        source = r.choice(["a"] * 8 + ["b"] * 3 + ["c"])
        rows.append((i, source, " ".join(["mot", "phrase", "texte"][k % 3] for k in range(r.randint(3, 40)))))
    rows += [(900, None, "x"), (901, "a", None), (902, "a", ""), (None, "a", "y"), (903, "sans cible", "z z z")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("bac", F.lit("clash"))


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("vide", 0.1, 3)], "source string, part_cible double, repetitions_max int")


def test_shares_hold(corpus, targets):
    chosen, shares = mixing.mix_sources(corpus, targets, "doc_id", "source", "text")
    got = {r.source: r for r in shares.collect()}
    for s, part in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(got[s].part_atteinte - part) < 0.02
    assert got["vide"].n_tokens == 0 and got["vide"].part_atteinte == 0
    caps = {"a": 1, "b": 2, "c": 3}
    rows = chosen.collect()
    assert all(r.repetitions <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    total = sum(r.n_tokens * r.repetitions for r in rows)
    assert total == sum(r.n_tokens for r in got.values())


def test_prefix_by_buckets_equals_a_plain_sort(corpus, targets, spark):
    chosen, shares = mixing.mix_sources(corpus, targets, "doc_id", "source", "text", total_tokens=2000)
    got = {r.doc_id: r.repetitions for r in chosen.collect() if r.source == "a"}
    docs = corpus.where("source = 'a' and doc_id is not null").select("doc_id", "text", mixing.sampling_key(F.col("doc_id"), mixing.quality(F.col("text")), 1).alias("cle"))
    rows = sorted(mixing.token_counts(docs, "text").collect(), key=lambda r: (r.cle, r.doc_id))
    rest, before, expected = 2000 * 0.5 / 0.9, 0, {}
    for r in rows:
        if before + r.n_tokens / 2 <= rest:
            expected[r.doc_id] = 1
        before += r.n_tokens
    assert got == expected


@pytest.mark.parametrize(("budget", "sent"), [(1, 10), (300, 0), (777, 10), (5000, 0)])
def test_any_budget_equals_a_plain_sort(corpus, targets, monkeypatch, budget, sent):
    monkeypatch.setattr(mixing, "FINER", 2)
    monkeypatch.setattr(mixing, "BUCKETS", 1)
    monkeypatch.setattr(mixing, "SENT_TARGETS", sent)
    got = {r.doc_id: r.repetitions for r in mixing.mix_sources(corpus, targets, "doc_id", "source", "text", total_tokens=budget)[0].collect() if r.source == "a"}
    docs = corpus.where("source = 'a' and doc_id is not null").select("doc_id", "text", mixing.sampling_key(F.col("doc_id"), mixing.quality(F.col("text")), 1).alias("cle"))
    rows = sorted(mixing.token_counts(docs, "text").collect(), key=lambda r: (r.cle, r.doc_id))
    rest, before, expected = min(budget * 0.5 / 0.9, sum(r.n_tokens for r in rows)), 0, {}
    for r in rows:
        if before + r.n_tokens / 2 <= rest and r.n_tokens:
            expected[r.doc_id] = 1
        before += r.n_tokens
    empty = {r.doc_id for r in rows if not r.n_tokens}
    assert {k: v for k, v in got.items() if k not in empty} == expected


@pytest.mark.parametrize("weight", [0.05, 0.3, 1.0, 50.0])
def test_no_bucket_holds_much_of_a_source(spark, weight):
    keys = spark.range(200_000).select(mixing.sampling_key(F.col("id"), F.lit(weight), 1).alias("cle"))
    rows = mixing.with_buckets(keys).groupBy("bac").agg(F.count("*").alias("n")).collect()
    fine = mixing.with_buckets(keys).groupBy("bac", "sous").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
    assert max(r.n for r in rows) < 0.006 * 200_000 and fine < 10


def test_odd_weights(spark, targets):
    rows = spark.createDataFrame([(i, "a", "mot " * 9, w) for i, w in enumerate([None, 0.0, -1.0, 5.0, 0.5])], "doc_id long, source string, text string, q double")
    chosen, _ = mixing.mix_sources(rows, targets, "doc_id", "source", "text", total_tokens=10**6, weight=F.col("q"))
    assert {r.doc_id for r in chosen.collect()} == set(range(5))


def test_running_out_is_shown(corpus, targets):
    _, shares = mixing.mix_sources(corpus, targets, "doc_id", "source", "text", total_tokens=10**7)
    for r in shares.collect():
        assert r.n_tokens == r.n_disponibles * r.epoques and (r.source == "vide" or r.epoques == {"a": 1, "b": 2, "c": 3}[r.source])


def test_whole_corpus_runs_out(corpus, targets):
    _, shares = mixing.mix_sources(corpus, targets.withColumn("repetitions_max", F.lit(1)), "doc_id", "source", "text", whole=True)
    got = {r.source: r for r in shares.collect()}
    total = sum(r.n_disponibles for r in got.values())
    for s in "bc":
        assert got[s].n_tokens == got[s].n_disponibles < total * got[s].part_cible / 0.9 and got[s].part_atteinte < got[s].part_cible / 0.9
    assert abs(got["a"].n_tokens - total * 0.5 / 0.9) < 40 and got["vide"].n_tokens == 0


def test_empty_corpus_whole(corpus, targets):
    assert mixing.mix_sources(corpus.limit(0), targets, "doc_id", "source", "text", whole=True)[0].count() == 0


def test_empty_corpus(corpus, targets):
    chosen, shares = mixing.mix_sources(corpus.limit(0), targets, "doc_id", "source", "text")
    assert chosen.count() == 0 and {r.n_tokens for r in shares.collect()} == {0}


# --- reference list ----------------------------------------------------------------------------------------------------

REFERENCE = [
    (1, "label", "Très satisfait(e)", None), (2, "label", "Satisfait(e)", None), (3, "label", "Déçu(e)", None), (4, "label", "Sans opinion", None),
    (11, "nom_formation", "Soins du jardin - niveau 1", "SJ 1"), (12, "nom_formation", "Soins du jardin - niveau 2", None),
    (13, "nom_formation", "Cuisine de saison - initiation", None), (14, "nom_formation", "Cuisine de saison - perfectionnement", "CS PE"), (15, "nom_formation", "Premiers secours", None), (16, None, "x", None), (17, "label", None, None),
]


@pytest.mark.parametrize(
    ("champ", "valeur", "ref"),
    [
        ("nom_formation", "Soins du jardin - niveau 1", 11), ("nom_formation", "SOINS JARDIN, N2", 12), ("nom_formation", "niv. II : Soins du jadrin (groupe A)", 12), ("nom_formation", "Formation Soins du jardin", 0),
        ("nom_formation", "Soins du jardin - niveau 7", 0), ("nom_formation", "s.j. 1", 11), ("nom_formation", "SJ1", 11), ("nom_formation", "cspe", 14), ("nom_formation", "Cuisine de sais. (perf.) S2 2024", 14), ("nom_formation", "initiatoin : Cuisine de saison session de mai", 13),
        ("nom_formation", "Premiers secour", 15), ("nom_formation", "Premiers secours - niveau 1", 0), ("nom_formation", "Poterie", 0), ("nom_formation", "...", 0),
        ("label", "TRES SATISFAIT·E", 1), ("label", "satisfaits", 2), ("label", "Insatisfait(e)", 0), ("label", "Pas satisfait(e)", 0), ("label", "3 - Deçu.e", 3), ("label", "Sans avis/opinion", 4), ("label", "5", 0), ("autre", "Satisfait(e)", 0),
    ],
)
def test_matches(champ, valeur, ref):
    tries = {n: rl.ReferenceTrie([(i, t, a) for i, c, t, a in REFERENCE if c == n and t], n == "nom_formation") for n in ("label", "nom_formation")}
    _, n, got = tries[champ].match(valeur) if champ in tries else (99, 0, 0)
    assert (got if n == 1 else 0) == ref


def test_trie_finds_all_within_distance():
    r = random.Random(6)
    words = sorted({"".join(r.choice("abc ") for _ in range(r.randint(3, 8))).strip() or "abc" for _ in range(150)})
    trie = rl.ReferenceTrie([(i, w, None) for i, w in enumerate(words)], True)
    trie.root = rl.TrieNode()
    for i, w in enumerate(words):
        node = trie.root
        for c in w:
            node = node.children.setdefault(c, rl.TrieNode())
        node.ends.add(i)
    for _ in range(40):
        q = "".join(r.choice("abc ") for _ in range(r.randint(2, 8)))
        assert trie.search(q, 2) == {i: d for i, w in enumerate(words) if (d := rl.edits(q, w, 2)) <= 2}


def test_map_table(spark, monkeypatch):
    values = [(1, "label", 0, "Satisfait(e)"), (1, "label", 1, None), (1, "label", 2, "   "), (2, "nom_formation", 0, "x" * 50_000), (2, "nom_formation", 0, "SJ 1"), (2, "nom_formation", 0, "SJ 1"), (3, "autre", 0, "x"), (3, "nom_formation", 0, "Soins du jardin"), (None, "label", 0, "Déçue")]
    df = spark.createDataFrame(values, "payload_id long, champ string, rang int, valeur string").withColumn("distance", F.lit("clash"))
    ref = spark.createDataFrame(REFERENCE, "ref_id int, champ string, libelle string, sigle string")
    rows = rl.map_to_reference(df, ref)
    got = sorted((r.payload_id or 0, r.champ, r.rang, r.ref_id) for r in rows.collect())
    assert got == [(0, "label", 0, 3), (1, "label", 0, 2), (2, "nom_formation", 0, 0), (2, "nom_formation", 0, 11), (2, "nom_formation", 0, 11), (3, "autre", 0, 0), (3, "nom_formation", 0, 0)]
    assert {(r.champ, r.n) for r in rl.unmatched(rows).collect()} == {("autre", 1), ("nom_formation", 1)}
    assert rl.map_to_reference(df.limit(0), ref).count() == 0


#: Titles that need the whole list: levels of one title, the contrary of an entry, an acronym beside a near title.
FAMILIES = [(20, "nom_formation", "Gestion de projet", None), *((20 + k, "nom_formation", f"Gestion de projet - niveau {k}", f"GP{k}") for k in range(2, 8)), (30, "label", "Satisfait", None), (31, "label", "Insatisfait", None), (32, "label", "Complet", None)]


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_parts_of_a_list_answer_as_the_whole(spark, monkeypatch, limit):
    typed = ["Gestion de projet", "Gestion de projet niv 3", "gestion projet", "GP4", "stage GP4", "Gestoin de projet - n9", "x" * 5000, "Poterie", "Soins du jardin", "SJ1", "Cuisine de saison", "cspe"]
    labels = ["Insatisfait", "insatisfaite", "incomplet", "satisfait", "avis/complet", "Sans opinion", "Deçu(e)"]
    values = [(i, c, k, v) for i, (c, v) in enumerate([("nom_formation", t) for t in typed] + [("label", t) for t in labels] + [(None, "x"), ("autre", "Poterie")]) for k in (0, 0, 1)]
    df = spark.createDataFrame(values, "payload_id long, champ string, rang int, valeur string")
    ref = spark.createDataFrame(REFERENCE + FAMILIES, "ref_id int, champ string, libelle string, sigle string")
    told = lambda: sorted((r.payload_id, r.rang, r.ref_id, tuple(map(tuple, r.candidats))) for r in rl.map_to_reference(df, ref).collect())
    whole = told()
    assert len(whole) == len(values) and {r[2] for r in whole if r[0] == 0} == {20} and {r[2] for r in whole if r[0] == 3} == {24}
    monkeypatch.setattr(rl, "ENTRIES_A_PASS", limit)
    assert told() == whole


NEAR_TITLES = [
    (41, "nom_formation", "Lecture de plans - niveau 1", "LPTEC 1"), (42, "nom_formation", "Lecture de plans - niveau 2", "LPTEC 2"), (43, "nom_formation", "Lecture de plan - niveau 2", None),
    (44, "nom_formation", "Formation de formateurs - niveau 1", None), (45, "nom_formation", "Perfectionnement", None), (46, "nom_formation", "Gestion intra", None), (47, "nom_formation", "Gestion", None), (48, "nom_formation", "Gestion - niveau 3", None),
    (51, "label", "Très satisfait(e)", None), (52, "label", "Trop satisfait(e)", None), (53, "label", "Complet", None), (54, "label", "Complets", None),
]


@pytest.mark.parametrize(
    ("champ", "valeur", "ref", "near"),
    [
        ("nom_formation", "Lecture de plans - niveau 2", 42, {42: 0, 43: 1, 41: 1}), ("nom_formation", "Niv. 2 : lecture de plans", 42, {42: 0, 43: 1}), ("nom_formation", "lptec2", 42, {42: 0, 41: 1}), ("nom_formation", "LPTEC 2 (groupe A)", 0, {42: 0, 41: 1}),
        ("nom_formation", "Formation de formateurs niveau 1 (groupe A)", 44, {44: 0}), ("nom_formation", "perfectionement", 45, {45: 0}), ("nom_formation", "...", 0, {}), ("nom_formation", "Stage gestion intra", 0, {46: 0, 47: 0, 48: 0}), ("nom_formation", "Gestion", 47, {47: 0, 48: 0}),
        ("label", "Très satisfait(e)", 51, {51: 0, 52: 2}), ("label", "Très insatisfait(e)", 0, {51: 2}), ("label", "complet", 53, {53: 0, 54: 1}), ("label", "Complett", 0, {53: 1, 54: 1}),
    ],
)
def test_every_entry_within_the_distance_is_a_candidate(champ, valeur, ref, near):
    trie = rl.ReferenceTrie([(i, t, a) for i, c, t, a in NEAR_TITLES if c == champ], champ == "nom_formation")
    _, n, first, every = rl.resolve(trie.levels(valeur), [trie.facts(valeur)])
    assert dict(every) == near
    assert (first if n == 1 else 0) == ref


@pytest.mark.parametrize("leveled", [True, False])
def test_candidates_hold_all_that_brute_force_finds(leveled):
    r = random.Random(8)
    words = ["plans", "plan", "niveau 1", "niveau 2", "initiation", "de", "formation", "intra", "satisfait", "insatisfait", "lot", "lots", "lit", "niveau 3", "session 2"]
    titles = sorted({" ".join(r.choices(words, k=r.randint(1, 2))) for _ in range(400)})
    trie = rl.ReferenceTrie([(i, t, None) for i, t in enumerate(titles)], leveled)
    missed, seen = [], 0
    for _ in range(150):
        value = list(r.choice(titles))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(value))
            value[k : k + r.randint(0, 1)] = r.choice(["", "a", "s", " "])
        typed = rl.plain("".join(value))
        most = rl.allowed(len(typed))
        every = dict(rl.resolve(trie.levels(typed), [trie.facts(typed)])[3])
        within = {i: d for i, t in enumerate(titles) if (d := rl.edits(typed, t, most)) <= most}
        seen += len(within)
        missed += [(typed, titles[i]) for i, d in within.items() if every.get(i, 99) > d]
    assert not missed and seen > 200


def brute_walk(paths, query, most):
    """Distances by whole rows, a shortened word's end free."""
    found = {}
    for k, path in enumerate(paths):
        rows = [[sum(q != rl.REST for q in query[:j]) for j in range(len(query) + 1)]]
        for i, c in enumerate(path, 1):
            row = [i]
            for j, q in enumerate(query, 1):
                d = min(row[-1], rows[-1][j] + (c == " ")) if q == rl.REST else min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (q != c))
                if q != rl.REST and i > 1 and j > 1 and q == path[i - 2] and query[j - 2] == c:
                    d = min(d, rows[-2][j - 2] + 1)
                row.append(d)
            rows.append(row)
        if rows[-1][-1] <= most:
            found[k] = rows[-1][-1]
    return found


@pytest.mark.parametrize("letters", ["ab ", "abc* "])
def test_walk_equals_whole_rows(letters):
    r = random.Random(9)
    paths = sorted({"".join(r.choices("abc ", k=r.randint(1, 9))) for _ in range(200)})
    root = rl.TrieNode()
    for k, path in enumerate(paths):
        root.add(path, k)
    for most in (0, 1, 2):
        for _ in range(60):
            query = "".join(r.choices(letters, k=r.randint(0, 9)))
            assert rl.walk(root, query, most) == brute_walk(paths, query, most)


def test_a_long_value_of_frames_only_ends():
    trie = rl.ReferenceTrie([(1, "Soins du jardin - niveau 1", "SJ 1")], True)
    for value in ("stage " * 8000 + "intra " * 8000, "groupe a " * 8000, "stage a " * 8000):
        assert trie.match(value) == (99, 0, 0)


@pytest.mark.parametrize("limit", [1, 3])
def test_parts_give_the_same_candidates(spark, monkeypatch, limit):
    typed = ["Lecture de plans - niveau 2", "lptec2", "Formation de formateurs niveau 1 (groupe A)", "Perfectionnement", "Gestion", "Stage gestion intra"]
    values = [(i, c, 0, v) for i, (c, v) in enumerate([("nom_formation", t) for t in typed] + [("label", t) for t in ("Très satisfait(e)", "Très insatisfait(e)", "complet")])]
    df = spark.createDataFrame(values, "payload_id long, champ string, rang int, valeur string")
    ref = spark.createDataFrame(NEAR_TITLES, "ref_id int, champ string, libelle string, sigle string")
    told = lambda: sorted((r.payload_id, r.ref_id, tuple(map(tuple, r.candidats))) for r in rl.map_to_reference(df, ref).collect())
    whole = told()
    assert [len(r[2]) for r in whole] == [3, 2, 1, 1, 2, 3, 2, 1, 2] and whole[6] == (6, 51, ((51, 0), (52, 2)))
    monkeypatch.setattr(rl, "ENTRIES_A_PASS", limit)
    assert told() == whole
