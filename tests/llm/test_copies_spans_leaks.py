from __future__ import annotations

import json
import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from papyrine.llm import formatting_copies as fc
from papyrine.llm import leaked_items, shared_spans, textbuf

LISTS = ("a", "b")


def canonical(text):
    return "".join(c.lower() for c in text if not (c.isspace() or unicodedata.category(c)[0] in "PZ" or unicodedata.category(c) in ("Cc", "Cf")))


def copies(spark, rows):
    df = spark.createDataFrame(rows, "i long, raw string").withColumns({"id": F.lit("clash"), "h1": F.lit(0), "members": F.lit(None).cast("string")})
    return {tuple(r) for r in fc.formatting_copies(df, "i", "raw", "s", LISTS).collect()}


def test_copies_against_brute_force(spark):
    r = random.Random(1)
    rows, groups = [], defaultdict(list)
    for i in range(3000):
        base = [[r.choice(["Été chaud", "hiver", "l'eau", ""]) for _ in range(r.randint(0, 2))] for _ in LISTS]
        noisy = [["".join(r.choice([c, c.upper(), c + r.choice(" ., —")]) if c.upper().lower() == c else c for c in t) for t in x] for x in base]
        doc = {"s": r.choice("xy"), **{k: (v or r.choice([None, []])) for k, v in zip(LISTS, noisy, strict=True)}}
        if r.random() < 0.2:
            doc = dict(reversed(doc.items()))
        rows.append((i, json.dumps(doc, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2]))))
        groups[(canonical(doc["s"]), *(tuple(map(canonical, v)) for v in noisy))].append(i)
    expected = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    assert copies(spark, rows) == expected


def test_copies_edge_cases(spark):
    same = json.dumps({"s": "k", "a": ["x"]})
    rows = [
        (1, None), (2, None), (3, "{oops"), (4, "{oops"), (5, "{ oops!"), (6, same), (6, same), (7, json.dumps({"s": "k", "a": ["é"]})), (8, json.dumps({"s": "k", "a": ["e"]})),
        (9, json.dumps({"a": ["x", None], "s": "K "})), (10, json.dumps({"s": "k", "a": ["x", ""]})), (11, json.dumps({"s": "k", "b": ["x"]})), (None, same), (12, "[1]"), (13, json.dumps({"s": "k", "a": "x"})),
        (14, json.dumps({"s": "k", "a": ["y" * 200_000]})), (15, json.dumps({"s": "k", "a": ["Y" * 200_000 + "."]})),
    ]
    got = copies(spark, rows)
    assert (3, 4) in got and (6, 9) in got and (6, 13) in got and (14, 15) in got and (6, 6) in got
    assert not {7, 8, 10, 11, 12, 1, 2} & {c for _, c in got}
    assert copies(spark, []) == set()


def test_hot_group_is_split_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(i, json.dumps({"s": "h", "a": ["Bon" + "." * (i % 7)]})) for i in range(1000)] + [(2000 + i, json.dumps({"s": f"u{i}"})) for i in range(500)]
        df = spark.createDataFrame(rows, "i long, raw string").repartition(6)
        found = fc.formatting_copies(df, "i", "raw", "s", LISTS)
        assert {tuple(r) for r in found.collect()} == {(0, i) for i in range(1, 1000)}
        assert [tuple(r) for r in fc.copy_counts(found).collect()] == [(0, 1000)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_two_pointers():
    assert fc.same_apart_from_layout("A-b c", "ab.C!") and not fc.same_apart_from_layout("abc", "abcd") and not fc.same_apart_from_layout("é", "e")
    assert fc.same_apart_from_layout("", " .,") and fc.same_apart_from_layout("a" * 10_000 + ".", "A" * 10_000)


def test_hashes_agree_with_folding():
    texts = ["Bon-jour", "BONJOUR !", "bonsoir", "", " . ", "été", "Été", "a" * 70_000]
    h = fc.fold_hashes(texts, 0)
    assert h[0] == h[1] and h[3] == h[4] and h[5] == h[6] and len(set(h.tolist())) == 5


def test_rolling_hash_and_sliding_min():
    cps = textbuf.code_points("abcabcabd😀é")
    roll = textbuf.Rolling(cps)
    import numpy as np

    h = roll.at(np.arange(len(cps) - 2), 3)
    assert h[0] == h[3] and h[0] != h[6]
    v = np.array([5, 3, 8, 1, 9, 2, 7])
    for w in (1, 2, 3, 7):
        assert textbuf.sliding_min(v, w).tolist() == [min(v[i : i + w]) for i in range(len(v) - w + 1)]


# --- spans -----------------------------------------------------------------------------------------------------------


def brute_pairs(docs, n):
    seen = defaultdict(set)
    for i, t in docs:
        for s in range(len(t or "") - n + 1):
            seen[t[s : s + n]].add(i)
    return {(a, b) for g in seen.values() for a in g for b in g if a < b}


def noise(r, n):
    return "".join(r.choice("abcdefghij klmnopé") for _ in range(n))


@pytest.mark.parametrize("limits", [{}, {"hot": 1}, {"hot": 3}, {"hot_members": 1}, {"hot": 2, "hot_members": 2}])
def test_spans_against_brute_force(spark, monkeypatch, limits):
    if limits.get("hot") == 3:
        monkeypatch.setattr(shared_spans, "SENT_ANCHORS", 0)
    r = random.Random(2)
    shared = [noise(r, k) for k in (64, 65, 80, 120, 200, 400)]
    docs = []
    for i in range(80):
        parts = [noise(r, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            cut = r.randint(0, 20) if r.random() < 0.5 else 0
            parts += [p[cut:], noise(r, r.randint(0, 30))]
        docs.append((i, "".join(parts)))
    alone = noise(r, 150)
    docs += [(100, None), (101, ""), (102, "x" * 63), (103, "ab" * 100), (104, "ab" * 60), (105, docs[0][1]), (106, docs[0][1]), (107, alone + "-" + alone + "+" + alone)]
    df = spark.createDataFrame(docs, "d long, t string").withColumns({"id": F.lit(1), "text": F.lit("clash"), "unit": F.lit("clash")})
    runs = shared_spans.shared_runs(df, "d", "t", 64, **limits)
    expected = brute_pairs(docs, 64)
    assert expected and {tuple(x) for x in shared_spans.sharing_pairs(runs).collect()} == expected
    assert {tuple(x) for x in shared_spans.sharing_pairs(runs, hot=2, salts=3).collect()} == expected
    members = defaultdict(set)
    for x in shared_spans.sharing_sets(runs).collect():
        members[x.groupe].add(x.doc_id)
    assert all(len(m) > 1 for m in members.values()) and {(a, b) for m in members.values() for a in m for b in m if a < b} == expected
    got = {x.doc_id: x for x in shared_spans.shared_part(runs, df, "d", "t", 64).collect()}
    where = defaultdict(set)
    for i, t in docs:
        for s in range(len(t or "") - 63):
            where[t[s : s + 64]].add(i)
    spans = []
    for i, t in docs:
        sets = [frozenset(where[t[s : s + 64]]) for s in range(len(t or "") - 63)]
        covered = {s + k for s, w in enumerate(sets) if len(w) > 1 for k in range(64)}
        assert got[i].n_partages == len(covered)
        heads = [s for s, w in enumerate(sets) if len(w) > 1 and (s == 0 or sets[s - 1] != w)]
        for s in heads:
            e = s
            while e + 1 < len(sets) and sets[e + 1] == sets[s]:
                e += 1
            spans.append((i, s, e + 64, len(sets[s])))
    assert sorted(tuple(x) for x in shared_spans.shared_spans(runs, 64).select("doc_id", "debut", "fin", "n_textes").collect()) == sorted(spans)


def test_windows_of_equal_hash_are_compared(monkeypatch):
    import numpy as np

    monkeypatch.setattr(textbuf.Rolling, "at", lambda self, begin, length: np.zeros(len(begin), np.uint64))
    which, place, group = shared_spans.window_groups(["abcabcd", "xbcabcd"], 4)
    texts = [("abcabcd", "xbcabcd")[w][p : p + 4] for w, p in zip(which, place, strict=True)]
    assert [texts.index(t) for t in texts] == [texts.index(texts[g]) for g in group] and len(set(group.tolist())) == len(set(texts))


def test_no_texts_share_nothing(spark):
    df = spark.createDataFrame([], "d long, t string")
    assert shared_spans.sharing_pairs(shared_spans.shared_runs(df, "d", "t")).count() == 0
    with pytest.raises(ValueError):
        shared_spans.shared_runs(df, "d", "t", 10)


# --- leaks -----------------------------------------------------------------------------------------------------------


def split_words(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain).split()


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["été", "l'eau", "vanne", "porte", "bleue", "quai", "deux", "fois", "carnet", "clé", "16", "poste"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 30)))) for i in range(30)] + [(90, None), (91, ""), (92, "court")]
    docs = []
    for d in range(150):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))
        if r.random() < 0.6:
            w = (r.choice(items[:30])[1]).split()
            a = r.randint(0, 8)
            text += "\n" + r.choice(["{}", "{} ?", "({})"]).format(" ".join(w[a : a + r.randint(8, 25)]).upper().replace(" ", r.choice([" ", ", ", "\n"])))
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "vanne " * 30_000)]
    grams = defaultdict(set)
    for i, t in items:
        w = split_words(t or "")
        n = min(12, len(w))  # a shorter item is one passage
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(i)
    expected = set()
    for d, t in docs:
        w = split_words(t or "")
        expected |= {(d, i) for n in range(1, 13) for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id int, texte string")
    found = leaked_items.leaked_items(df, it).where("n_fenetres_egales > 0")
    assert expected and {(x.doc_id, x.item_id) for x in found.collect()} == expected
    assert leaked_items.leaked_items(df.limit(0), it).count() == 0 and leaked_items.leaked_items(df, it.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 10**6])
def test_near_leaks_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(leaked_items, "SENT_MATCHES", sent)
    r = random.Random(7)
    vocabulary = [f"mot{i}" for i in range(400)]
    items = [(f"i{i}", " ".join(r.choice(vocabulary) for _ in range((3, 9, 20, 60, 90, 120)[i % 6]))) for i in range(25)] + [("vide", " ?!"), ("nul", None)]
    docs = []
    for d in range(500):
        w = r.choice(items[:25])[1].split()
        for _ in range(r.randint(0, 2)):  # a word changed, lost or put in
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[r.choice(vocabulary)], [], [w[k], r.choice(vocabulary)]])
        docs.append((f"d{d}", " ".join([*(r.choice(vocabulary) for _ in range(r.randint(0, 30))), *w, *(r.choice(vocabulary) for _ in range(r.randint(0, 30)))])))

    def grams(w):
        g = min(5, len(w))
        out = defaultdict(int)
        for k in range(len(w) - g + 1):
            out[tuple(w[k : k + g])] += 1
        return out

    truth = {}
    for d, t in docs:
        w = split_words(t)
        for i, x in items[:25]:
            y = split_words(x)
            have, best = grams(y), 0.0
            for k in range(len(w) - len(y) + 1):
                g = grams(w[k : k + len(y)])
                common = sum(min(n, have.get(s, 0)) for s, n in g.items())
                best = max(best, common / (sum(g.values()) + sum(have.values()) - common))
            if best >= 0.8:
                truth[d, i] = best
    it = spark.createDataFrame(items, "item_id string, texte string")
    found = {(x.doc_id, x.item_id): x.similarite for x in leaked_items.leaked_items(spark.createDataFrame(docs, "doc_id string, text string"), it).collect() if x.similarite > 0}
    assert all(truth[k] == pytest.approx(v) for k, v in found.items())
    near = {k for k, v in truth.items() if v < 1}
    assert len(near) > 30 and len(near & set(found)) >= 0.9 * len(near) and {k for k, v in truth.items() if v == 1} <= set(found)
    assert {x.item_id for x in leaked_items.unsearchable(it).collect()} == {"vide", "nul"}


def test_no_fingerprint_within_radius_is_missed(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(200)]
    near = []
    for blocks, radius in ((leaked_items.PASSAGE_BLOCKS, leaked_items.PASSAGE_RADIUS), (leaked_items.WHOLE_BLOCKS, leaked_items.WHOLE_RADIUS)):
        for k, p in enumerate(base):
            q = p & ((1 << 64) - 1)
            for b in r.sample(range(64), radius):
                q ^= 1 << b
            near.append((k, p, q - (1 << 64) if q >> 63 else q))
        df = spark.createDataFrame(near, "k int, p long, q long")
        flips = blocks == leaked_items.WHOLE_BLOCKS
        held = df.select("k", F.inline(leaked_items._block(F.col("p"), blocks, 0, flips)))
        asked = df.select("k", F.inline(leaked_items._block(F.col("q"), blocks, 0)))
        assert held.join(asked, ["k", "bloc", "cle"]).select("k").distinct().count() == 200
        near = []
