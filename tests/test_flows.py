from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from papyrine.sources import readers, sinks
from papyrine.streaming import flows
from papyrine.worktable import release, shared_folder, worktable


def test_append_is_not_repeated(spark, tmp_path):
    df = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], "hash string, n string")
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    assert sinks.append_rows(df, ["n", "x"], out, ledger) == sinks.Appended(2, 3)
    assert sinks.append_rows(df, ["n", "x"], out, ledger) == sinks.Appended(0, 3)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("a", ""), ("b", "")}


def test_documents_replace_by_name(spark, tmp_path):
    path = str(tmp_path / "docs")
    for rows in ([("a", "1"), ("b", "2")], [("a", "3")]):
        sinks.write_documents(spark.createDataFrame(rows, "nom string, raw string"), path, "nom", "raw")
    assert {(r.nom, r.json) for r in spark.read.parquet(path).collect()} == {("a", "3"), ("b", "2")}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1, "a")], "k int, t int, v string")
    sinks.upsert(df, path, ["k"], ["t"]).write.parquet(path)
    assert {tuple(r) for r in sinks.upsert(spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], "k int, t int, v string"), path, ["k"], ["t"]).collect()} == {(1, 2, "b"), (2, 1, "c")}


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(i, f"t{i % 3}") for i in range(20)], "i int, n string").write.parquet(src)
    prepare = lambda df: df.withColumn("hash", F.sha2("n", 256))
    for _ in range(2):
        flows.stream_rows(spark, src, "i int, n string", prepare, ["n"], str(tmp_path / "out"), str(tmp_path / "ledger"), str(tmp_path / f"cp{uuid.uuid4()}")).awaitTermination()
    assert sorted(r.c0 for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["t0", "t1", "t2"]


def test_json_documents(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "a.json").write_text("{oops")
    (tmp_path / "c.txt").write_text("x")
    rows = readers.json_documents(spark, str(tmp_path)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.valide) for r in rows} == {("b.json", True), ("a.json", False)}
    assert [r.nom for r in readers.files(spark, str(tmp_path), "*.json").orderBy("nom").collect()] == ["a.json", "b.json"]


def test_unreadable_pdf_is_a_row(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-broken")
    r = readers.pdf_reports(spark, str(tmp_path)).first()
    assert r.pages is None and r.error and r.full_text == "" and r.page_count == 0 and not r.is_large_pdf


def test_empty_header_is_an_error(spark, tmp_path):
    (tmp_path / "h.csv").write_text(" a ,b\n1,2\n")
    assert readers.csv_headers(spark, str(tmp_path / "h.csv")) == ["a", "b"]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(Exception):  # noqa: B017
        readers.csv_headers(spark, str(tmp_path / "e.csv"))


def test_worktable_cuts_lineage(spark):
    t = worktable(spark.range(5), "t")
    assert t.count() == 5 and shared_folder(spark)
    assert release(spark) >= 1


def test_empty_records_are_not_appended(spark, tmp_path):
    df = spark.createDataFrame([("h1", "{}"), ("h2", '{"a":1}'), ("h3", None), ("h4", "[1]")], "hash string, raw string")
    assert sinks.append_rows(df, ["hash"], str(tmp_path / "out"), str(tmp_path / "ledger"), raw="raw") == sinks.Appended(1, 2)


def test_records_by_name_and_term(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(" Lecture ", "S1 2025", json.dumps({"Nom_formation": "Lecture", "a_chaud": None, "x": 1})), ("B", "S2", "no json")]
    sinks.write_records(spark.createDataFrame(rows, "n string, t string, raw string"), path, "n", "t", "raw")
    got = spark.read.parquet(path).collect()
    assert [(r.nom, json.loads(r.json)) for r in got] == [("Lecture_S1_2025.json", {"Nom formation": "Lecture"})]


def test_row_goes_below_the_table():
    plan = sinks.plan_table_append("$C$3:F7", ["a", "b", "a", "z"], {"a": [1, None, " ", "x"], "b": {"k": "é"}, "q": 1})
    assert plan.ref == "C3:F8" and plan.row == 8 and plan.keys_without_column == ["q"] and plan.columns_without_value == ["z"]
    assert plan.cells == {(8, 3): "", (8, 4): '{"k": "é"}', (8, 5): "1 • x", (8, 6): ""}
    assert sinks.table_bounds("AA1") == (27, 1, 27, 1) and sinks._column_letters(27) == "AA" and sinks._column_letters(702) == "ZZ"
    with pytest.raises(ValueError):
        sinks.table_bounds("oops")


def test_settings_and_parameters(spark, monkeypatch):
    monkeypatch.setenv("PAPYRINE_TEST", "env")
    assert readers.setting(spark, "papyrine.test", "PAPYRINE_TEST") == "env" and readers.setting(spark, "papyrine.test", "NOPE", "d") == "d"
    spark.conf.set("papyrine.test", "conf")
    assert readers.setting(spark, "papyrine.test", "PAPYRINE_TEST") == "conf" and readers.setting(spark, "papyrine.test", "PAPYRINE_TEST", order=("env", "conf")) == "env"
    spark.conf.unset("papyrine.test")
    with pytest.raises(ValueError, match="semestre"):
        readers.require(nom="x", semestre=" ")
    with pytest.raises(ValueError):
        readers.setting(spark, "papyrine.test", "NOPE")
    readers.require(nom="x", semestre="S1")


def test_listing_is_sorted(spark, tmp_path):
    for n in ("b.json", "Z.json", "é.json", "a.txt"):
        (tmp_path / n).write_text("{}")
    assert readers.listing(spark, str(tmp_path)) == ["Z.json", "b.json", "é.json"]


def test_whole_way_from_text_to_record(spark, tmp_path):
    from papyrine.operators import narrative

    (tmp_path / "p.txt").write_text("Lis : {{PDF_TEXT}} {{PDF_METADATA}}")
    template = narrative.read_prompt(str(tmp_path / "p.txt"))

    def make():
        return lambda p: 'Réponse {"Nom formation": "' + p[6:11] + '", " semestre": "S1", "lien_vers_formation": "x", "a_froid": {"note_sur_10": "8,5"}} .' if "texte" in p else "pas de JSON"

    df = spark.createDataFrame([(1, "texte un"), (2, "autre"), (3, ""), (4, None)], "i int, t string")
    rows = {r.i: r for r in narrative.extract_records(df, "t", F.lit("{}"), template, make).collect()}
    assert json.loads(rows[1].json)["a_froid"] == {"note_sur_10": 8.5} and rows[1].erreurs == [] and rows[1].debut is None
    assert rows[2].json is None and rows[2].erreurs == ["json"] and rows[2].debut == "pas de JSON" and rows[3].erreurs == rows[4].erreurs == ["json"]
    with pytest.raises(FileNotFoundError):
        narrative.read_prompt(str(tmp_path / "nope"))
