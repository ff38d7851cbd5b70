"""Resolution, sources, sinks, adjudication and streaming on small tables."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from citeweave.operators import adjudicate as A
from citeweave.operators import extract as X
from citeweave.operators import metrics as M
from citeweave.operators import resolve as R
from citeweave.operators import sampling as P
from citeweave.operators import synth
from citeweave.sources import readers, writers
from citeweave.streaming import ingest

RECORDS = [
    (0, "principal", "acordao", "STJ", "RECURSO ESPECIAL Nº 1.599.372 - SP (2016/1)"), (1, "agint", "acordao", "STJ", "AgInt no RECURSO ESPECIAL Nº 1.599.372 - SP (2016/1)"),
    (2, "edv", "acordao", "STJ", "AgInt nos EMBARGOS DE DIVERGÊNCIA EM RECURSO ESPECIAL Nº 1.599.372 - SP"), (3, "stf", "acordao", "STF", "PLENÁRIO EMB.DECL. NO AG.REG. EM MANDADO DE SEGURANÇA 32.714 MATO GROSSO RELATORA"),
    (4, "s211", "sumula", "STJ", "Súmula n. 211 do STJ : x"), (5, "sv10", "sumula", "STF", "Súmula Vinculante n. 10 do STF : x"), (6, "s7", "sumula", "STJ", "Súmula n. 7 do STJ : x"),
    (7, "a93", "dispositivo", None, "Artigo 93 da Constituicao Federal de 1988 Art. 93. x"), (8, "a373", "dispositivo", None, "Artigo 373 da Lei n 13.105, de 16 de março de 2015 Art. 373. x"),
]
EXPECTED = {
    "REsp 1.599.372/SP": ("real", "principal"), "AgInt no REsp 1.599.372": ("real", "agint"), "AgInt nos EDv em REsp 1.599.372": ("real", "edv"), "REsp 9.999.999": ("inventada", None),
    "ED no AgR no MS 32714": ("real", "stf"), "5úmula 211": ("real", "s211"), "Súmula 211 do TSE": ("inventada", None), "Súmula Vinculãnte 10": ("real", "sv10"), "Súmula 07": ("real", "s7"),
    "art. 93 da CF": ("real", "a93"), "art. 373 do CPC": ("real", "a373"), "art. 999 do CPC": ("inventada", None), "Tema 725": ("inventada", None), "julgado do STJ de 2021, relatoria de X": ("incompleta", None),
}


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "ord long, id string, nature string, court string, text string")


def test_resolution(spark, records):
    rows = spark.createDataFrame(list(enumerate(EXPECTED)), "cit int, quote string")
    out = R.classify(R.resolve(rows, records, ["cit"])).collect()
    assert {r.quote: (r.verdict, r.id) for r in out} == EXPECTED
    assert {r.bucket for r in out if r.quote == "Tema 725"} == {"dispositivo|inventada|regra"}


def test_ties_without_a_criterion_take_the_first(spark, records):
    rows = spark.createDataFrame([(1, "processo 1.599.372")], "cit int, quote string")
    r = R.classify(R.resolve(rows, records, ["cit"])).first()
    assert (r.id, len(r.ids), r.bucket, r.confidence) == ("principal", 3, "processo|real_ambiguo|regra", 0.5)


def test_bands_and_measured_confidence(spark):
    rows = spark.createDataFrame([(["a"], "sumula", None), (["a"], "sumula", 0.98), ([], "vaga", 0.9799)], "ids array<string>, via string, conf double")
    measured = spark.createDataFrame([("sumula|real|alta", 0.5)], "bucket string, p double")
    out = {r.bucket: r.confidence for r in R.classify(rows, "conf", measured).collect()}
    assert out == {"sumula|real|regra": 0.93, "sumula|real|alta": 0.5, "vaga|incompleta|baixa": 0.95}


def test_sqlite_records(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "r.db")
    con.execute("CREATE TABLE documentos (id TEXT, natureza TEXT, tribunal TEXT, ano INTEGER, relator TEXT, texto TEXT)")
    con.executemany("INSERT INTO documentos VALUES (?,?,?,?,?,?)", [("b", "acordao", None, 2001, None, "é\r\n"), ("a", "sumula", "STJ", None, "x", "")])
    con.commit()
    con.close()
    rows = readers.read_records(spark, str(tmp_path / "r.db"), partitions=2).orderBy("ord").collect()
    assert [(r.id, r.ano, r.texto) for r in rows] == [("b", 2001, "é\r\n"), ("a", None, "")]
    assert readers.read_records(spark, str(tmp_path / "r.db"), "sumula").count() == 1


def test_documents_are_read_byte_for_byte(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nfim\r\n".encode())
    (tmp_path / "b.txt").write_bytes("ação".encode("cp1252"))
    (tmp_path / "c.md").write_bytes(b"no")
    rows = readers.read_documents(spark, str(tmp_path)).collect()
    assert {(r.name, r.text, r.recoded) for r in rows} == {("a", "é\r\nfim\r\n", False), ("b", "ação", True)}
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "empty"))


def test_gold_and_recordings(spark, tmp_path):
    head = "nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico"
    (tmp_path / "g.csv").write_text("﻿" + head + '\n1,d1,c1,0,5,"a ""b""\nc",lei,real,7 8\n', encoding="utf-8")
    g = readers.read_gold(spark, str(tmp_path / "g.csv")).first()
    assert (g.nivel, g.trecho, g.id_canonico) == (1, 'a "b"\nc', "7 8")
    lines = ['{"meta": {}}', '{"conjunto": "x", "id": "1", "segundos": 0.5, "spans": [[0, 3, "JURIS"], [4, 6, "LEI", 0.9], [7, 9, "cnj", "123", "t", 0.8]]}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text(lines[0] + '\n{"conjunto": "x", "id": "2", "segundos": 1.5, "spans": []}')
    rows = {r.id: r for r in readers.read_recordings(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).collect()}
    assert [tuple(s) for s in rows["1"].spans] == [(0, 3, "JURIS", None), (4, 6, "LEI", 0.9), (7, 9, "cnj", 0.8)] and rows["2"].spans == []


def test_outputs(spark, tmp_path):
    rows = [(1, 5, 9, "abcd", "lei", "real", "x", 0.93456), (1, 0, 3, "é", "lei", "inventada", None, 0.8)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, quote string, type string, verdict string, id string, confidence double")
    out = R.assemble(df)
    body = json.loads(out.first()["json"])
    assert [c["id"] for c in body["citacoes"]] == ["c1", "c2"] and body["citacoes"][0]["resolucao"] is None and body["citacoes"][1]["confianca"] == 0.9346
    writers.write_documents(out, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "1.json").read_text(encoding="utf-8")) == body
    docs = spark.createDataFrame([("1",), ("2",)], "name string")
    assert {r.documento_id: len(r.citacoes) for r in readers.read_predictions(spark, str(tmp_path / "out"), docs).collect()} == {"1": 2, "2": 0}
    cells = {r.doc_id: r.cell for r in writers.packed_cells(df, "doc_id", [F.col("start"), F.col("end")], "start").collect()}
    assert cells == {1: "0,3|5,9"} and len(writers.write_recording(df, str(tmp_path / "rec")).first()[0]) == 64
    assert "| 1 |" in writers.markdown(df.select("doc_id"), "t")


def test_bio(spark):
    words = [(1, i, a, b) for i, (a, b) in enumerate([(0, 2), (3, 5), (6, 8), (9, 11), (12, 12), (13, 15)])]
    tokens = spark.createDataFrame(words, "doc_id long, i int, start int, end int")
    gold = spark.createDataFrame([(1, 3, 8, "JURIS"), (1, 9, 11, "LEI")], "doc_id long, start int, end int, label string")
    labels = X.encode_bio(tokens, gold)
    assert [r.label for r in labels.orderBy("i").collect()] == ["O", "B-JURIS", "I-JURIS", "B-LEI", None, "O"]
    assert {tuple(r) for r in X.decode_bio(labels).collect()} == {(1, 3, 8, "JURIS"), (1, 9, 11, "LEI")}
    scored = X.span_confidence(gold, labels.withColumn("prob", F.col("i") / 10))
    assert {(r.start, round(r.conf, 6)) for r in scored.collect()} == {(3, 0.15), (9, 0.3)}


def test_adjudication(spark):
    span = "array<struct<start:int,end:int,kind:string>>"
    text = "Ver o REsp 1.234/SP, Rel. Min. X, e o RE 77; art. 5 e art. 7 do CPC; Tema 9 da RG; nada; súmulas 5 e 6"
    at = lambda q, k, end="": (text.index(q), text.index(end or q) + len(end or q), k)
    j = at("REsp 1.234/SP", "JURIS")
    divergent = [
        at("REsp 1.234/SP, Rel. Min. X", "JURIS"),  # alone: cut after the state's code
        at("o RE 77", "JURIS"), at("RE 77", "JURIS"),  # one envelope
        at("art. 7", "LEI"), at("art. 7 do CPC", "LEI"),  # the law's name stays
        at("Tema 9", "JURIS"), at("Tema 9 da RG", "VAGA"),  # the qualifier stays
        at("nada", "JURIS"),  # without a digit it goes
        at("súmulas 5 e 6", "JURIS"), at("súmulas 5", "JURIS"), at("6", "JURIS"),
        at("art. 5 e", "LEI", "art. 5 e"),  # agreed already
    ]
    divergent[-3] = (text.rindex("súmulas 5"), text.rindex("súmulas 5") + 9, "JURIS")
    divergent[-2] = (len(text) - 1, len(text), "JURIS")
    agreed = [at("art. 5", "LEI")]
    rows = [(1, text, agreed, divergent, None), (2, "ab 12 cd", [], [(0, 5, "JURIS"), (3, 8, "VAGA")], [(3, 8, "VAGA")]), (3, "ab 12 cd", [], [(0, 5, "JURIS"), (3, 8, "LEI")], [])]
    rows += [(4, "ab 12 cd", [], [(0, 5, "JURIS"), (3, 8, "LEI")], None), (5, "x", [], [], None)]
    out = A.adjudicate(spark.createDataFrame(rows, f"doc_id long, text string, agreed {span}, divergent {span}, third {span}")).collect()
    got = {i: {(t[r.start : r.end], r.kind, r.how) for r in out if r.doc_id == i} for i, t, *_ in rows}
    assert got[1] == {
        ("art. 5", "LEI", "agreed"), ("REsp 1.234/SP", "JURIS", "criteria"), ("o RE 77", "JURIS", "preferred"), ("art. 7 do CPC", "LEI", "preferred"),
        ("Tema 9 da RG", "VAGA", "preferred"), ("súmulas 5", "JURIS", "preferred"), ("6", "JURIS", "preferred"),
    }
    assert j in {(r.start, r.end, r.kind) for r in out}
    assert got[2] == {("12 cd", "VAGA", "third")} and got[3] == set() and got[5] == set()
    assert got[4] == {("ab 12", "JURIS", "ambiguous"), ("12 cd", "LEI", "ambiguous")}
    both = spark.createDataFrame([([(0, 10, "J")], [(1, 10, "J"), (20, 25, "J")])], f"a {span}, b {span}").select(A.agreement(F.col("a"), F.col("b")).alias("x")).first().x
    assert [tuple(s) for s in both.agreed] == [(0, 10, "J")] and [tuple(s) for s in both.divergent] == [(20, 25, "J")]


def test_hash_mod_is_the_whole_digest(spark):
    import hashlib

    keys = [f"k{i}" for i in range(30)]
    out = spark.createDataFrame([(k,) for k in keys], "k string").select("k", P.hash_mod(F.col("k"), 10).alias("m")).collect()
    assert all(r.m == int(hashlib.sha1(r.k.encode()).hexdigest(), 16) % 10 for r in out)


def test_quota_and_held_out(spark):
    rows = spark.createDataFrame([(i, f"t{i % 7}", "abc"[i % 3]) for i in range(90)], "id long, text string, g string")
    assert {r["count"] for r in P.equal_quota(rows, "g", "id", 12, "s").groupBy("g").count().collect()} == {4}
    used = spark.createDataFrame([(0,)], "id long")
    chosen, rest = P.held_out(rows, used, spark.createDataFrame([("t1",)], "text_key string"), "id", F.col("text"), 10, "s")
    assert chosen.count() == 10 and chosen.filter("text = 't1' or id = 0").count() == 0 and rest.join(chosen, "id").count() == 0


def test_auroc_is_pairwise(spark):
    rows = [(i % 7 / 7, int(i * i % 5 < 2)) for i in range(80)]
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a, x in rows if x for b, y in rows if not y]
    assert M.auroc(spark.createDataFrame(rows, "score double, label int")).first()[0] == pytest.approx(sum(pairs) / len(pairs))


def test_synthesis(spark):
    parts = [(1, 0, "Ver ", False), (1, 1, "😀 REsp 1", True), (1, 2, " e ", False), (1, 3, "RE 2", True)]
    texts, gold = synth.assemble(spark.createDataFrame(parts, "doc_id long, seq int, piece string, is_citation boolean"))
    text = texts.first().text
    assert all(text[r.start : r.end] == r.quote for r in gold.collect()) and synth.check_documents(texts, gold).count() == 0
    chain = spark.range(1).select(synth.render_chain(F.array(F.lit("ED"), F.lit("REsp")), F.lit(False)).alias("x")).first().x
    assert chain == "Embargos de Declaração no Recurso Especial"


def test_fabricated_numbers_leave_no_row_out(spark):
    free = {1_000_000, 5_432_198, 9_999_999}
    index = spark.range(1_000_000, 10_000_000).filter(~F.col("id").isin(*free)).select(F.col("id").cast("string").alias("key"))
    rows = spark.range(40).select(F.col("id").alias("row"))
    got = synth.fabricated_numbers(rows, index, "row", "s").collect()
    assert sorted(r.row for r in got) == list(range(40)) and {int(r.number) for r in got} == free
    with pytest.raises(ValueError, match="taken"):
        synth.fabricated_numbers(rows, spark.range(1_000_000, 10_000_000).select(F.col("id").cast("string").alias("key")), "row", "s")


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Conforme o REsp 1.234.567/SP no corpo. " * 9)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = ingest.citations_of_stream(ingest.stream_documents(spark, str(tmp_path / "in"), "doc_id long, text string"))
    out = str(tmp_path / "out")
    ingest.run_available(stream, lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"), str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 9
