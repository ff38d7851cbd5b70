"""Rendering of citations, and the figures pooled over seeds and of the confidence tail."""

import random
import re

import pytest
from pyspark.sql import functions as F

from citeweave.operators import metrics as M
from citeweave.operators import render as D

NUMBER = "0600530-94.2020.6.26.0171"
MARK = r"(?:[nN](?:[º°.]|o)\s+)?"


def many(kind, row, level=1, n=300):
    return {D.KINDS[kind](row, random.Random(i), level) for i in range(n)}


def test_decisions_follow_their_court():
    tst = many("decision", {"court": "TST", "chain": ["AIRR", "RR"], "number": NUMBER})
    assert {re.sub(r"^[Pp]rocesso (nº )?", "", t) for t, *_ in tst} >= {f"TST-AIRR-RR-{NUMBER}", f"AIRR-RR-{NUMBER}"}
    tse = {t for t, *_ in many("decision", {"court": "TSE", "chain": ["ED", "AgR", "REspe"], "number": NUMBER})}
    assert any(re.match("(EDcl|ED) no (AgRg|AgR)-REspe ", t) for t in tse) and all(t.endswith(NUMBER) for t in tse)
    stj = {t for t, *_ in many("decision", {"court": "STJ", "chain": ["AgInt", "REsp"], "number": "1.576.933", "state": "SP"})}
    assert stj >= {"AgInt no REsp 1.576.933/SP", "Agravo Interno no Recurso Especial nº 1576933/SP"} and all(re.search(r"1\.?576\.?933/SP$", t) for t in stj)
    stf = {t for t, *_ in many("decision", {"court": "STF", "chain": ["AgR", "Rcl"], "number": "68.244", "state": None})}
    assert any(t.startswith("Rcl ") for t in stf) and any(" na Rcl " in t for t in stf) and all(re.search("/[A-Z]{2}$", t) for t in stf)
    assert any("\u00a0" in t for t, *_ in many("decision", {"court": "STJ", "chain": ["HC"], "number": "1234", "state": "SP"}, 2))


@pytest.mark.parametrize(
    ("kind", "row", "pattern", "label"),
    [
        ("summary", {"number": "7", "court": "STJ"}, r"S(úmula|úm\.|ÚMULA) 7(/STJ| do STJ)", "JURIS"),
        ("summary", {"number": "10", "court": "STF", "binding": True}, r"S(úmula|úm\.|ÚMULA) Vinculante 10( do STF)?", "JURIS"),
        ("fabricated_summary", {}, r"S(úmula|úm\.|ÚMULA) (Vinculante \d+( do STF)?|\d+(/| do )(STF|STJ|TSE|TST))", "JURIS"),
        ("theme", {}, r"Tema (\d\.)?\d{1,4} (d[ae] repercussão geral|do STF)", "JURIS"),
        ("fabricated_process", {}, r"\D+\d[\d.-]+(/[A-Z]{2})?", "JURIS"),
        ("vague", {"court": "STJ", "chain": ["REsp"], "year": 2019, "reporter": "NANCY DA SILVA"}, r"(?i)\D+ de 2019, (rel\. min\.|da relatoria de) nancy da silva|\D+ em 2019 (pela|sob|sob a) relatoria de nancy da silva", "VAGA"),
        ("law", {"article": "5º", "law": "CF", "items": ["I"], "paragraphs": ["1º"], "letters": ["a"]}, r"art(\.|igo)? 5º(, I(, 'a')?,|, § 1º,)? da (C.+|Carta Magna)", "LEI"),
        ("fabricated_law", {}, r"art(\.|igo)? (\d\.)?\d{1,3}º? d[ao] .+", "LEI"),
    ],
)
def test_kinds(kind, row, pattern, label):
    out = many(kind, row)
    assert len(out) > 1 and all(re.fullmatch(pattern, t) and x == label for t, _, x in out)


def test_rendered_rows_are_those_of_the_function(spark):
    row = F.struct(F.lit("STJ").alias("court"), F.array(F.lit("REsp")).alias("chain"), F.lit(2019).alias("year"), F.lit("A de B").alias("reporter"))
    got = spark.range(9).select("id", D.rendered(F.lit("vague"), row, F.lit(2), F.col("id").cast("string")).alias("c")).collect()
    assert all(tuple(r.c) == D.render("vague", {"court": "STJ", "chain": ["REsp"], "year": 2019, "reporter": "A de B"}, 2, str(r.id)) for r in got)


def test_pooled_counts_and_confidence_tail(spark):
    counts = spark.createDataFrame([("a", 1, 5, 1, 2), ("a", 2, 3, 0, 1), ("b", 1, 0, 1, 0)], "arm string, seed int, tp long, fp long, fn long")
    assert {tuple(r) for r in M.pooled_f1(counts, ["arm"]).collect()} == {("a", 8, 1, 3, 16 / 20), ("b", 0, 1, 0, 0.0)}
    spans = spark.createDataFrame([(0.8 + i / 100, True) for i in range(20)] + [(0.1, False)], "conf double, hit boolean")
    r = M.confidence_tail(spans).first()
    assert tuple(r)[:3] == (20, 1, 0.8) and r.below_090 == 10 and r.below_095 == 15 and r.below_098 == 18 and r.smallest == [round(0.8 + i / 100, 4) for i in range(10)]


def test_adversarial_area_and_its_leak_free_form(spark):
    from citeweave.operators import synth

    real = spark.createDataFrame([(i, f"a parte autora pede o numero {i * 7} da causa") for i in range(16)], "doc_id long, text string")
    alike = spark.createDataFrame([(f"a parte autora pede o numero {i * 11} da causa",) for i in range(16)], "text string")
    bank, seen = real.select("doc_id", F.lit("x").alias("entry")), []

    def generate(allowed, fold):
        seen.append({r.doc_id for r in allowed.collect()})
        return alike.select(F.concat(F.lit("zzz qqq "), "text").alias("text"))

    options = {"folds": 2, "repeats": 1, "features": 256}
    areas = synth.leak_free_auc(real, bank, generate, folds=2, **{k: v for k, v in options.items() if k != "folds"})
    assert areas == [1.0, 1.0] and seen[0] | seen[1] == set(range(16)) and not seen[0] & seen[1]
    both = real.select("text", F.lit(1).alias("real")).unionByName(alike.select("text", F.lit(0).alias("real")))
    mean, spread = synth.adversarial_auc(both, "text", "real", **options)
    assert 0.0 <= mean < 1.0 and spread == 0.0
