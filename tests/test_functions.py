"""Scalar functions and folds against tables of known values."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from citeweave.functions import legal as L
from citeweave.functions import spans as S
from citeweave.functions import text as T
from citeweave.operators import extract as X
from citeweave.operators import synth


def each(spark, fn, values):
    """fn of each value, in one job."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


CORES = {
    "AgInt no RESP 21737l8 - SP": "2173718", "R.Esp. n°  1.45g.779-MA": "1459779", "Reclamação n.  44-\n.921 (PE)": "44921",
    "ED no AgR-REspe No  0600316-4920206160182": "6003164920206160182", "TST-ED-E-ED-ARR-1099-66.2011.5.02. 0251": "10996620115020251",
    "Rc1 88178/RS": "88178", "EDcl n0 AgInt no  REsp 188q127/SE": "1889127", "AgInt no Recurso Especia1 nº 1.620.021/PR": "1620021",
    "RSE 7000082- 11.2026.7.00.0000/RS": "70000821120267000000", "no number": "", "AgR-A1 0603026-69.2018.6.09.0000": "06030266920186090000".lstrip("0"),
}


def test_numeric_core(spark):
    assert dict(zip(CORES, each(spark, T.citation_key, CORES))) == CORES


def test_ocr_and_keys(spark):
    assert each(spark, T.digits_only, ["21737l8", "1.528.4S5", "170076O", "6G.838", "1.45g.779", "8O7B"]) == ["2173718", "1528455", "1700760", "66838", "1459779", "8078"]
    assert each(spark, T.number_of, ["2l1", "abc", "SOS"]) == ["211", None, None]
    assert each(spark, T.number_key, ["0600216", "600216", "000", ""]) == ["600216", "600216", "000", ""]
    assert each(spark, T.is_numeric_piece, ["45g", "6G", "Rc1", "n0", "Especia1", "170076O", ""]) == [True, True, False, False, False, True, False]
    assert T.letters_of_digits()["1"] == ["l", "I", "i"]


def test_accents_are_those_of_unicode(spark):
    letters = "".join(map(chr, [*range(0x20, 0x250), *range(0x1E00, 0x1F00), 0x301, 0x327]))
    want = "".join(c for c in unicodedata.normalize("NFD", letters) if unicodedata.category(c) != "Mn")
    assert each(spark, T.strip_accents, [letters])[0].replace(" ", "") == want.replace(" ", "")


def test_skeletons_meet(spark):
    a, b = each(spark, T.skeleton, ["Códig0 de Pr0cesso  Civil", "Código de Processo Civil"])
    assert a == b == "eodlgo de proeesso elvll"


def test_offsets_are_code_points(spark):
    rows = spark.createDataFrame([("😀 a art. 5, art. 77",)], "v string").select(F.explode(T.match_offsets(F.col("v"), r"art\. [0-9]+")).alias("m")).collect()
    assert [(r.m.start, r.m.end, r.m.quote) for r in rows] == [(4, 10, "art. 5"), (12, 19, "art. 77")]


@pytest.mark.parametrize(("text", "want"), [("  REsp 1/SP ,:", (2, 11, "REsp 1/SP")), (" REsp 1/SP;", (1, 10, "REsp 1/SP")), (".; ", None), ("abc", (0, 3, "abc"))])
def test_trim(spark, text, want):
    row = spark.createDataFrame([(text,)], "v string").select(S.trimmed(F.lit(0), F.char_length("v"), F.col("v")).alias("s")).first().s
    assert (row and tuple(row)) == want


def test_class_chains(spark):
    table = {
        "EMB.DECL. NO AG.REG. EM MANDADO DE SEGURANÇA": "ED,AgR,MS", "TST-ED-ED-E-ED-ED-ARR": "ED,ED,E,ED,ED,ARR", "AGRAVO EM RECURSO ESPECIAL": "AREsp",
        "AGRAVO DE INSTRUMENTO EM RECURSO DE REVISTA": "AI,RR", "SEGUNDO AG.REG. NO RECURSO EXTRAORDINÁRIO": "AgR2,RE", "Terceiros EDcl no REsp": "ED3,REsp",
        "AgInt nosEMBARGOS DE DECLARAÇÃO": "AgInt,ED", "nothing": "", "": "",
    }
    assert dict(zip(table, [",".join(x) for x in each(spark, L.class_chain, table)])) == table


def test_chains_fit(spark):
    rows = [(["Ag", "REsp"], ["AgR", "REsp"]), (["Ag", "REsp"], ["AgInt", "AgR", "REsp"]), (["E"], ["EDv"]), (["REsp", "AgR"], ["AgR", "REsp"]), ([], ["REsp"])]
    out = spark.createDataFrame(rows, "a array<string>, b array<string>").select(L.fits_in(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in out] == [True, True, True, False, True]


def test_court_headers(spark):
    rows = [
        ("STF", "DJe PRIMEIRA TURMA AG.REG. NO RECURSO EXTRAORDINÁRIO 1.276.977 SÃO PAULO RELATOR", ["1276977"], "stf"),
        ("STJ", "AgRg no RECURSO ESPECIAL Nº 1.205.500 - SC (2010⁄0146585-7)", ["1205500"], "stj"),
        ("STM", "APELAÇÃO Nº 7000101-61.2019.7.00.0000", ["70001016120197000000"], "stm"),
        ("TSE", "TRIBUNAL SUPERIOR ELEITORAL ACÓRDÃO AGRAVO DE INSTRUMENTO Nº 10.353 ( 38964-78.2008.6.00.0000)", ["10353", "389647820086000000"], "tse:antigo"),
        ("TSE", "TRIBUNAL SUPERIOR ELEITORAL RECURSO ESPECIAL ELEITORAL Nº 378-82.2016.6.05.0151", ["3788220166050151"], "tse:cnj"),
        ("TST", "discutidos estes autos de Embargos nº TST-ED-ED-E- ED-ED-ARR-1575-04.2016.5.20.0001, em", ["15750420165200001"], "tst:autos"),
        ("TST", "RECURSO Nº 123.456", [], "tst:sem_padrao"), (None, "APELAÇÃO Nº 123.456 x", ["123456"], "generico"),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, court string, text string")
    out = df.select("i", L.own_number(F.col("court"), F.col("text")).alias("o")).orderBy("i").collect()
    assert [(r.o["keys"], r.o["source"]) for r in out] == [(k, s) for *_, k, s in rows]


def test_forms(spark):
    table = {
        "julgado do STJ de 2021, relatoria de Fulano": "vaga", "Rel. Min. Fulano, julgado em 12/2020": "processo", "5úmula 7": "sumula", "Terna 725": "tema",
        "Terceiro AgR na Rcl 1": "processo", "Temas 725": "processo", "Artigo 373 do CPC": "artigo", "RR 1835 -- 06 . 2010": "cnj",
    }
    assert dict(zip(table, each(spark, L.form_of, table))) == table


def test_laws(spark):
    table = {
        "art. 373 do CPC": "13105", "art. 373 do Código de Processo Civil": "13105", "art. 373 da Lei nº 13.105/2015": "13105", "art. 373 da Lei nº 131O5/2015": "13105",
        "art. 5º da Carta Magna": "CF", "art. 5º, CF": "CF", "art. 1º da LC 64/90": "LC64", "art. 1º da Lei Cornplernentar nº 64/1990": "LC64",
        "art. 14 do Códig0 de Defesa do Consumidor": "8078", "art. 5º da Lei Municipal nº 8.078/1990": None, "art. 186 do CC": "10406", "Regimento Interno": None,
    }
    assert dict(zip(table, each(spark, L.law_of_citation, table))) == table


def test_summaries(spark):
    table = {"5úmula 211": "211", "Súrnula 211": "211", "SúmuIa 211": "211", "Súmula 2l1": "211", "Súm. 211": "211", "Súmula 07": "7", "Súmula vigente 7 do STJ": "7"}
    out = each(spark, L.summary_of_citation, table)
    assert {q: s["number"] for q, s in zip(table, out)} == table and out[-1]["court"] == "STJ"
    assert all(s["binding"] for s in each(spark, L.summary_of_citation, ["Súmula Vinculantc 10", "Súmula Vinculãnte 10", "Súmula Vineulante 10"]))


# --- spans

KIND = "struct<start:int,end:int,kind:string,conf:double>"


def fold(spark, column, spans, reserve=()):
    df = spark.createDataFrame([([(*s, "x", None)[:4] if len(s) == 2 else s for s in spans], list(reserve))], f"s array<{KIND}>, r array<{KIND}>")
    return [tuple(x)[:2] for x in df.select(column(F.col("s"), F.col("r")).alias("o")).first().o]


def test_overlaps(spark):
    keep = lambda s, r: S.without_overlap(s, KIND)
    assert fold(spark, keep, [(20, 30), (8, 21), (0, 10)]) == [(0, 10), (8, 21), (20, 30)]
    assert fold(spark, keep, [(0, 10), (0, 5)]) == [(0, 10)] and fold(spark, keep, [(0, 10), (6, 10)]) == [(0, 10), (6, 10)]


def test_guard(spark):
    glued = lambda s, r: S.without_glued_vague(s, 2)
    assert fold(spark, glued, [(0, 10, "vague", None), (12, 20, "x", None)]) == [(12, 20)]
    assert len(fold(spark, glued, [(0, 10, "vague", None), (13, 20, "x", None)])) == 2
    assert fold(spark, glued, [(0, 10, "vague", None), (11, 20, "vague", None)]) == []
    weak = lambda s, r: S.replace_weak(s, r, 0.95)
    assert fold(spark, weak, [(0, 10, "x", 0.95), (20, 30, "x", 0.9), (40, 50, "x", None)], [(18, 25, "x", None), (60, 70, "x", None)]) == [(0, 10), (18, 25), (40, 50)]
    assert fold(spark, weak, [(0, 10, "x", 0.99), (10, 30, "x", 0.9)], [(8, 25, "x", None)]) == [(0, 10)]


def test_windows_and_owners(spark):
    df = spark.range(1)
    cover = lambda n, w, s: [tuple(x) for x in df.select(S.windows(F.lit(n), w, s).alias("c")).first().c]
    assert cover(10, 4, 2) == [(0, 4), (2, 6), (4, 8), (6, 10)] and cover(9, 4, 3) == [(0, 4), (3, 7), (6, 9)] and cover(3, 4, 2) == [(0, 3)]
    assert df.select(S.owner(F.lit(3), S.windows(F.lit(10), 4, 2)).alias("o")).first().o == 1
    for bad in ((4, 0), (4, 5), (0, 1)):
        with pytest.raises(ValueError):
            S.windows(F.lit(3), *bad)


# --- the rule extractor

HEAD = "CABEÇALHO\n\n\n"
BODIES = [
    ("Ver fls. 123/456 e OAB/SP nº 12345 e R$ 1.234,56 no ponto. O REsp 1.234.567/SP.", [("REsp 1.234.567/SP", "processo")]),
    ("Ver CPF 123.456.789-00 e o REsp 1.234.567/SP.", []),
    ("A Súmula 211 do STJ, a Súmula Vinculante nº 10, o Tema 725 da repercussão geral.", [("Súmula 211", "sumula"), ("Súmula Vinculante nº 10", "sumula"), ("Tema 725 da repercussão geral", "tema")]),
    ("Processo 0600316-4920206160182 e em 2024 e nº 123 e o 5.432 no ponto.", [("Processo 0600316-4920206160182", "cnj"), ("5.432", "processo")]),
    ("Súmula 1.234 do STJ.", [("Súmula 1", "sumula")]),
    ("Conforme o REsp 1.234.567, julgado em 2021, Rel. Min. Nancy Andrighi, no ponto.", [("REsp 1.234.567", "processo"), ("julgado em 2021, Rel. Min. Nancy Andrighi", "vaga")]),
]


def test_rules(spark):
    docs = spark.createDataFrame([(i, HEAD + body) for i, (body, _) in enumerate(BODIES)] + [(99, None), (98, "")], "doc_id long, text string")
    got = {}
    for r in X.extract_by_rules(docs).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append((r.quote, r.form))
        assert (HEAD + BODIES[r.doc_id][0])[r.start : r.end] == r.quote
    assert got == {i: want for i, (_, want) in enumerate(BODIES) if want}


def test_a_long_text_of_many_citations(spark):
    text = HEAD + "conforme o REsp 1.234.567/SP e a Súmula 7 do STJ. " * 400
    rows = X.extract_by_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r.form for r in sorted(rows, key=lambda r: r.start)] == ["processo", "sumula"] * 400


def test_header_ends(spark):
    texts = ["a" * 50, "a" * 1000, "a" * 4000, "a\n\nb\n\n\nc" + "x" * 400]
    assert each(spark, X.header_end, texts) == [80, 250, 700, 4]


def test_border_repair(spark):
    text = "Tema 725 e Lei 1Lei 2 ..."
    spans = spark.createDataFrame([([(2, 8, "J"), (11, 16, "L"), (16, 21, "L"), (22, 25, "L")], text)], "s array<struct<start:int,end:int,kind:string>>, t string")
    got = spans.select(X.repair_borders(F.col("s"), F.col("t")).alias("x")).first().x
    assert [tuple(s) for s in got] == [(0, 8, "J"), (11, 16, "L"), (16, 21, "L")]


def test_extractors_by_name(spark):
    docs = spark.createDataFrame([(1, HEAD + "no REsp 1.234.567/SP e Súmula 7.")], "doc_id long, text string")
    at = len(HEAD)
    model = spark.createDataFrame([(1, at + 3, at + 20, "JURIS", 0.5), (1, 0, 4, "LEI", 0.99)], "doc_id long, start int, end int, kind string, conf double")
    spans = lambda name: {(r.start - at, r.end - at, r.kind) for r in X.extractor(name, model)(docs).collect()}
    rules, weak, strong = {(0, 20, "JURIS"), (23, 31, "JURIS")}, (3, 20, "JURIS"), (-at, 4 - at, "LEI")
    assert spans("regua") == rules and spans("neural-cru") == {weak, strong}
    assert spans("uniao") == {weak, strong, (23, 31, "JURIS")} and spans("neural") == {(0, 20, "JURIS"), strong}
    with pytest.raises(ValueError, match="unknown extractor"):
        X.extractor("outro")
    with pytest.raises(ValueError, match="spans"):
        X.extractor("neural")


def test_quotes_align():
    assert X.align_quotes("a b  c a b", ["a b", "a\nb", "a b", "b c", "zz"]) == [(0, 3), (7, 10), None, (2, 6), None]


def test_markup_aligns():
    assert T.align_markup("x ⟦J⟧REsp 1⟦/J⟧ y", "x REsp 1 y") == [(2, 8, "JURIS")]
    assert T.align_markup("x ⟦J⟧REsp 1", "x REsp 1") is None and T.align_markup("⟦J⟧a⟦/J⟧", "b") is None


def test_loose_text_tools():
    assert T.find_normalised("O Códig0  de Pr0cesso", "codigo de") == (2, 12, "ocr") and T.find_normalised("a b", "ab") is None
    assert T.find_normalised("Ver a SÚMULA n° 7.", "sumula no 7") == (6, 17, "normalised")
    assert T.find_similar("xx, Recurso Especial", "Recurso Especia1!") == (1, 19, 0.933) and T.find_similar("", "xyz") is None
    assert T.find_similar("abc", "xyz") is None
    assert T.lenient_json('say {"a": 1} then {"b": {"c": 2}} end', "b") == {"b": {"c": 2}} and T.lenient_json("{", "a") is None


# --- noise


@pytest.mark.parametrize("seed", range(25))
def test_noise_keeps_keys_and_offsets(spark, seed):
    text = "Ver o REsp 1.234.567/SP e a AP 7000082-11.2026.7.00.0000/RS, mais nada."
    spans = [(6, 23), (28, 59)]
    out, places = synth.add_noise(text, spans, 0.6, f"s{seed}")
    assert synth.add_noise(text, spans, 0.0, "x") == (text, spans) and synth.add_noise(text, spans, 0.6, f"s{seed}") == (out, places)
    if seed < 4:
        assert each(spark, T.citation_key, [out[a:b] for a, b in places]) == ["1234567", "70000821120267000000"]
