"""Catalogue: rules of spans, studies and audits, with SQL twins that compute the rules on inputs for every branch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import spans as S
from ..functions import text as T
from ..operators import adjudicate as A
from ..operators import metrics as M
from ..operators import studies as U
from . import fixtures as fx
from .fixtures import CITATIONS_SQL, GOLD_SQL, RECORDS_SQL, predictions_sql, with_sql

_PRED = (CITATIONS_SQL, GOLD_SQL, predictions_sql("a", "pred"), predictions_sql("b", "rival"))


def _variants(quote: Column, *made: Column) -> Column:
    """(variant number, text) of several texts made from a quote."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), m.alias("text")) for i, m in enumerate(made)])).alias("v")


def _variants_sql(*made: str) -> str:
    """The same as a table `texts` (doc_id, seq, kind, variant, text)."""
    rows = " UNION ALL ".join(f"SELECT doc_id, seq, kind, {i}::INT AS variant, {m} AS text FROM citations" for i, m in enumerate(made))
    return f"texts AS ({rows})"


def edge_checks(spark, d):
    q = F.col("quote")
    made = (q, F.concat(F.lit(" "), q, F.lit(".")), F.concat(q, F.lit(";")), F.concat(F.lit("Na "), q), F.initcap(q), F.lit(""), F.regexp_replace(q, "/SP$", ""), F.concat(q, F.lit(" ( RJ )")))
    rows = fx.citations(spark, d).select("doc_id", "seq", L.form_of(q).alias("form"), _variants(q, *made)).select("doc_id", "seq", "form", "v.variant", "v.text")
    return rows.select("doc_id", "seq", "variant", F.array_join(L.edge_violations(F.col("text"), F.col("form")), ",").alias("broken"))


_STATES = "|".join(T.STATES.values())
EDGES_SQL = with_sql(CITATIONS_SQL, _variants_sql(
    "quote", "' ' || quote || '.'", "quote || ';'", "'Na ' || quote", "array_to_string(list_transform(string_split(quote, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')",
    "''", "regexp_replace(quote, '/SP$', '')", "quote || ' ( RJ )'"), f"""
f AS (SELECT *, CASE kind WHEN 'vague' THEN 'vaga' WHEN 'summary' THEN 'sumula' WHEN 'article' THEN 'artigo' ELSE 'processo' END AS form,
  text = '' OR regexp_matches(text, '^\\s|\\s$') AS blank, lower(regexp_extract(text, '^\\s*(\\S+)', 1)) AS first FROM texts)""") + f"""
SELECT doc_id, seq, variant, array_to_string(list_filter([
  CASE WHEN blank THEN 'space' END, CASE WHEN NOT blank AND regexp_matches(text, '[.,;:]$') THEN 'final_punctuation' END,
  CASE WHEN first IN ('o','a','os','as','no','na','nos','nas','do','da','dos','das','ao','à','pelo','pela','em','de') THEN 'leading_word' END,
  CASE WHEN form = 'artigo' AND NOT regexp_matches(text, '^\\p{{Ll}}') THEN 'capital_article' END,
  CASE WHEN form = 'processo' AND NOT regexp_matches(text, '[/\\-–—(]\\s*(?:{_STATES})\\s*\\)?\\s*$') THEN 'no_state' END], lambda x: x IS NOT NULL), ',') AS broken FROM f"""


def slots(spark, d):
    n = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("fls. "), n, F.lit("/9, fl. 3, Fls. 4, OAB/SP 12345, em 1º de março de 2020 e 3 de maio de 2021, 3 de Maio de 2021, protocolo 2019."), F.lpad(n, 6, "0"),
        F.lit(", 1899.123456, 0000001-61.2019.7.01.0000 e 10000001-61.2019.7.01.0000: "), F.col("quote"),
    )
    return fx.citations(spark, d).select("doc_id", "seq", T.with_slots(text).alias("text"))


_MONTHS = T.MONTHS
SLOTS_SQL = with_sql(CITATIONS_SQL, """
t AS (SELECT doc_id, seq, 'fls. ' || doc_id::VARCHAR || '/9, fl. 3, Fls. 4, OAB/SP 12345, em 1º de março de 2020 e 3 de maio de 2021, 3 de Maio de 2021, protocolo 2019.' || lpad(doc_id::VARCHAR, 6, '0')
  || ', 1899.123456, 0000001-61.2019.7.01.0000 e 10000001-61.2019.7.01.0000: ' || quote AS t FROM citations)""") + f"""
SELECT doc_id, seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\b[0-9]{{7}}-[0-9]{{2}}\\.[0-9]{{4}}\\.[0-9]\\.[0-9]{{2}}\\.[0-9]{{4}}\\b', '{{CNJ}}', 'g'),
  '\\b[0-9]{{1,2}}º? de (?:{_MONTHS}) de [0-9]{{4}}\\b', '{{DATA}}', 'g'), '\\bfls?\\.\\s*[0-9]+(?:/[0-9]+)?', '{{FLS}}', 'g'), '\\bOAB/[A-Z]{{2}}\\s*[0-9]+', '{{OAB}}', 'g'),
  '\\b(?:19|20)[0-9]{{2}}\\.[0-9]{{5,8}}\\b', '{{PROTOCOLO}}', 'g') AS text FROM t"""


def id_matches(spark, d):
    rows = fx.citations(spark, d).select("doc_id", "seq", F.concat(F.lit(" 00"), F.col("doc_id").cast("string")).alias("a"), F.concat((F.col("doc_id") + F.col("seq") - 1).cast("string"), F.lit(" : d7|000;x0")).alias("b"))
    return rows.select("doc_id", "seq", T.same_id(F.col("a"), F.col("b")).alias("same"))


_ID = "CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN coalesce(nullif(ltrim({0}, '0'), ''), '0') ELSE {0} END"
IDS_SQL = with_sql(CITATIONS_SQL, "t AS (SELECT doc_id, seq, trim(' 00' || doc_id::VARCHAR) AS a, string_split_regex((doc_id + seq - 1)::VARCHAR || ' : d7|000;x0', '[\\s:|,;]+') AS b FROM citations)") + f"""
SELECT doc_id, seq, list_contains(list_transform(b, lambda x: {_ID.format('x')}), {_ID.format('a')}) AS same FROM t"""

#: Words that the texts of the subject and judge queries are made of.
_SUBJECT_WORDS = ["militar", "Eleitoral e ELEIÇÃO", "reclamante trabalhador", "a pena do réu", "denúncia", "acusado contra militares", "contrato", "eleições"]


def subjects(spark, d):
    i = (F.col("doc_id") * 7 + F.col("seq") * 3).cast("int")
    pick = lambda k: F.element_at(F.array(*map(F.lit, _SUBJECT_WORDS)), F.pmod(i / k, F.lit(len(_SUBJECT_WORDS))).cast("int") + 1)
    rows = fx.citations(spark, d).select("doc_id", "seq", F.concat_ws(" ", pick(1), pick(3), pick(5), "quote").alias("t"))
    return rows.select("doc_id", "seq", L.subject(F.col("t")).alias("subject"))


def _count(word: str) -> str:
    return f"((length(t) - length(replace(t, '{word}', ''))) // {len(word)})"


_COUNTS = ", ".join(f"{' + '.join(map(_count, words))} AS {s}" for s, words in L.SUBJECTS.items())
_LIST = "[" + ", ".join(f"'{w}'" for w in _SUBJECT_WORDS) + "]"
SUBJECTS_SQL = with_sql(CITATIONS_SQL, f"i AS (SELECT doc_id, seq, quote, (doc_id * 7 + seq * 3)::INT AS i FROM citations)", f"""
t AS (SELECT doc_id, seq, lower({_LIST}[i % 8 + 1] || ' ' || {_LIST}[(floor(i / 3.0))::INT % 8 + 1] || ' ' || {_LIST}[(floor(i / 5.0))::INT % 8 + 1] || ' ' || quote) AS t FROM i)""",
    f"c AS (SELECT doc_id, seq, {_COUNTS} FROM t)") + """
SELECT doc_id, seq, CASE WHEN greatest(militar, eleitoral, trabalhista, penal) < 2 THEN 'civel' WHEN militar = greatest(militar, eleitoral, trabalhista, penal) THEN 'militar'
  WHEN eleitoral = greatest(militar, eleitoral, trabalhista, penal) THEN 'eleitoral' WHEN trabalhista = greatest(militar, eleitoral, trabalhista, penal) THEN 'trabalhista' ELSE 'penal' END AS subject FROM c"""

_JUDGES = ["Min. NANCY ANDRIGHI", "MINISTRA Min. Rosa Weber ", "Desembargadora Federal Ana Lima", "LÁZARO GUIMARÃES DESEMBARGADOR CONVOCADO DO TRF 5", "Ministro Desembargador José (Juiz convocado)", "Minas Gerais Silva", ""]


def clean_judges(spark, d):
    name = F.element_at(F.array(*map(F.lit, _JUDGES)), (F.col("doc_id") % len(_JUDGES)).cast("int") + 1)
    rows = fx.citations(spark, d).select("doc_id", "seq", F.concat(name, F.lit(" "), F.col("seq").cast("string")).alias("name"))
    return rows.select("doc_id", "seq", T.clean_judge(F.col("name")).alias("judge"))


_JUDGES_LIST = "[" + ", ".join(f"'{w}'" for w in _JUDGES) + "]"
JUDGES_SQL = with_sql(CITATIONS_SQL, f"n AS (SELECT doc_id, seq, trim({_JUDGES_LIST}[doc_id % {len(_JUDGES)} + 1] || ' ' || seq::VARCHAR) AS n FROM citations)",
    "c AS (SELECT doc_id, seq, regexp_replace(n, '(?i)\\s+\\(?(?:desembargador|ju[ií]z)a?\\s+convocad.*$', '') AS n FROM n)",
    "o AS (SELECT doc_id, seq, regexp_replace(n, '(?i)^\\s*(?:min(?:istr[oa])?\\.?|desembargadora?(?:\\s+federal)?)\\s+', '') AS n FROM c)") + """
SELECT doc_id, seq, trim(regexp_replace(n, '(?i)^\\s*(?:min(?:istr[oa])?\\.?|desembargadora?(?:\\s+federal)?)\\s+', '')) AS judge FROM o"""


def header_states(spark, d):
    rows = fx.records(spark, d).filter("nature = 'acordao'").select("id", "court", "text", L.own_number(F.col("court"), F.col("text"))["number"].alias("number"))
    return rows.select("id", T.state_of_header(F.col("court"), F.col("text"), F.col("number")).alias("state"))


STATES_SQL = with_sql(RECORDS_SQL, """
n AS (SELECT r.id, r.court, r.text, CASE WHEN r.court IN ('STF', 'STJ') THEN num ELSE cnj END AS number FROM records r JOIN ord0 ON r.ord = ord0.o WHERE r.nature = 'acordao')""",
    "a AS (SELECT id, court, substr(text, strpos(text, number) + length(number), 60) AS after FROM n)") + """
SELECT id, CASE court WHEN 'STJ' THEN nullif(regexp_extract(after, '^\\s*-\\s*([A-Z]{2})\\b', 1), '') WHEN 'STM' THEN nullif(regexp_extract(after, '^\\s*/\\s*([A-Z]{2})\\b', 1), '')
  WHEN 'STF' THEN CASE WHEN regexp_matches(upper(strip_accents(after)), '^\\s*SAO PAULO\\b') THEN 'SP' END END AS state FROM a"""


def criteria(spark, d):
    q = F.col("quote")
    made = (q, F.concat(q, F.lit(", Rel. Min. Fulano de Tal 3")), F.lit("sem numero"), F.concat(F.lit("arts. 5 e 7, "), q), F.lit("julgado de 2019, relator Fulano"), F.lit("REsp 12.345 SP e HC 7-RJ, relatora X"))
    rows = fx.citations(spark, d).select("doc_id", "seq", "kind", _variants(q, *made)).select("doc_id", "seq", "kind", "v.variant", "v.text")
    given = F.when(F.col("variant") == 3, "LEI").otherwise("JURIS")
    span = F.struct(F.lit(0).alias("start"), F.char_length("text").alias("end"), given.alias("kind"))
    return rows.select("doc_id", "seq", "variant", L.by_criteria(F.col("text"), span).alias("s")).select("doc_id", "seq", "variant", "s.end", F.col("s.kind").alias("kind"))


CRITERIA_SQL = with_sql(CITATIONS_SQL, _variants_sql("quote", "quote || ', Rel. Min. Fulano de Tal 3'", "'sem numero'", "'arts. 5 e 7, ' || quote", "'julgado de 2019, relator Fulano'", "'REsp 12.345 SP e HC 7-RJ, relatora X'"), """
j AS (SELECT *, regexp_matches(text, '(?i)rel(\\.|ator)') AS judged, regexp_extract(text, '(?is)^(.*?),?\\s*rel(?:\\.|ator)', 1) AS before FROM texts),
c AS (SELECT *, regexp_extract(before, '(?s)^(.*?\\d[\\d.\\-/]*\\s*[-/]?\\s*[A-Z]{2})\\b', 1) AS code, regexp_matches(text, '\\d') OR regexp_matches(text, '(?i)rel(\\.|ator|atoria)') AS cites FROM j),
l AS (SELECT *, CASE WHEN judged AND code <> '' THEN code ELSE text END AS kept FROM c),
m AS (SELECT *, lower(trim(kept)) AS low FROM l)""") + """
SELECT doc_id, seq, variant, CASE WHEN cites THEN length(kept)::INT END AS "end", CASE WHEN NOT cites THEN NULL WHEN variant = 3 THEN 'LEI'
  WHEN regexp_matches(low, '\\barts?\\b\\.?\\s*\\d|\\bartigos?\\s*\\d') THEN 'LEI'
  WHEN regexp_matches(low, 'rel(\\.|ator|atoria)') AND NOT regexp_matches(regexp_replace(low, '\\b(19|20)\\d{2}\\b', '', 'g'), '\\d') THEN 'VAGA' ELSE 'JURIS' END AS kind FROM m"""

#: A header of 400 characters, dates, announced dates, short numbers and numbers of cases.
_CASE_TEXT = ["REsp 1.234.567 e ", "DJe 24.11.2014, em 3 de maio de 2020, julgado em 12345; PSESS. 99.999 e nº ", " ou 54321 ou 1.234, publicada : 7.654.321 e "]


def case_numbers(spark, d):
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit(_CASE_TEXT[0]), F.rpad(F.lit(""), 383, "x"), F.lit(_CASE_TEXT[1]), fx.dotted(fx.own_number(F.col("doc_id"))), F.lit(_CASE_TEXT[2]), F.col("quote"))
    rows = fx.citations(spark, d).select("doc_id", "seq", F.explode(U.case_numbers(text)).alias("n"))
    return rows.select("doc_id", "seq", "n.start", "n.end", "n.key")


def _offsets(name: str, pattern: str) -> str:
    return f"""
{name}0 AS (SELECT doc_id, seq, t, regexp_extract_all(t, '{pattern}') AS q, string_split_regex(t, '{pattern}') AS g FROM t),
{name}1 AS (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM {name}0 WHERE len(q) > 0),
{name} AS (SELECT doc_id, seq, t, q[i] AS quote, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(q[1:i-1], lambda x: length(x))), 0))::INT AS start FROM {name}1)"""


CASES_SQL = with_sql(CITATIONS_SQL, f"""
t AS (SELECT doc_id, seq, '{_CASE_TEXT[0]}' || rpad('', 383, 'x') || '{_CASE_TEXT[1]}' || replace(format('{{:,}}', 1000000 + (doc_id - doc_id % 3) * 7), ',', '.') || '{_CASE_TEXT[2]}' || quote AS t FROM citations)""",
    _offsets("dates", r"(?i)\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}\s+de\s+\w+\s+de\s+\d{4}\b"), _offsets("numbers", r"\d{1,3}(?:\.\d{3})+|\b\d{5,}\b")) + r"""
SELECT n.doc_id, n.seq, n.start, (n.start + length(n.quote))::INT AS "end", coalesce(nullif(ltrim(replace(n.quote, '.', ''), '0'), ''), replace(n.quote, '.', '')) AS key
FROM numbers n WHERE n.start >= 400 AND length(ltrim(replace(n.quote, '.', ''), '0')) >= 5
  AND NOT EXISTS (SELECT 1 FROM dates z WHERE z.doc_id = n.doc_id AND z.seq = n.seq AND z.start <= n.start AND n.start < z.start + length(z.quote))
  AND NOT regexp_matches(substr(n.t, n.start - 24 + 1, 24), '(?i)(?:DJ|DJe|DJU|PSESS|publicad[oa]|julgad[oa]\s+em|sess[aã]o\s+de|divulgad[oa]|em)\s*[.:]?\s*$')"""


def loose_spans(spark, d):
    """J-12: predictions of one extractor that begin in no span of the other."""
    a, b = fx.predictions(spark, d, "a").select("doc_id", "start", "end"), fx.predictions(spark, d, "b").select("doc_id", "start", "end")
    return U.loose_numbers(a, b)


LOOSE_SQL = with_sql(*_PRED) + """
SELECT doc_id, start, "end" FROM pred p WHERE NOT EXISTS (SELECT 1 FROM rival r WHERE r.doc_id = p.doc_id AND r.start <= p.start AND p.start < r."end")"""


def complete_datasets(spark, d):
    gold, pred = fx.gold_spans(spark, d), fx.predictions(spark, d, "a")
    name = (F.col("doc_id") % 400).alias("dataset")
    return U.complete_datasets(gold.select(name, "doc_id"), pred.select(name, "doc_id", "start"))


COMPLETE_SQL = with_sql(*_PRED) + """
SELECT doc_id % 400 AS dataset, doc_id, start FROM pred WHERE doc_id % 400 NOT IN (
  SELECT doc_id % 400 FROM gold WHERE doc_id NOT IN (SELECT doc_id FROM pred))"""


def pooled_f1(spark, d):
    from .study_queries import _per_document

    rows = _per_document(spark, d).select((F.col("doc_id") % 5).alias("model"), F.col("tp_a").alias("tp"), F.col("fp_a").alias("fp"), F.col("fn_a").alias("fn"))
    return M.pooled_f1(rows, ["model"]).select("model", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


def confidence_tail(spark, d):
    from .study_queries import _scores

    rows = M.confidence_tail(_scores(spark, d).select(F.col("score").alias("conf"), (~F.col("error")).alias("hit")))
    return rows.withColumn("smallest", F.array_join("smallest", ","))


def recall_by_level(spark, d):
    gold = fx.gold_spans(spark, d).select("doc_id", "start", "end", "level")
    return U.span_recall(gold, fx.predictions(spark, d, "a").select("doc_id", "start", "end"))


RECALL_SQL = with_sql(*_PRED) + """
SELECT level, count(*)::BIGINT AS n, count(p.start)::BIGINT AS found FROM gold g LEFT JOIN (SELECT DISTINCT doc_id, start, "end" FROM pred) p
  ON p.doc_id = g.doc_id AND p.start = g.start AND p."end" = g."end" GROUP BY level"""


def ignored_extras(spark, d):
    p = fx.predictions(spark, d, "a").select("doc_id", "start", "end")
    return U.ignored_extras(p, fx.gold_spans(spark, d).select("doc_id", "start", "end"))


EXTRAS_SQL = with_sql(*_PRED) + """
SELECT doc_id, start, "end" FROM pred p WHERE EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND least(p."end", g."end") - greatest(p.start, g.start) >= 0.9 * (p."end" - p.start))"""


def convention_rates(spark, d):
    return U.conventions(fx.citations(spark, d).select(F.col("kind").alias("form"), "quote"))[0]


CONVENTIONS_SQL = with_sql(CITATIONS_SQL) + r"""
SELECT kind AS form, count(*)::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(quote, '[/\-–(]\s*[A-Z]{2}\s*\)?$'))::BIGINT AS with_state,
  count(*) FILTER (WHERE contains(quote, chr(10)))::BIGINT AS broken, count(*) FILTER (WHERE regexp_matches(quote, '^[A-ZÀ-Ý]'))::BIGINT AS capital,
  count(*) FILTER (WHERE regexp_matches(quote, 'n[ºo°]'))::BIGINT AS marked FROM citations GROUP BY kind"""


def zone_outcomes(spark, d):
    """M-37: predictions that cross no disputed zone (another extractor's spans below 0.6)."""
    zones = fx.predictions(spark, d, "b").filter("milli < 600").select("doc_id", "start", "end")
    return A.ignoring_zones(fx.predictions(spark, d, "a").select("doc_id", "start", "end"), zones)


ZONES_SQL = with_sql(*_PRED) + """
SELECT doc_id, start, "end" FROM pred p WHERE NOT EXISTS (SELECT 1 FROM rival r WHERE r.milli < 600 AND r.doc_id = p.doc_id AND r.start < p."end" AND p.start < r."end")"""


def oracle_scores(spark, d):
    cols = ["doc_id", "start", "end", "kind"]
    return A.oracle_scores(fx.predictions(spark, d, "a").select(*cols), fx.gold_spans(spark, d).select(*cols))


ORACLE_SCORES_SQL = with_sql(*_PRED) + """
SELECT p.doc_id, p.start, p."end", p.kind, CASE WHEN g.doc_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score
FROM pred p LEFT JOIN (SELECT DISTINCT doc_id, start, "end", kind FROM gold) g ON g.doc_id = p.doc_id AND g.start = p.start AND g."end" = p."end" AND g.kind = p.kind"""


def changed_documents(spark, d):
    cols = ["doc_id", "start", "end", "kind"]
    return A.changed_documents(fx.predictions(spark, d, "a").select(*cols), fx.predictions(spark, d, "b").select(*cols))


CHANGED_SQL = with_sql(*_PRED) + """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM (SELECT doc_id, list_sort(list({'s': start, 'e': "end", 'k': kind})) AS x FROM pred GROUP BY doc_id) a
FULL JOIN (SELECT doc_id, list_sort(list({'s': start, 'e': "end", 'k': kind})) AS y FROM rival GROUP BY doc_id) b ON a.doc_id = b.doc_id WHERE x IS DISTINCT FROM y"""


def token_skeletons(spark, d):
    return fx.citations(spark, d).select("doc_id", "seq", T.token_skeleton(T.flatten(F.col("quote"))).alias("skeleton"))


_FLAT = "trim(regexp_replace(lower(strip_accents(quote)), '\\s+', ' ', 'g'))"
SKELETONS_SQL = with_sql(CITATIONS_SQL) + f"""
SELECT doc_id, seq, array_to_string(list_transform(string_split({_FLAT}, ' '), lambda t: CASE WHEN length(t) < 4 THEN t ELSE translate(replace(t, 'rn', 'm'), '015ic', 'olsle') END), ' ') AS skeleton FROM citations"""


def templates(spark, d):
    q = F.col("quote")
    made = (F.concat(F.lit("Conforme o "), q, F.lit(", nada.")), F.concat(F.lit("Nas  "), q, F.lit(" se leu.")), F.concat(F.lit("Veja "), q), F.concat(F.lit("(à "), q, F.lit(")")))
    rows = fx.citations(spark, d).select("doc_id", "seq", "quote", _variants(q, *made)).select("doc_id", "seq", "quote", "v.variant", "v.text")
    found = U.template_of(F.col("text"), F.col("quote"))
    return rows.select("doc_id", "seq", "variant", found.alias("t")).select("doc_id", "seq", "variant", "t.template", "t.article")


TEMPLATES_SQL = with_sql(CITATIONS_SQL, _variants_sql("'Conforme o {CIT}, nada.'", "'Nas  {CIT} se leu.'", "'Veja {CIT}'", "'(à {CIT})'"),
    r"m AS (SELECT *, regexp_extract(text, '(?s)^(.*?)\b([\wà]+)\s+(\{CIT\}.*)$', 1) AS x, regexp_extract(text, '(?s)([\wà]+)\s+\{CIT\}', 1) AS w, regexp_extract(text, '(?s)(\{CIT\}.*)$', 1) AS y FROM texts)",
    "a AS (SELECT *, CASE lower(w) WHEN 'o' THEN 'o' WHEN 'a' THEN 'o' WHEN 'os' THEN 'o' WHEN 'as' THEN 'o' WHEN 'no' THEN 'no' WHEN 'na' THEN 'no' WHEN 'nos' THEN 'no' WHEN 'nas' THEN 'no' WHEN 'do' THEN 'do' WHEN 'da' THEN 'do' WHEN 'ao' THEN 'ao' WHEN 'à' THEN 'ao' WHEN 'pelo' THEN 'pelo' WHEN 'pela' THEN 'pelo' END AS article, substr(text, 1, strpos(text, w || ' ') - 1) AS lead FROM m)") + """
SELECT doc_id, seq, variant, CASE WHEN article IS NOT NULL THEN lead || '{' || CASE WHEN regexp_matches(w, '^[A-ZÀ-Ý]') THEN 'O' ELSE '' END || article || '} ' || y END AS template, article FROM a"""


def queries():
    from .study_queries import _RISK, _greedy_sql

    walk = _greedy_sql("gi, pi", "true").rsplit("SELECT doc_id, gi::INT", 1)[0]
    pooled = walk + """,
g1 AS (SELECT doc_id % 5 AS model, count(*) AS n FROM gold GROUP BY 1), p1 AS (SELECT doc_id % 5 AS model, count(*) AS n FROM pred GROUP BY 1),
h1 AS (SELECT doc_id % 5 AS model, count(*) AS n FROM walk WHERE gi IS NOT NULL GROUP BY 1)
SELECT g1.model, h1.n::BIGINT AS tp, (p1.n - h1.n)::BIGINT AS fp, (g1.n - h1.n)::BIGINT AS fn, round(2.0 * h1.n / (p1.n + g1.n), 9) AS f1 FROM g1 JOIN p1 USING (model) JOIN h1 USING (model)"""
    tail = with_sql(*_RISK) + """
SELECT count(*) FILTER (WHERE NOT error)::BIGINT AS hits, count(*) FILTER (WHERE error)::BIGINT AS false_positives, round(min(score) FILTER (WHERE NOT error), 4) AS least,
  count(*) FILTER (WHERE NOT error AND score < 0.98)::BIGINT AS below_098, count(*) FILTER (WHERE NOT error AND score < 0.95)::BIGINT AS below_095, count(*) FILTER (WHERE NOT error AND score < 0.9)::BIGINT AS below_090,
  array_to_string((list_sort(list(score) FILTER (WHERE NOT error)))[1:10], ',') AS smallest FROM scores"""
    return {
        "edge_conventions": (edge_checks, EDGES_SQL), "slot_substitution": (slots, SLOTS_SQL), "id_membership": (id_matches, IDS_SQL), "subjects": (subjects, SUBJECTS_SQL),
        "clean_judges": (clean_judges, JUDGES_SQL), "header_states": (header_states, STATES_SQL), "span_criteria": (criteria, CRITERIA_SQL), "case_numbers": (case_numbers, CASES_SQL),
        "loose_spans": (loose_spans, LOOSE_SQL), "complete_datasets": (complete_datasets, COMPLETE_SQL), "pooled_f1": (pooled_f1, pooled), "confidence_tail": (confidence_tail, tail),
        "recall_by_level": (recall_by_level, RECALL_SQL), "ignored_extras": (ignored_extras, EXTRAS_SQL), "convention_rates": (convention_rates, CONVENTIONS_SQL),
        "zone_outcomes": (zone_outcomes, ZONES_SQL), "oracle_scores": (oracle_scores, ORACLE_SCORES_SQL), "changed_documents": (changed_documents, CHANGED_SQL),
        "token_skeletons": (token_skeletons, SKELETONS_SQL), "templates": (templates, TEMPLATES_SQL),
    }
