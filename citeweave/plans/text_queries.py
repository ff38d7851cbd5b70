"""Catalogue: text normalisation, legal parsing and extraction, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import text as T
from ..functions.spans import trimmed
from ..operators import extract as X
from . import fixtures as fx
from .fixtures import CITATIONS_SQL, DOCUMENTS_SQL, GOLD_SQL, RECORDS_SQL, table, with_sql

_OCR = "translate({0}, 'OoDQlIi|ZzASsGbTBgq', '0000111122455667899')"
_FLAT = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"
_SKEL = "translate(replace(" + _FLAT + ", 'rn', 'm'), '015ic', 'olsle')"
_DIG = "regexp_replace(" + _OCR + ", '[^0-9]', '', 'g')"
_KEY = "coalesce(nullif(ltrim({0}, '0'), ''), {0})"


def normalised_quotes(spark, d):
    q = F.col("quote")
    return fx.citations(spark, d).select(
        "doc_id", "seq", T.strip_accents(q).alias("plain"), T.flatten(q).alias("flat"), T.skeleton(q).alias("skeleton"),
        T.ocr_to_digits(q).alias("as_digits"), T.digits_only(q).alias("digits"), T.number_of(q).alias("number"),
        T.raw_key(q).alias("raw_key"), T.bank_key(q).alias("bank_key"), T.dedup_key(q).alias("dedup_key"), T.mask_digits(q).alias("masked"),
    )


NORMALISED_SQL = with_sql(CITATIONS_SQL) + f"""
SELECT doc_id, seq, strip_accents(quote) AS plain, {_FLAT.format('quote')} AS flat, {_SKEL.format('quote')} AS skeleton,
  {_OCR.format('quote')} AS as_digits, {_DIG.format('quote')} AS digits,
  CASE WHEN regexp_matches(quote, '[0-9]') THEN {_DIG.format('quote')} END AS number, {_KEY.format(_DIG.format('quote'))} AS raw_key,
  regexp_replace(strip_accents(lower(quote)), '[^a-z{{}} ]', '', 'g') AS bank_key,
  lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AS dedup_key, regexp_replace(quote, '[0-9]', '#', 'g') AS masked
FROM citations"""


def numeric_cores(spark, d):
    return fx.citations(spark, d).filter("kind in ('exact', 'plain', 'noised', 'fabricated')").select(
        "doc_id", "seq", T.numeric_core(F.col("quote")).alias("core"), T.citation_key(F.col("quote")).alias("key")
    )


NUMERIC_SQL = with_sql(CITATIONS_SQL) + """
SELECT doc_id, seq, (CASE WHEN kind = 'fabricated' THEN 9000000 + doc_id * 7 ELSE 1000000 + (doc_id - doc_id % 3) * 7 END)::VARCHAR AS core,
  (CASE WHEN kind = 'fabricated' THEN 9000000 + doc_id * 7 ELSE 1000000 + (doc_id - doc_id % 3) * 7 END)::VARCHAR AS key
FROM citations WHERE kind IN ('exact', 'plain', 'noised', 'fabricated')"""


def numeric_pieces(spark, d):
    piece = F.explode(F.split("quote", r"[ /.]")).alias("piece")
    rows = fx.citations(spark, d).select("doc_id", "seq", piece).filter("piece <> ''")
    return rows.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).select("piece", T.is_numeric_piece(F.col("piece")).alias("numeric"), "n")


PIECES_SQL = with_sql(CITATIONS_SQL) + """
SELECT piece, len(regexp_extract_all(piece, '[0-9]')) > 0 AND len(regexp_extract_all(piece, '[0-9]')) >= len(regexp_extract_all(piece, '\\p{L}'))
  AND regexp_matches(piece, '^[0-9OoDQlIi|ZzASsGbTBgq]+$') AS numeric, count(*)::BIGINT AS n
FROM (SELECT unnest(string_split_regex(quote, '[ /.]')) AS piece FROM citations) WHERE piece <> '' GROUP BY piece"""


def trimmed_spans(spark, d):
    docs = fx.citation_documents(spark, d)
    rows = fx.gold_spans(spark, d).select("doc_id", "seq", "start", "end").join(docs, "doc_id")
    wide = trimmed(F.greatest(F.col("start") - 1, F.lit(0)), F.col("end") + 1, F.col("text"))
    return rows.select("doc_id", "seq", wide.alias("s")).select("doc_id", "seq", "s.start", "s.end", "s.quote")


TRIMMED_SQL = with_sql(CITATIONS_SQL, GOLD_SQL) + """SELECT doc_id, seq, start, "end", quote FROM gold"""


def sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.char_length("col")).alias("chars"))


SENTENCES_SQL = """
WITH flat AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
cut AS (SELECT doc_id, regexp_replace(t, '([.!?])\\s+([A-ZÀ-Ý])', '\\1' || chr(1) || '\\2', 'g') AS t FROM flat),
again AS (SELECT doc_id, regexp_replace(t, '([.!?])\\s+([A-ZÀ-Ý])', '\\1' || chr(1) || '\\2', 'g') AS t FROM cut)
SELECT doc_id, count(*)::BIGINT AS sentences, sum(length(s))::BIGINT AS chars
FROM (SELECT doc_id, unnest(string_split(t, chr(1))) AS s FROM again) GROUP BY doc_id"""


def wrapped(spark, d):
    """T-25, checked by its invariants: the length stays, and undoing the breaks gives the text back."""
    rows = table(spark, d, "benchmark").select("item_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("t"))
    rows = rows.withColumn("w", T.wrap(F.col("t"), 60))
    return rows.select("item_id", (F.char_length("w") == F.char_length("t")).alias("same_length"), (F.replace("w", F.lit("\n"), F.lit(" ")) == F.col("t")).alias("same_text"))


WRAPPED_SQL = "SELECT item_id, true AS same_length, true AS same_text FROM benchmark"


def number_offsets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.match_offsets(F.coalesce("text", F.lit("")), "[0-9]+")))
    return rows.select("doc_id", F.col("pos").alias("i"), "col.start", "col.end", "col.quote")


OFFSETS_SQL = """
WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+') AS q, string_split_regex(coalesce(text, ''), '[0-9]+') AS g FROM documents),
e AS (SELECT doc_id, q, g, unnest(range(1, len(q) + 1)) AS i FROM m WHERE len(q) > 0),
o AS (SELECT doc_id, (i - 1)::INT AS i, q[i] AS quote,
        (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(q[1:i-1], lambda x: length(x))), 0))::INT AS start FROM e)
SELECT doc_id, i, start, (start + length(quote))::INT AS "end", quote FROM o"""


def marked_contexts(spark, d):
    rows = fx.gold_spans(spark, d).select("doc_id", "seq", "start", "end").join(fx.citation_documents(spark, d), "doc_id")
    return rows.select("doc_id", "seq", T.marked_context(F.col("text"), F.col("start"), F.col("end"), 20).alias("context"))


CONTEXT_SQL = with_sql(CITATIONS_SQL, GOLD_SQL, DOCUMENTS_SQL) + """
SELECT g.doc_id, g.seq, substr(text, greatest(start - 20, 0) + 1, start - greatest(start - 20, 0)) || '[[' || quote || ']]' || substr(text, "end" + 1, 20) AS context
FROM gold g JOIN docs d ON g.doc_id = d.doc_id"""


def forms(spark, d):
    q = F.col("quote")
    rows = fx.citations(spark, d).select("doc_id", "seq", "kind", L.form_of(q).alias("form"), L.form_of_label(F.lit("JURIS"), q).alias("as_juris"))
    return rows.select("doc_id", "seq", "form", "as_juris", L.type_of_form(F.col("form")).alias("type"))


FORMS_SQL = with_sql(CITATIONS_SQL) + """
SELECT doc_id, seq, CASE kind WHEN 'vague' THEN 'vaga' WHEN 'summary' THEN 'sumula' WHEN 'article' THEN 'artigo' ELSE 'processo' END AS form,
  CASE kind WHEN 'summary' THEN 'sumula' ELSE 'processo' END AS as_juris,
  CASE kind WHEN 'article' THEN 'lei' ELSE 'jurisprudencia' END AS type FROM citations"""


def cited_laws(spark, d):
    q = F.col("quote")
    return fx.citations(spark, d).filter("kind = 'article'").select("doc_id", "seq", L.article_of_citation(q).alias("article"), L.law_of_citation(q).alias("law"))


LAWS_SQL = with_sql(CITATIONS_SQL) + """
SELECT doc_id, seq, regexp_extract(quote, 'art\\. ([0-9]+)', 1) AS article,
  CASE WHEN ends_with(quote, 'CPC') THEN '13105' WHEN ends_with(quote, 'CF') THEN 'CF' ELSE 'LC64' END AS law FROM citations WHERE kind = 'article'"""


def cited_summaries(spark, d):
    s = L.summary_of_citation(F.col("quote"))
    return fx.citations(spark, d).filter("kind = 'summary'").select("doc_id", "seq", s.alias("s")).select("doc_id", "seq", "s.number", "s.court", "s.binding")


SUMMARIES_SQL = with_sql(CITATIONS_SQL) + """
SELECT doc_id, seq, regexp_extract(quote, 'Súmula ([0-9]+)', 1) AS number, CASE WHEN ends_with(quote, 'STJ') THEN 'STJ' END AS court, false AS binding
FROM citations WHERE kind = 'summary'"""


def implied_courts(spark, d):
    rows = fx.citations(spark, d).filter("kind in ('exact', 'plain')").select("doc_id", "seq", L.implied_court(F.col("quote")).alias("court"))
    return rows


COURTS_SQL = with_sql(CITATIONS_SQL) + "SELECT doc_id, seq, 'STJ' AS court FROM citations WHERE kind IN ('exact', 'plain')"


def class_chains(spark, d):
    rows = fx.citations(spark, d).select("chain").distinct().withColumn("links", L.class_chain(F.col("chain")))
    return rows.select("chain", F.array_join("links", ",").alias("links"), F.array_join(L.first_link(F.col("links")), ",").alias("first"))


CHAINS_SQL = with_sql(CITATIONS_SQL) + """
SELECT DISTINCT chain, CASE chain WHEN 'REsp' THEN 'REsp' WHEN 'AgInt no REsp' THEN 'AgInt,REsp' ELSE 'ED,AgInt,REsp' END AS links,
  CASE chain WHEN 'REsp' THEN 'REsp' WHEN 'AgInt no REsp' THEN 'AgInt' ELSE 'ED' END AS first FROM citations"""


def own_numbers(spark, d):
    rows = fx.records(spark, d).filter("nature = 'acordao'").select("id", L.own_number(F.col("court"), F.col("text")).alias("o"))
    return rows.select("id", F.array_join("o.keys", ",").alias("keys"), "o.source", F.trim("o.class").alias("class"))


OWN_SQL = with_sql(RECORDS_SQL) + """
SELECT id, CASE WHEN court IN ('STF', 'STJ') THEN n WHEN court = 'TSE' THEN n || ',' || c ELSE c END AS keys,
  CASE court WHEN 'STF' THEN 'stf' WHEN 'STJ' THEN 'stj' WHEN 'STM' THEN 'stm' WHEN 'TSE' THEN 'tse:antigo' ELSE 'tst:autos' END AS source,
  CASE WHEN court = 'STM' THEN 'APELAÇÃO' WHEN court = 'TST' THEN 'TST-ED-RR-' ELSE long END AS class
FROM (SELECT r.id, r.court, replace(num, '.', '') AS n, ltrim(regexp_replace(cnj, '[^0-9]', '', 'g'), '0') AS c, long
      FROM records r JOIN ord0 ON r.ord = ord0.o WHERE r.nature = 'acordao')"""


def record_headers(spark, d):
    rows = fx.records(spark, d).filter("nature <> 'acordao'").select("id", L.summary_header(F.col("text")).alias("s"), L.article_header(F.col("text")).alias("a"))
    return rows.select("id", F.col("s.number").alias("number"), F.col("s.court").alias("court"), F.col("s.binding").alias("binding"), "a.article", "a.law")


HEADERS_SQL = with_sql(RECORDS_SQL) + """
SELECT id, CASE WHEN nature = 'sumula' THEN ((ord // 50) % 400 + 1)::VARCHAR END AS number, CASE WHEN nature = 'sumula' THEN court END AS court,
  CASE WHEN nature = 'sumula' THEN ord % 100 = 0 END AS binding, CASE WHEN nature = 'dispositivo' THEN ((ord // 50) % 300 + 1)::VARCHAR END AS article,
  CASE WHEN nature = 'dispositivo' THEN ['13105', 'CF', 'LC64'][(ord % 3)::INT + 1] END AS law FROM records WHERE nature <> 'acordao'"""


def rule_spans(spark, d):
    return X.extract_by_rules(fx.citation_documents(spark, d))


def bio_round_trip(spark, d):
    """Words as tokens: encoding gold spans to labels and decoding them gives the spans back."""
    docs = fx.citation_documents(spark, d)
    words = docs.select("doc_id", F.posexplode(T.match_offsets(F.col("text"), r"[^ ]+")).alias("i", "w")).select("doc_id", "i", "w.start", "w.end")
    gold = fx.gold_spans(spark, d).select("doc_id", "start", "end", F.when(F.col("kind") == "article", "LEI").when(F.col("kind") == "vague", "VAGA").otherwise("JURIS").alias("label"))
    return X.decode_bio(X.encode_bio(words, gold)).select("doc_id", "start", F.col("kind").alias("label"))


BIO_SQL = with_sql(CITATIONS_SQL, GOLD_SQL) + """
SELECT doc_id, start, CASE kind WHEN 'article' THEN 'LEI' WHEN 'vague' THEN 'VAGA' ELSE 'JURIS' END AS label FROM gold"""


def dedup_documents(spark, d):
    from ..operators.resolve import first_by_key

    docs = table(spark, d, "documents").select("doc_id", F.md5(T.dedup_key(F.coalesce("text", F.lit(""))).cast("binary")).alias("k"))
    return first_by_key(docs, "k", "doc_id").select("doc_id")


DEDUP_SQL = """
SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"""


def queries():
    return {
        "text_normalisation": (normalised_quotes, NORMALISED_SQL), "numeric_core": (numeric_cores, NUMERIC_SQL),
        "numeric_pieces": (numeric_pieces, PIECES_SQL), "span_trim": (trimmed_spans, TRIMMED_SQL),
        "sentence_split": (sentences, SENTENCES_SQL), "line_wrap": (wrapped, WRAPPED_SQL), "match_offsets": (number_offsets, OFFSETS_SQL),
        "marked_context": (marked_contexts, CONTEXT_SQL), "citation_form": (forms, FORMS_SQL),
        "cited_law": (cited_laws, LAWS_SQL), "cited_summary": (cited_summaries, SUMMARIES_SQL), "implied_court": (implied_courts, COURTS_SQL),
        "class_chain": (class_chains, CHAINS_SQL), "own_number": (own_numbers, OWN_SQL), "record_headers": (record_headers, HEADERS_SQL),
        "rule_extractor": (rule_spans, None), "bio_round_trip": (bio_round_trip, BIO_SQL),
        "dedup_first": (dedup_documents, DEDUP_SQL),
    }
