"""Reading legal references (L-01 to L-22): class chains, court headers, laws, forms. Columns unless noted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T

#: Class forms and their canonical abbreviations. The order decides which form is read.
CLASS_FORMS = [
    ("embargos de divergencia", "EDv"), ("emb.div.", "EDv"), ("emb. div.", "EDv"), ("emb div", "EDv"), ("edv", "EDv"),
    ("eresp", "EDv"), ("embargos de declaracao", "ED"), ("emb.decl.", "ED"), ("emb. decl.", "ED"), ("emb decl", "ED"),
    ("edcl", "ED"), ("eds", "ED"), ("ed", "ED"), ("agravo regimental", "AgR"), ("ag.reg.", "AgR"), ("ag. reg.", "AgR"),
    ("ag reg", "AgR"), ("agrg", "AgR"), ("agr", "AgR"), ("agravo interno", "AgInt"), ("agint", "AgInt"), ("ag.int.", "AgInt"),
    ("agravo em recurso especial eleitoral", "AREspe"), ("agravo em recurso especial", "AREsp"), ("aresp", "AREsp"),
    ("aresp.", "AREsp"), ("recurso especial eleitoral", "REspe"), ("respe", "REspe"), ("respel", "REspe"),
    ("arespel", "AREspe"), ("recurso especial", "REsp"), ("resp", "REsp"), ("rec. esp.", "REsp"), ("r.esp.", "REsp"),
    ("recurso extraordinario com agravo", "ARE"), ("are", "ARE"), ("recurso extraordinario", "RE"), ("re", "RE"),
    ("recurso em habeas corpus", "RHC"), ("rhc", "RHC"), ("habeas corpus", "HC"), ("hc", "HC"), ("h.c.", "HC"),
    ("recurso em mandado de seguranca", "RMS"), ("rms", "RMS"), ("mandado de seguranca", "MS"), ("ms", "MS"),
    ("agravo de instrumento", "AI"), ("ai", "AI"), ("recurso em sentido estrito", "RSE"), ("rse", "RSE"),
    ("apelacao", "APL"), ("apl", "APL"), ("recurso de revista com agravo", "ARR"), ("arr", "ARR"),
    ("agravo de instrumento em recurso de revista", "AIRR"), ("airr", "AIRR"), ("recurso de revista", "RR"), ("rr", "RR"),
    ("recurso ordinario", "RO"), ("ro", "RO"), ("acao rescisoria", "AR"), ("ar", "AR"), ("reclamacao", "Rcl"),
    ("rcl", "Rcl"), ("recl.", "Rcl"), ("recl", "Rcl"), ("representacao", "Rp"), ("rp", "Rp"),
    ("suspensao de liminar e de sentenca", "SLS"), ("sls", "SLS"), ("acao direta de inconstitucionalidade", "ADI"),
    ("adi", "ADI"), ("embargos", "E"), ("e", "E"), ("agravo", "Ag"), ("ag", "Ag"),
]
#: Ordinal words that number the next class.
ORDINALS = {
    "segundo": "2", "segundos": "2", "segunda": "2", "terceiro": "3", "terceiros": "3", "quarto": "4",
    "2o": "2", "2º": "2", "3o": "3", "3º": "3",
}
#: The court that a class implies, and classes written out.
COURT_OF_CLASS = {
    "resp": "STJ", "aresp": "STJ", "rhc": "STJ", "hc": "STJ", "rms": "STJ", "re": "STF", "rcl": "STF", "recl": "STF",
    "reclamacao": "STF", "ms": "STF", "respe": "TSE", "arespel": "TSE", "rp": "TSE", "ai": "TSE", "rr": "TST",
    "arr": "TST", "airr": "TST", "ar": "TST", "apl": "STM", "rse": "STM",
}
WRITTEN_OUT = {
    "recurso especial": "resp", "agravo em recurso especial": "aresp", "recurso em habeas corpus": "rhc",
    "habeas corpus": "hc", "recurso de revista": "rr", "agravo de instrumento": "ai", "mandado de seguranca": "ms",
    "recurso especial eleitoral": "respe", "reclamacao": "rcl", "recurso extraordinario": "re",
    "recurso ordinario": "rr", "acao rescisoria": "ar",
}
#: Names of laws and their keys.
LAW_NAMES = {
    "cpc": "13105", "codigo de processo civil": "13105", "lei 13105": "13105", "cc": "10406", "codigo civil": "10406",
    "clt": "5452", "consolidacao das leis do trabalho": "5452", "cpp": "3689", "codigo de processo penal": "3689",
    "cpm": "1001", "codigo penal militar": "1001", "cdc": "8078", "codigo de defesa do consumidor": "8078",
    "codigo eleitoral": "4737", "cf": "CF", "constituicao federal": "CF", "constituicao da republica": "CF",
    "constituicao": "CF", "carta magna": "CF", "cf/88": "CF", "lc 64": "LC64", "lei complementar 64": "LC64",
    "lei complementar n 64": "LC64", "lc 64/1990": "LC64",
}


def _driver_skeleton(flat: str) -> str:
    """T-04 of a flat literal, for patterns that are built on the driver."""
    return T.skeleton_of(flat)


# --- class chains


class ChainReader:
    """L-01: class chains, read token by token from a trie of the forms. At each token the form declared first among
    those that match is read, not the longest one."""

    def __init__(self):
        self.trie: dict = {}
        for rank, (form, name) in enumerate(CLASS_FORMS):
            node = self.trie
            for token in form.split():
                node = node.setdefault(self._token(token), {})
            node.setdefault(None, (rank, name))
        self.ordinals = {self._token(k): v for k, v in ORDINALS.items()}

    @staticmethod
    def _token(token: str) -> str:
        return token if len(token) < 4 else _driver_skeleton(token)

    def read(self, flat: str) -> list[str]:
        """The chain of a flat text whose hyphens stand alone and whose courts' names are gone."""
        tokens, out, at, ordinal = [self._token(t) for t in flat.split()], [], 0, ""
        while at < len(tokens):
            if tokens[at] in self.ordinals:
                ordinal, at = self.ordinals[tokens[at]], at + 1
                continue
            node, best, i = self.trie, None, at
            while i < len(tokens) and (node := node.get(tokens[i])) is not None:
                i += 1
                if None in node and (best is None or node[None][0] < best[0]):
                    best = (*node[None], i)
            if best is None:
                at += 1
            else:
                out.append(best[1] + ordinal)
                ordinal, at = "", best[2]
        return out


_READER = ChainReader()


@F.pandas_udf(ArrayType(StringType()))
def _read_chains(flat: pd.Series) -> pd.Series:
    return pd.Series([_READER.read(t or "") for t in flat])


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _read_many_chains(flat: pd.Series) -> pd.Series:
    return pd.Series([None if ts is None else [_READER.read(t or "") for t in ts] for ts in flat])


def _chain_text(text: Column) -> Column:
    """What the chain reader reads: a flat text without courts' names, its hyphens apart."""
    glued = F.regexp_replace(text, r"([a-z])([A-Z]{2,})", "$1 $2")
    flat = F.regexp_replace(T.flatten_lower_first(glued), r"(?U)\b(tst|stf|stj|tse|stm)\b", " ")
    return T.collapse(F.replace(flat, F.lit("-"), F.lit(" - ")))


def class_chain(text: Column) -> Column:
    """L-01: the class chain of a text, outermost first. Normalisation runs in the JVM, the scan as an Arrow function."""
    return _read_chains(_chain_text(text))


def class_chains(texts: Column) -> Column:
    """L-01 for an array of texts; null for null."""
    return _read_many_chains(F.transform(texts, lambda t: _chain_text(F.coalesce(t, F.lit("")))))


def without_ordinals(chain: Column) -> Column:
    """L-02."""
    return F.transform(chain, lambda c: F.regexp_replace(c, "[0-9]+$", ""))


def first_link(chain: Column) -> Column:
    """L-02: the outermost class, without its ordinal."""
    return F.slice(without_ordinals(chain), 1, 1)


def fits_in(chain: Column, record: Column) -> Column:
    """L-03: the chain is a subsequence of the record's, each link a prefix of the record's link."""
    step = lambda i, link: F.when((i < F.size(chain)) & link.startswith(F.get(chain, i)), i + 1).otherwise(i)
    return F.aggregate(record, F.lit(0), step) == F.size(chain)


# --- court headers: (source, number, second number, class text)

_CLASSIC = r"[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{2,7}"
_UNIFIED = r"[0-9]{1,7}\s*-\s*[0-9]{2}\s*\.\s*[0-9]{4}\s*\.\s*[0-9]\s*\.\s*[0-9]{2}\s*\.\s*[0-9]{4}"
_LOOSE = r"[0-9]{1,7}\s*-\s*[0-9]\s*[0-9]\s*\.\s*[0-9]\s*[0-9]\s*[0-9]\s*[0-9]\s*\.\s*[0-9]\s*\.\s*[0-9]\s*[0-9]\s*\.\s*[0-9]\s*[0-9]\s*[0-9]\s*[0-9]"
_CAP = "[A-ZÀ-Ý]"

#: The headers' patterns. court: (source, characters of the header that are read, pattern, groups of class, number and second number)
HEADERS: dict[str, list[tuple[str, int | None, str, int, int, int | None]]] = {
    "STF": [("stf", 600, rf"(?:PLEN[AÁ]RIO|PRIMEIRA TURMA|SEGUNDA TURMA)\s+([A-ZÀ-Ý.\s]+?)\s+({_CLASSIC})\s+{_CAP}", 1, 2, None)],
    "STJ": [("stj", 400, rf"(?s)^(.{{2,120}}?)\s*N[ºo°]\s*({_CLASSIC})\s*-\s*[A-Z]{{2}}", 1, 2, None)],
    "STM": [("stm", 500, rf"({_CAP}[A-ZÀ-Ý\s.]{{2,80}}?)\s*N[ºo°]\s*({_UNIFIED})", 1, 2, None)],
    "TSE": [
        ("tse:cnj", 900, rf"(?s)((?:[A-ZÀ-Ý€„ƒ][\wÀ-ÿ€„ƒ.]*\s+){{1,14}}?)N\s*[.ºo°‚,]?\s*({_LOOSE})", 1, 2, None),
        ("tse:antigo", 900, rf"(?siu)AC[OÓ]RD[AÃ]O\s+(.{{3,220}}?)\s*N\s*[.]?\s*[ºo°]\s*({_CLASSIC})(?:\s*\(\s*({_LOOSE})\s*\))?", 1, 2, 3),
    ],
    "TST": [
        ("tst:autos", None, rf"(?s)(?:discutidos|examinados)\s+(?:estes|os\s+presentes)\s+autos\s+de\s+[^.]{{0,160}}?n\s*\.?\s*[ºo°]?\s*\.?\s*((?:[A-Za-z]{{1,10}}\s*-\s*){{1,12}})({_UNIFIED})", 1, 2, None),
        ("tst:autos_fraco", None, rf"(?s)estes\s+autos\s+de\s+.{{0,200}}?n\s*\.?\s*[ºo°]?\s*\.?\s*((?:[A-Za-z]{{1,10}}\s*-\s*){{1,12}})({_UNIFIED})", 1, 2, None),
    ],
}
_GENERIC = ("generico", 3000, rf"((?:{_CAP}[A-ZÀ-Ý.]*\s+){{1,10}}?)N\s*[.]?\s*[ºo°]\s*({_LOOSE}|{_CLASSIC})", 1, 2, None)


def _header(text: Column, source: str, most: int | None, pattern: str, cls: int, num: int, second: int | None) -> Column:
    """The header's struct, or null if the pattern isn't found."""
    head = F.left(text, F.lit(most)) if most else text
    if source.startswith("tse"):  # what follows the court's own name
        after = F.regexp_extract(head, r"(?s)^.*?ELEITORAL(.*)$", 1)
        head = F.when(head.contains("ELEITORAL"), after).otherwise(head)
    pattern = "(?U)" + pattern
    group = lambda g: F.regexp_extract(head, pattern, g)
    keys = [T.raw_key(group(num))]
    if second:
        keys.append(F.when(group(second) != "", T.raw_key(group(second))))
    found = F.struct(
        F.array_compact(F.array(*keys)).alias("keys"), F.lit(source).alias("source"),
        (F.coalesce(F.nullif(group(second), F.lit("")), group(num)) if second else group(num)).alias("number"), group(cls).alias("class"),
    )
    return F.when(group(num) != "", found)


def own_number(court: Column, text: Column) -> Column:
    """L-04, L-05: the own number in a record's header as (keys, source, number, class): by the court's patterns, then,
    but for one court, by a generic one. Without a match the keys are empty."""
    none = lambda s: F.struct(F.array().cast("array<string>").alias("keys"), s.alias("source"), F.lit("").alias("number"), F.lit("").alias("class"))
    court = F.upper(F.coalesce(court, F.lit("")))
    by_court = None
    for name, patterns in HEADERS.items():
        tried = [_header(text, *p) for p in patterns]
        if name != "TST":
            tried.append(_header(text, *_GENERIC))
        found = F.coalesce(*tried, none(F.lit(f"{name.lower()}:sem_padrao")))
        by_court = F.when(court == name, found) if by_court is None else by_court.when(court == name, found)
    return by_court.otherwise(F.coalesce(_header(text, *_GENERIC), none(F.lit("tribunal_desconhecido"))))


def summary_header(text: Column) -> Column:
    """L-06: (number, court, binding) of a record of a court's summary, or null."""
    head, p = F.left(text, F.lit(120)), r"(?iuU)S[uú]mula\s+(Vinculante\s+)?n\.?\s*([0-9]+)\s+do\s+(\w+)"
    number = F.regexp_extract(head, p, 2)
    found = F.struct(T.number_key(number).alias("number"), F.upper(F.regexp_extract(head, p, 3)).alias("court"), (F.regexp_extract(head, p, 1) != "").alias("binding"))
    return F.when(number != "", found)


def law_of_header(description: Column) -> Column:
    """L-08."""
    flat = T.flatten(description)
    digits = F.regexp_replace(F.substring_index(flat, ",", 1), "[^0-9]", "")
    after = F.left(F.regexp_extract(flat, r"(?s)complementar(.*)$", 1), F.lit(8))
    return F.when(flat.contains("constitui"), "CF").when(flat.contains("complementar"), F.concat(F.lit("LC"), F.regexp_replace(after, "[^0-9]", ""))).otherwise(T.number_key(digits))


def article_header(text: Column) -> Column:
    """L-07: (article, law) of a record of an article of law, or null."""
    head, p = F.left(text, F.lit(200)), r"(?siuU)Artigo\s+([0-9]+)\s*[ºo°]?\s+d[oa]s?\s+(.{5,80}?)\s+Art\.?\s"
    number = F.regexp_extract(head, p, 1)
    return F.when(number != "", F.struct(T.number_key(number).alias("article"), law_of_header(F.regexp_extract(head, p, 2)).alias("law")))


# --- what a citation says

#: OCR letters of digits, and the pattern of a cited law.
_OCR_CLASS = "OoDQlIi|ZzASsGbTBgq"
_LAW = (
    r"(?iuU)\bl\s*[eéêc]\s*[iíl1]\s*(?:((?=\S*\p{L}{3})\S{4,})\s+)?n?[ºo°.\s]*"
    rf"([0-9{_OCR_CLASS}][0-9{_OCR_CLASS}.\s]{{0,10}}?)\s*(?:/|,|;|\bd[eao]\b|$)"
)


def law_of_citation(quote: Column) -> Column:
    """L-09: the key of the law that a citation names, or null. The number is read in the original case, since the case
    tells OCR letters apart; a word between "Lei" and the number must be a form of "complementar"."""
    parsed = F.struct(
        T.flatten(quote).alias("flat"), T.skeleton(quote).alias("skeleton"), quote.rlike(_LAW).alias("has"),
        T.skeleton(F.regexp_extract(quote, _LAW, 1)).alias("skipped"),
        F.coalesce(T.number_of(F.regexp_replace(F.regexp_extract(quote, _LAW, 2), r"(?U)[.\s]", "")), F.lit("")).alias("digits"),
    )

    def choose(p: Column) -> Column:
        has, skeleton, digits = p["has"], p["skeleton"], p["digits"]
        short = F.regexp_extract(p["flat"], r"\blc\s*n?[º°o.\s]*([0-9]+)", 1)
        out = (
            F.when(has & (p["skipped"] != "") & ~p["skipped"].contains("omplementar"), F.lit(None).cast("string"))
            .when(has & skeleton.contains("omplementar"), F.concat(F.lit("LC"), digits))
            .when(has & (digits != ""), T.number_key(digits))
            .when(short != "", F.concat(F.lit("LC"), short))
            .when(skeleton.contains("eonstltul") | skeleton.contains("earta magna"), F.lit("CF"))
        )
        for name in sorted(LAW_NAMES, key=len, reverse=True):
            out = out.when(skeleton.rlike(rf"\b\Q{_driver_skeleton(name)}\E\b"), LAW_NAMES[name])
        return out

    return T.let(parsed, choose)


def form_of(quote: Column) -> Column:
    """L-10: vaga, sumula, tema, artigo, cnj or processo."""
    low = F.lower(quote)
    no_years = F.regexp_replace(low, r"\b(?:19|20)[0-9]{2}\b", " ")
    return (
        F.when(low.rlike(r"relatoria|rel\.(?U)\s*min|relator") & ~no_years.rlike("[0-9]"), "vaga")
        .when(low.rlike(r"^(?U)\s*[s5]\s*[uú]\s*[mr]"), "sumula")
        .when(low.rlike(r"^(?U)\s*te(?:m|rn)[aã]\b"), "tema")
        .when(low.rlike(r"^(?U)\s*art"), "artigo")
        .when(low.rlike(r"(?U)[0-9]{1,7}\s*-{1,2}\s*[0-9]{2}\s*[.\s]*[0-9]{4}"), "cnj")
        .otherwise("processo")
    )


def form_of_label(label: Column, quote: Column) -> Column:
    """L-11: a model's label decides before the text does."""
    form = form_of(quote)
    return F.when(label == "VAGA", "vaga").when(label == "LEI", "artigo").when(form.isin("vaga", "artigo"), "processo").otherwise(form)


def type_of_form(form: Column) -> Column:
    return F.when(form == "artigo", "lei").otherwise("jurisprudencia")


def implied_court(quote: Column) -> Column:
    """L-12: the court that a citation's class implies: classes written out first, the longest first, then the first
    token that is a class."""
    courts = F.create_map(*[F.lit(x) for kv in COURT_OF_CLASS.items() for x in kv])

    def choose(flat: Column) -> Column:
        tokens = F.transform(F.split(F.replace(flat, F.lit("-"), F.lit(" ")), " "), lambda t: F.btrim(t, F.lit(".,")))
        named = F.when(F.lit(False), F.lit(None).cast("string"))
        for phrase in sorted(WRITTEN_OUT, key=len, reverse=True):
            named = named.when(flat.contains(phrase), COURT_OF_CLASS[WRITTEN_OUT[phrase]])
        return named.otherwise(F.try_element_at(courts, F.get(F.filter(tokens, lambda t: t.isin(*COURT_OF_CLASS)), F.lit(0))))

    return T.let(T.flatten(quote), choose)


def summary_of_citation(quote: Column) -> Column:
    """L-13: (number, court, binding) of a cited summary; the number null if there is none."""
    p = r"(?iuU)[s5]\s*[uú]\s*(?:m|rn)(?:\s*[uú]\s*[lI1]\s*[aã]|\.)?\s*(v\S{3,}?\p{L})?\s*n?[ºo°.\s]*([0-9OolIiSsGgZ]{1,4})\b"
    number = T.number_of(F.nullif(F.regexp_extract(quote, p, 2), F.lit("")))
    court = F.upper(F.nullif(F.regexp_extract(quote, r"(?iu)\b(STJ|STF|TST|TSE|STM)\b", 1), F.lit("")))
    return F.struct(T.number_key(number).alias("number"), court.alias("court"), T.skeleton(F.regexp_extract(quote, p, 1)).contains("vlneulante").alias("binding"))


def article_of_citation(quote: Column) -> Column:
    """L-14: the digits of the article, or null."""
    p = r"(?iuU)[aáàãâ]\s*r\s*t(?:\s*[iíl1]\s*g\s*[oóôõ0]|\.|\b)\s*([0-9]{1,4}(?:\.[0-9]{3})?)"
    return T.number_key(F.nullif(F.regexp_replace(F.regexp_extract(quote, p, 1), "[^0-9]", ""), F.lit("")))


#: Articles and prepositions that no span begins with, and Brazil's states at a span's end.
LEADING_WORDS = ["o", "a", "os", "as", "no", "na", "nos", "nas", "do", "da", "dos", "das", "ao", "à", "pelo", "pela", "em", "de"]
STATE_AT_END = r"(?U)[/\-–—(]\s*(?:" + "|".join(T.STATES.values()) + r")\s*\)?\s*$"


def edge_violations(quote: Column, form: Column) -> Column:
    """L-15: which edge conventions a span breaks: white space at an end, or else punctuation at its last; an article or
    preposition as its first word; an article of law in capitals; a process without its state."""
    bare = F.regexp_replace(quote, r"(?U)^\s+|\s+$", "")
    blank = (quote == "") | (quote != bare)
    first = F.lower(F.regexp_extract(quote, r"(?U)^\s*(\S+)", 1))
    rules = [
        (blank, "space"),
        (~blank & quote.rlike(r"[.,;:]$"), "final_punctuation"),
        (first.isin(LEADING_WORDS), "leading_word"),
        ((form == "artigo") & ~quote.rlike(r"^\p{Ll}"), "capital_article"),
        ((form == "processo") & ~quote.rlike(STATE_AT_END), "no_state"),
    ]
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, name in rules]))


#: Key words of each subject, in the order in which ties are decided; without two of them it is civel.
SUBJECTS = {
    "militar": ["militar"],
    "eleitoral": ["eleitora", "eleição", "eleições"],
    "trabalhista": ["reclamant", "reclamad", "trabalh"],
    "penal": ["denúncia", "acusado", "pena ", "réu"],
}


def subject(text: Column) -> Column:
    """L-16: the subject with the most key words, at least two; else civel."""
    low = F.lower(text)
    counts = {s: sum((F.regexp_count(low, F.lit(w)) for w in words), F.lit(0)) for s, words in SUBJECTS.items()}
    most = F.greatest(*counts.values())
    out = F.when(most < 2, "civel")
    for s, n in counts.items():
        out = out.when(n == most, s)
    return out


def kind_of_text(quote: Column) -> Column:
    """The kind that a span's text shows: an article of law with a number; a judge and no number but years; else a
    decision."""
    low = F.lower(F.trim(quote))
    no_years = F.regexp_replace(low, r"(?U)\b(?:19|20)\d{2}\b", "")
    return F.when(low.rlike(r"(?U)\barts?\b\.?\s*\d|\bartigos?\s*\d"), "LEI").when(low.rlike(r"rel(?:\.|ator|atoria)") & ~no_years.rlike(r"(?U)\d"), "VAGA").otherwise("JURIS")


def by_criteria(text: Column, span: Column) -> Column:
    """L-19: a span (start, end, kind) as the criteria leave it, or null: without a digit it must name a judge; after a
    number with a state's code what names the judge is cut; laws stay laws, other kinds follow from the text."""
    whole = F.substring(text, span["start"] + 1, span["end"] - span["start"])

    def judged(quote: Column) -> Column:
        cites = quote.rlike(r"(?U)\d") | quote.rlike(r"(?iu)rel(?:\.|ator|atoria)")
        before = F.regexp_extract(quote, r"(?siuU)^(.*?),?\s*rel(?:\.|ator)", 1)  # up to the first judge
        code = F.regexp_extract(before, r"(?sU)^(.*?\d[\d.\-/]*\s*[-/]?\s*[A-Z]{2})\b", 1)
        left = F.when(quote.rlike(r"(?iu)rel(?:\.|ator)") & (code != ""), code).otherwise(quote)
        kind = F.when(span["kind"] == "LEI", "LEI").otherwise(kind_of_text(left))
        found = F.struct(span["start"].cast("int").alias("start"), (span["start"] + F.char_length(left)).cast("int").alias("end"), kind.alias("kind"))
        return F.when(cites, found)

    return T.let(whole, judged)


#: What names a law.
NAMES_A_LAW = r"(?iu)\b(?:cpc|cpp|clt|cf|cdc|ristf|ristj|c[oó]digo|lei|constitui|regimento|estatuto)"


def preferred_spans(text: Column, spans: Column) -> Column:
    """L-20: which of several versions (start, end, kind) of one citation stay, or null if no convention decides. Of a
    list with a shared class, and of a list of summaries, each number is a citation of its own; a law keeps its name; a
    theme its qualifier; decisions are cited from the earliest start to the latest end, as the criteria leave that."""
    quote = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    numbers = lambda s: F.regexp_count(quote(s), F.lit(r"(?U)\d[\d.]*"))
    width = lambda s: s["end"] - s["start"]
    holds = lambda pattern: F.filter(spans, lambda s: quote(s).rlike(pattern))
    single = F.filter(spans, lambda s: numbers(s) == 1)
    first_longest = lambda some: F.slice(F.filter(some, lambda s: width(s) == F.array_max(F.transform(some, width))), 1, 1)
    named, qualified = holds(NAMES_A_LAW), holds(r"(?iu)repercuss|\brg\b")
    of_kind = lambda kind: F.forall(spans, lambda s: s["kind"] == kind)
    envelope = F.struct(
        F.array_min(F.transform(spans, lambda s: s["start"])).alias("start"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("end"), F.lit("JURIS").alias("kind")
    )
    whole = T.let(by_criteria(text, envelope), lambda e: F.when(e.isNotNull() & quote(e).rlike(r"(?U)\d"), F.array(e)))
    is_list = F.exists(spans, lambda s: (numbers(s) >= 2) & quote(s).rlike(r"(?iuU)\s(?:e|,)\s"))
    return F.coalesce(
        F.when(is_list & (F.size(single) > 0), single),
        F.when(of_kind("LEI") & (F.size(named) > 0), first_longest(named)),
        F.when(F.exists(spans, lambda s: quote(s).rlike(r"(?iuU)^\s*te(?:m|rn)a")) & (F.size(qualified) > 0), first_longest(qualified)),
        F.when((F.size(holds(r"(?iu)s[úu]mulas")) > 0) & (F.size(single) > 0), single),
        F.when(of_kind("JURIS"), whole),
    )


def law_parts(text: Column) -> Column:
    """L-21: the distinct incisos, paragraphs and letters of an article of law, in order."""
    part = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))
    return F.struct(part(r"(?m)^\s*([IVXLC]+)\s*[-–]").alias("incisos"), part(r"(?m)^\s*§\s*([0-9]+)").alias("paragraphs"), part(r"(?m)^\s*([a-z])\)").alias("letters"))
