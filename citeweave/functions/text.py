"""Text normalisation as Column functions (T-01 to T-34): all but the last group run in the JVM.

Java's \\w, \\s, \\b and (?i) are ASCII unless (?U) and (?u) are set, so patterns here set them. Offsets are code points.
"""

from __future__ import annotations

import difflib
import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: Letters that OCR writes for digits, in the order in which inversions list them.
OCR_LETTERS = "OoDQlIi|ZzASsGbTBgq"
OCR_DIGITS = "0000111122455667899"


def _latin() -> tuple[str, str]:
    """Latin letters of up to U+024F and U+1EFF that decompose into one ASCII letter and marks, with that letter."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _PLAIN = _latin()
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a generator stands between it and its uses, so that filters inferred
    from joins don't repeat its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def strip_accents(text: Column) -> Column:
    """T-01: letters without their marks; combining marks go."""
    return F.translate(text, _ACCENTED + _MARKS, _PLAIN)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def flatten(text: Column) -> Column:
    """T-02: no accents, lower case, single spaces."""
    return collapse(F.lower(strip_accents(text)))


def flatten_lower_first(text: Column) -> Column:
    """T-03: as flatten, but lower case comes first."""
    return collapse(strip_accents(F.lower(text)))


#: What OCR confuses in names: first a pair of letters, then single characters.
SKELETON_PAIR, SKELETON_FROM, SKELETON_TO = ("rn", "m"), "015ic", "olsle"


def _skeleton_of_flat(flat: Column) -> Column:
    return F.translate(F.replace(flat, *map(F.lit, SKELETON_PAIR)), SKELETON_FROM, SKELETON_TO)


def skeleton_of(flat: str) -> str:
    """The same for a literal on the driver."""
    letters = dict(zip(SKELETON_FROM, SKELETON_TO, strict=True))
    return "".join(letters.get(c, c) for c in SKELETON_PAIR[1].join(flat.split(SKELETON_PAIR[0])))


def skeleton(text: Column) -> Column:
    """T-04: a form in which OCR variants of a name meet; for names, never for numbers."""
    return _skeleton_of_flat(flatten(text))


def token_skeleton(text: Column) -> Column:
    """T-05: the skeleton of each token of four or more characters of a flat text."""
    tokens = F.filter(F.split(text, " "), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.when(F.char_length(t) < 4, t).otherwise(_skeleton_of_flat(t))), " ")


def ocr_to_digits(text: Column) -> Column:
    """T-06: OCR letters as the digits they stand for."""
    return F.translate(text, OCR_LETTERS, OCR_DIGITS)


def digits_only(text: Column) -> Column:
    """T-07: digits and OCR letters as digits, nothing else."""
    return F.regexp_replace(ocr_to_digits(text), "[^0-9]", "")


def number_of(text: Column) -> Column:
    """T-08: T-07, or null without a single real digit."""
    return F.when(text.rlike("[0-9]"), digits_only(text))


def is_numeric_piece(piece: Column) -> Column:
    """T-09: at least one digit, no fewer digits than letters, and nothing but digits and OCR letters."""
    digits = F.regexp_count(piece, F.lit("[0-9]"))
    letters = F.regexp_count(piece, F.lit(r"\p{L}"))
    return (digits > 0) & (digits >= letters) & piece.rlike(r"^[0-9OoDQlIi|ZzASsGbTBgq]+$")


def letters_of_digits() -> dict[str, list[str]]:
    """T-10: the letters that OCR writes for each digit."""
    out: dict[str, list[str]] = {}
    for letter, digit in zip(OCR_LETTERS, OCR_DIGITS, strict=True):
        if letter.isalpha():
            out.setdefault(digit, []).append(letter)
    return out


def number_key(digits: Column) -> Column:
    """T-11, T-15: without leading zeros, or as it is if there is nothing else."""
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), digits)


def raw_key(text: Column) -> Column:
    """T-12: the key of an isolated number."""
    return number_key(digits_only(text))


def numeric_core(quote: Column) -> Column:
    """T-13: the digits of the run of numeric pieces with the most real digits; of equal ones the first.

    / ( ) , ; : end a number, while dots, hyphens and spaces may stand inside. One fold over the pieces carries the best
    run and the current one; an empty piece stands for each end."""
    text = F.replace(quote, F.lit("\\n"), F.lit("\n"))
    parts = F.split(text, "[/(),;:]", -1)
    pieces = F.flatten(F.transform(parts, lambda p: F.concat(F.split(p, r"(?U)[.\-\s ]+", -1), F.array(F.lit("")))))
    start = F.struct(F.lit("").alias("best"), F.lit(0).alias("most"), F.lit("").alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        numeric, better = is_numeric_piece(p), acc["n"] > acc["most"]
        return F.struct(
            F.when(~numeric & better, acc["run"]).otherwise(acc["best"]).alias("best"),
            F.when(~numeric & better, acc["n"]).otherwise(acc["most"]).alias("most"),
            F.when(numeric, F.concat(acc["run"], p)).otherwise("").alias("run"),
            F.when(numeric, acc["n"] + F.regexp_count(p, F.lit("[0-9]"))).otherwise(0).alias("n"),
        )

    return digits_only(F.aggregate(pieces, start, step, lambda a: a["best"]))


def citation_key(quote: Column) -> Column:
    """T-13, T-11, T-14: the key of a citation; beyond 20 digits of a unified number the last 20 count."""
    unified = quote.rlike(r"(?U)[0-9]{7}\s*-\s*[0-9]{2}\s*\.\s*[0-9]{4}")
    clamp = lambda key: F.when((F.char_length(key) > 20) & unified, F.ltrim(F.right(key, F.lit(20)), F.lit("0"))).otherwise(key)
    return let(number_key(numeric_core(quote)), clamp)


def bank_key(text: Column) -> Column:
    """T-17: lower case letters a-z, braces and spaces only."""
    return F.regexp_replace(strip_accents(F.lower(text)), "[^a-z{} ]", "")


def dedup_key(text: Column) -> Column:
    """T-18: single spaces, trimmed, lower case."""
    return F.lower(collapse(text))


#: The patterns of numbers that would give a document away, and their slots, in the order of replacement.
MONTHS = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
SLOTS = [
    (r"\b[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}\b", "{CNJ}"),
    (rf"\b[0-9]{{1,2}}º? de (?:{MONTHS}) de [0-9]{{4}}\b", "{DATA}"),
    (r"\bfls?\.\s*[0-9]+(?:/[0-9]+)?", "{FLS}"),
    (r"\bOAB/[A-Z]{2}\s*[0-9]+", "{OAB}"),
    (r"\b(?:19|20)[0-9]{2}\.[0-9]{5,8}\b", "{PROTOCOLO}"),
]


def with_slots(text: Column) -> Column:
    """T-23: numbers that would give a document away become slots."""
    for pattern, slot in SLOTS:
        text = F.regexp_replace(text, "(?U)" + pattern, slot)
    return text


def sentences(text: Column) -> Column:
    """T-24: split after . ! ? where a capital follows."""
    return F.split(collapse(text), r"(?<=[.!?])\s+(?=[A-ZÀ-Ý])", -1)


def wrap(text: Column, limit: int) -> Column:
    """T-25: the space after the word that reaches the limit becomes a line feed; the length stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(-1).alias("at"))

    def step(acc: Column, word: Column) -> Column:
        first, full = acc["at"] < 0, acc["at"] >= limit
        gap = F.when(first, "").when(full, "\n").otherwise(" ")
        at = F.when(first | full, 0).otherwise(acc["at"] + 1) + F.char_length(word)
        return F.struct(F.concat(acc["out"], gap, word).alias("out"), at.alias("at"))

    return F.aggregate(F.split(text, " ", -1), start, step, lambda a: a["out"])


def paragraphs(text: Column) -> Column:
    """T-26: parts between blank lines, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n", -1), F.trim), lambda p: p != "")


def is_section_header(paragraph: Column) -> Column:
    return paragraph.rlike(r"^[IVX]+\s+[—–-]")


def clean_judge(name: Column) -> Column:
    """T-27: a judge's name without up to two titles before it and without the remark that a judge was called in."""
    out = F.regexp_replace(collapse_ends(name), r"(?siuU)\s+\(?(?:desembargador|ju[ií]z)a?\s+convocad.*$", "")
    return collapse_ends(F.regexp_replace(out, r"(?iuU)^(?:\s*(?:min(?:istr[oa])?\.?|desembargadora?(?:\s+federal)?)\s+){1,2}", ""))


def collapse_ends(text: Column) -> Column:
    """Without white space at both ends; empty for null."""
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


#: Brazil's states and their codes.
STATES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPA": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARA": "CE", "DISTRITO FEDERAL": "DF",
    "ESPIRITO SANTO": "ES", "GOIAS": "GO", "MARANHAO": "MA", "MATO GROSSO": "MT", "MATO GROSSO DO SUL": "MS",
    "MINAS GERAIS": "MG", "PARA": "PA", "PARAIBA": "PB", "PARANA": "PR", "PERNAMBUCO": "PE", "PIAUI": "PI",
    "RIO DE JANEIRO": "RJ", "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS", "RONDONIA": "RO", "RORAIMA": "RR",
    "SANTA CATARINA": "SC", "SAO PAULO": "SP", "SERGIPE": "SE", "TOCANTINS": "TO",
}


def state_of_header(court: Column, text: Column, number: Column) -> Column:
    """T-28: the state's code in a record's header, which follows the record's own number: a code after a hyphen (STJ)
    or a slash (STM), or the state's full name (STF). No other court writes it."""
    head = F.left(text, F.lit(900))
    at = F.position(number, head)
    after = F.when(at > 0, F.substring(head, at + F.char_length(number), F.lit(60)))
    code = lambda sign: F.nullif(F.regexp_extract(after, rf"(?U)^\s*{sign}\s*([A-Z]{{2}})\b", 1), F.lit(""))
    plain, named = F.upper(strip_accents(after)), F.lit(None).cast("string")
    for name in sorted(STATES, key=len):  # longer names are tested before those they begin with
        named = F.when(plain.rlike(rf"(?U)^\s*{name}\b"), STATES[name]).otherwise(named)
    return F.when(court == "STJ", code("-")).when(court == "STM", code("/")).when(court == "STF", named)


def normal_id(value: Column) -> Column:
    """T-29: an id, without leading zeros if it is a number; 0 if it is all zeros."""
    value = F.trim(value)
    return F.when(value.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(value, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(value)


def same_id(predicted: Column, accepted: Column) -> Column:
    """T-29: whether one of several accepted ids, listed with spaces or : | , ; between, is the predicted one."""
    listed = F.transform(F.filter(F.split(accepted, r"[\s:|,;]+", -1), lambda x: x != ""), normal_id)
    return F.coalesce(F.array_contains(listed, normal_id(predicted)), F.lit(False))


def mask_digits(text: Column) -> Column:
    """T-30."""
    return F.regexp_replace(text, "[0-9]", "#")


def marked_context(text: Column, start: Column, end: Column, width: int = 90) -> Column:
    """T-31: a span between [[ ]] with up to `width` characters on either side."""
    left = F.greatest(start - width, F.lit(0))
    part = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    return F.concat(part(left, start), F.lit("[["), part(start, end), F.lit("]]"), part(end, end + width))


def first_json_object(text: Column) -> Column:
    """T-33: what stands from the first { to the last }, if it is JSON; else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def match_offsets(text: Column, pattern: str) -> Column:
    """All matches of a pattern as (start, end, quote) in code points, without a Python function: the lengths of the
    parts between matches and of the matches add up to the offsets. The pattern must not match the empty string."""
    quotes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(quotes, gaps, lambda q, g: F.struct(q.alias("q"), g.alias("g")))
    pairs = F.filter(pairs, lambda p: p["q"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,quote:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["g"])
        end = start + F.char_length(p["q"])
        hit = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), p["q"].alias("quote"))
        return F.struct(F.concat(acc["out"], F.array(hit)).alias("out"), end.cast("int").alias("at"))

    return F.aggregate(pairs, F.struct(none.alias("out"), F.lit(0).alias("at")), step, lambda a: a["out"])


# --- functions that need a map back to offsets, or difflib: Arrow functions for small inputs


_ORDINAL_SIGNS = str.maketrans("º°ª", "ooa")
_OCR_TABLE = str.maketrans(OCR_LETTERS, OCR_DIGITS)


def _mapped(text: str, ocr: bool = False) -> tuple[str, list[int]]:
    """T-19: letters and digits only, without marks and in folded case, with the place that each came from; with ocr the
    folded letters that OCR writes for digits become these."""
    parts, places = [], []
    for i, c in enumerate(text.translate(_ORDINAL_SIGNS)):
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isalnum()).casefold()
        parts.append(folded.translate(_OCR_TABLE) if ocr else folded)
        places += [i] * len(folded)
    return "".join(parts), places


def find_normalised(text: str, quote: str, least: int = 3) -> tuple[int, int, str] | None:
    """T-20: where a quote stands in a text when both are normalised, as offsets of the text, and how it was found:
    `normalised`, or, in a second pass, with OCR letters read as digits, `ocr`. Quotes shorter than `least` aren't
    searched."""
    for how, ocr in (("normalised", False), ("ocr", True)):
        (whole, places), (part, _) = _mapped(text, ocr), _mapped(quote, ocr)
        if len(part) < least:
            return None
        if (i := whole.find(part)) >= 0:
            return places[i], places[i + len(part) - 1] + 1, how
    return None


#: The widths of windows that are compared with a quote, as shares of its length.
WINDOW_SHARES = (1.0, 0.8, 1.25)


def find_similar(text: str, quote: str, least: int = 3) -> tuple[int, int, float] | None:
    """T-21: the window of the normalised text most like the normalised quote, as offsets of the text, with their
    ratio; of equally good ones the first."""
    (whole, places), (part, _) = _mapped(text), _mapped(quote)
    if len(part) < least or not whole:
        return None
    matcher, top, found = difflib.SequenceMatcher(autojunk=False), 0.0, None
    matcher.set_seq2(part)
    for width in dict.fromkeys(max(least, min(int(len(part) * share), len(whole))) for share in WINDOW_SHARES):
        for at in range(len(whole) - width + 1):
            matcher.set_seq1(whole[at : at + width])
            if matcher.real_quick_ratio() > top and matcher.quick_ratio() > top and (ratio := matcher.ratio()) > top:
                top, found = ratio, (at, at + width - 1)
    return found and (places[found[0]], places[found[1]] + 1, round(top, 3))


def is_similar(a: str, b: str, least: float = 0.9) -> bool:
    """T-22."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() > least


def lenient_json(text: str, key: str) -> dict | None:
    """T-32: the first JSON object in a text that has a key, whatever stands around it."""
    at, decoder = text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            if isinstance(found, dict) and key in found:
                return found
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


MARKS = {"J": "JURIS", "L": "LEI", "V": "VAGA"}


def align_markup(marked: str, original: str) -> list[tuple[int, int, str]] | None:
    """T-34: the spans that ⟦J⟧…⟦/J⟧ marks set, as offsets of the text without marks; null if that isn't the original,
    or a mark is left open, nested or unknown."""
    spans, at, i, opened = [], 0, 0, None
    out: list[str] = []
    while i < len(marked):
        if marked[i] != "⟦":
            out.append(marked[i])
            at, i = at + 1, i + 1
            continue
        j = marked.find("⟧", i)
        name = marked[i + 1 : j] if j > 0 else ""
        if opened is None and name in MARKS:
            opened = (name, at)
        elif opened and name == "/" + opened[0]:
            spans.append((opened[1], at, MARKS[opened[0]]))
            opened = None
        else:
            return None
        i = j + 1
    return spans if opened is None and "".join(out) == original else None


_OFFSETS = [StructField("start", IntegerType()), StructField("end", IntegerType())]


@F.pandas_udf(BooleanType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and is_similar(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StructType([*_OFFSETS, StructField("how", StringType())]))
def normalised_offsets(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    found = [find_normalised(t or "", q or "") or (None, None, None) for t, q in zip(text, quote, strict=True)]
    return pd.DataFrame(found, columns=["start", "end", "how"]).astype({"start": "Int32", "end": "Int32"})


@F.pandas_udf(StructType([*_OFFSETS, StructField("ratio", DoubleType())]))
def similar_offsets(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    found = [find_similar(t or "", q or "") or (None, None, None) for t, q in zip(text, quote, strict=True)]
    return pd.DataFrame(found, columns=["start", "end", "ratio"]).astype({"start": "Int32", "end": "Int32", "ratio": float})
