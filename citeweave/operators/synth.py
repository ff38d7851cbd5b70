"""Synthetic documents and noise (G-01, G-02, G-05 to G-16): deterministic, by hashed draws; offsets by running sums of lengths."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import letters_of_digits
from .sampling import draw

#: Classes written out, with their articles.
WRITTEN = {
    "REsp": ("Recurso Especial", "no"), "RE": ("Recurso Extraordinário", "no"), "AgInt": ("Agravo Interno", "no"), "AgR": ("Agravo Regimental", "no"),
    "ED": ("Embargos de Declaração", "nos"), "HC": ("Habeas Corpus", "no"), "MS": ("Mandado de Segurança", "no"), "RR": ("Recurso de Revista", "no"),
    "Rcl": ("Reclamação", "na"), "APL": ("Apelação", "na"),
}


def render_chain(chain: Column, short: Column) -> Column:
    """G-01: a class chain as text, abbreviated (second level) or written out, joined by its articles."""
    names = F.create_map(*[F.lit(x) for k, (v, _) in WRITTEN.items() for x in (k, v)])
    links = F.create_map(*[F.lit(x) for k, (_, a) in WRITTEN.items() for x in (k, a)])

    def part(c: Column, i: Column) -> Column:
        name = F.when(short, c).otherwise(F.coalesce(F.try_element_at(names, c), c))
        return F.when(i == 0, name).otherwise(F.concat(F.coalesce(F.try_element_at(links, c), F.lit("no")), F.lit(" "), name))

    return F.array_join(F.transform(chain, part), " ")


def render_number(digits: Column, style: Column) -> Column:
    """G-02: dotted, plain or with a marker, by style 0, 1 or 2."""
    dotted = F.replace(F.format_number(digits.cast("long"), 0), F.lit(","), F.lit("."))
    return F.when(style == 0, dotted).when(style == 1, digits.cast("string")).otherwise(F.concat(F.lit("nº "), dotted))


def render_state(code: Column, style: Column) -> Column:
    return F.when(style == 0, F.concat(F.lit("/"), code)).when(style == 1, F.concat(F.lit(" - "), code)).otherwise(F.concat(F.lit(" ("), code, F.lit(")")))


#: G-06. Prepositions with the masculine and the feminine article.
AGREEMENT = {"o": "a", "no": "na", "do": "da", "ao": "à", "pelo": "pela", "este": "esta", "nesse": "nessa"}


def agree(word: Column, feminine: Column) -> Column:
    forms = F.create_map(*[F.lit(x) for kv in AGREEMENT.items() for x in kv])
    return F.when(feminine, F.coalesce(F.try_element_at(forms, word), word)).otherwise(word)


def unambiguous(index: DataFrame) -> DataFrame:
    """G-07: records whose number and class chain no other record has."""
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "chain"))
    return index.withColumn("n", n).filter("n = 1").drop("n")


#: Seven digits.
_FIRST, _NUMBERS = 1_000_000, 9_000_000


def fabricated_numbers(rows: DataFrame, index: DataFrame, key: str, seed: str, tries: int = 5) -> DataFrame:
    """G-08: for each row a number that no record has: the first of several draws that survives an anti join. Rows with
    no such draw get one drawn from the list of all free numbers; if there is none, this fails."""
    taken = index.select(F.col("key").alias("number")).distinct()
    drawn = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    number = (F.lit(_FIRST) + F.floor(draw(seed, F.col(key), F.col("attempt")) * _NUMBERS)).cast("long").cast("string")
    free = drawn.withColumn("number", number).join(taken, "number", "left_anti")
    found = free.groupBy(key).agg(F.min_by("number", "attempt").alias("number"))
    left = rows.select(key).distinct().join(found.select(F.col(key).alias("done")), F.col(key).eqNullSafe(F.col("done")), "left_anti")
    if left.isEmpty():
        return found
    every = rows.sparkSession.range(_FIRST, _FIRST + _NUMBERS).select(F.col("id").cast("string").alias("number"))
    every = every.join(taken, "number", "left_anti").withColumn("bucket", F.substring("number", 1, 3))
    counts = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # at most 900 rows
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        raise ValueError("every number is taken")
    before = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("number")) - 1
    listed = every.withColumn("place", place).join(F.broadcast(counts.select("bucket", before.alias("before"))), "bucket")
    listed = listed.select("number", (F.col("before") + F.col("place")).cast("long").alias("place"))
    chosen = left.withColumn("place", F.floor(draw(seed, F.col(key), F.lit("free")) * total).cast("long"))
    return found.unionByName(chosen.join(listed, "place").select(key, "number"))


def assemble(parts: DataFrame, doc: str = "doc_id", order: str = "seq", piece: str = "piece", is_citation: str = "is_citation") -> tuple[DataFrame, DataFrame]:
    """G-05: documents from ordered pieces, and the offsets of the pieces that are citations."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("start", F.coalesce(F.sum(F.char_length(piece)).over(before), F.lit(0)).cast("int"))
    text = parts.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece]), "").alias("text"))
    gold = rows.filter(is_citation).select(doc, order, "start", (F.col("start") + F.char_length(piece)).cast("int").alias("end"), F.col(piece).alias("quote"))
    return text, gold


def fill_slots(text: Column, values: dict[str, Column]) -> Column:
    """G-09: {SLOT}s by values of the row."""
    for slot, value in values.items():
        text = F.replace(text, F.lit("{" + slot + "}"), value)
    return text


def check_documents(texts: DataFrame, gold: DataFrame, doc: str = "doc_id") -> DataFrame:
    """G-13: documents that break a rule: (doc, overlap, mismatch, slot, edge)."""
    after = F.lead("start").over(Window.partitionBy(doc).orderBy("start"))
    rows = gold.withColumn("next", after).join(texts, doc)
    quote = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    rows = rows.groupBy(doc).agg(
        F.count_if(F.col("next") < F.col("end")).alias("overlap"), F.count_if(quote != F.col("quote")).alias("mismatch"),
        F.count_if(F.col("text").rlike(r"\{[A-Z]+\}")).alias("slot"), F.count_if(F.col("quote").rlike(r"^\s|[\s.,;:]$")).alias("edge"),
    )
    return rows.filter("overlap + mismatch + slot + edge > 0")


def first_good(candidates: DataFrame, n: int, level: str = "level", key: str = "doc_id") -> DataFrame:
    """G-14: n documents, levels in turn, from more candidates than needed that have passed the checks."""
    rows = candidates.withColumn("turn", F.row_number().over(Window.partitionBy(level).orderBy(key)))
    return rows.orderBy("turn", level, key).limit(n).drop("turn")


# --- noise


_UNIFIED = re.compile(r"\d{1,7}\s*-\s*\d{2}\s*\.\s*\d{4}\s*\.\s*\d\s*\.\s*\d{2}\s*\.\s*\d{4}")
_NUMBER = re.compile(r"\d[\d.]{3,}\d")
#: How OCR writes letters of words.
WORD_NOISE = {"m": "rn", "l": "1", "o": "0", "e": "c", "i": "l", "S": "5"}


def number_cores(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """G-12: the numbers inside spans, unified ones first; none inside another."""
    found: list[tuple[int, int]] = []
    for pattern in (_UNIFIED, _NUMBER):
        for m in pattern.finditer(text):
            inside = any(a <= m.start() and m.end() <= b for a, b in spans)
            if inside and all(m.end() <= a or b <= m.start() for a, b in found):
                found.append(m.span())
    return sorted(found)


def add_noise(text: str, spans: list[tuple[int, int]], strength: float, seed: str) -> tuple[str, list[tuple[int, int]]]:
    """G-10, G-11: a noisy text and where the spans are in it. A digit only becomes a letter that reads back as it, and
    never the first of a number; letters outside numbers may change too. No strength, no change."""
    if strength <= 0:
        return text, list(spans)
    rng = random.Random(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big"))
    letters, cores = letters_of_digits(), number_cores(text, spans)
    pieces = list(text)
    for a, b in cores:
        digits = [i for i in range(a + 1, b) if text[i].isdigit() and text[i] in letters]
        for i in digits[:]:
            # the run between separators keeps as many digits as letters
            low = max(text.rfind(c, a, i) for c in ".-/ ") + 1 or a
            ends = [j for c in ".-/ " if (j := text.find(c, i, b)) >= 0]
            run = range(max(low, a), min(ends, default=b))
            changed = sum(not pieces[j].isdigit() for j in run)
            if rng.random() < strength and 2 * (changed + 1) <= len(run):
                pieces[i] = rng.choice(letters[text[i]])
    kept = {i for a, b in cores for i in range(a, b)}
    for i, c in enumerate(text):
        if i not in kept and c in WORD_NOISE and rng.random() < strength / 4:
            pieces[i] = WORD_NOISE[c]
    at = [0]
    for p in pieces:
        at.append(at[-1] + len(p))
    return "".join(pieces), [(at[a], at[b]) for a, b in spans]


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("spans", _SPANS)]))
def noisy(text: pd.Series, spans: pd.Series, strength: pd.Series, seed: pd.Series) -> pd.DataFrame:
    out = []
    for t, ss, f, k in zip(text, spans, strength, seed, strict=True):
        noisy_text, places = add_noise(t or "", [(s["start"], s["end"]) for s in (ss if ss is not None else [])], f, str(k))
        out.append((noisy_text, [{"start": a, "end": b} for a, b in places]))
    return pd.DataFrame(out, columns=["text", "spans"])


def phrase_bank(documents: DataFrame, doc: str, sentences: str, subject: str) -> DataFrame:
    """G-15: sentences by how many subjects they are seen in: of one, narrative; of several, generic."""
    rows = documents.select(doc, subject, F.explode(sentences).alias("sentence"))
    seen = rows.groupBy("sentence").agg(F.count_distinct(subject).alias("subjects"), F.count_distinct(doc).alias("documents"), F.min(subject).alias("subject"))
    return seen.withColumn("role", F.when(F.col("subjects") == 1, "narrative").otherwise("generic"))


def adversarial_auc(rows: DataFrame, text: str, label: str, folds: int = 5, repeats: int = 5, features: int = 1 << 14, seed: int = 0) -> tuple[float, float]:
    """M-34: how well a linear model on TF-IDF of words (1 and 2) and characters (3 to 5) tells real from synthetic texts:
    mean and deviation, over the repeats, of the area under the curve of all rows, each scored by the model of the folds
    that it isn't in. 0.5: not at all. Folds hold the same share of either label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, VectorAssembler

    names = ["w1", "w2", "c3", "c4", "c5"]
    stages = [RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"(?U)\W+"), NGram(n=2, inputCol="w1", outputCol="w2"), RegexTokenizer(inputCol=text, outputCol="c1", pattern="")]
    stages += [NGram(n=k, inputCol="c1", outputCol=f"c{k}") for k in (3, 4, 5)]
    stages += [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features) for c in names] + [IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf") for c in names]
    stages += [VectorAssembler(inputCols=[f"{c}_idf" for c in names], outputCol="features"), LogisticRegression(maxIter=20, regParam=0.01)]
    rows, judge, areas = rows.withColumn("label", F.col(label).cast("double")), BinaryClassificationEvaluator(), []
    for r in range(repeats):
        place = F.row_number().over(Window.partitionBy("label").orderBy(draw(f"adv{seed + r}", F.col(text)), text))
        dealt, scored = rows.withColumn("fold", place % folds), None
        for k in range(folds):
            model = Pipeline(stages=stages).fit(dealt.filter(F.col("fold") != k))
            part = model.transform(dealt.filter(F.col("fold") == k)).select("label", "rawPrediction")
            scored = part if scored is None else scored.unionByName(part)
        areas.append(judge.evaluate(scored))
    mean = sum(areas) / len(areas)
    return mean, (sum((a - mean) ** 2 for a in areas) / len(areas)) ** 0.5


def leak_free_auc(documents: DataFrame, bank: DataFrame, generate: Callable[[DataFrame, int], DataFrame], folds: int = 2, doc: str = "doc_id", text: str = "text", **options) -> list[float]:
    """M-35: for each fold of the real documents, the adversarial area of the fold against texts generated from the
    bank's entries of other documents only, so that no synthetic text holds a phrase of a document that it is compared
    with. generate(bank, fold) returns rows with the text column."""
    areas = []
    for k in range(folds):
        own = documents.withColumn("fold", F.floor(draw("honest", F.col(doc)) * folds).cast("int")).filter(F.col("fold") == k).drop("fold")
        allowed = bank.join(own.select(doc), doc, "left_anti")
        rows = own.select(text, F.lit(1).alias("real")).unionByName(generate(allowed, k).select(text, F.lit(0).alias("real")))
        areas.append(adversarial_auc(rows, text, "real", **options)[0])
    return areas
