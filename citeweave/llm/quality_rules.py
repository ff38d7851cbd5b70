"""Quality rules: a decision list learned from labelled statistics.

Each document gets statistics of its whole text. From labelled rows, sequential covering learns ordered rules: a rule
is a conjunction of thresholds on statistics, grown one threshold at a time on two thirds of the rows by information
gain and pruned back on the rest; rows it covers are taken away, and the next rule is learned, until no rule is precise
enough on the pruning rows. The list becomes one ordered Spark conditional expression: the first rule that holds
decides, and where none holds the document is good.

Learning takes at most `sample` labelled rows (those with the least hash of their doc_id), a documented bound; applying
covers all.

Defined cases: a null or empty text has no words, and so fails the base rule. A null label takes no part in learning.
Without labelled rows of both kinds the list is empty and only the base rule decides. Null doc_ids and repeated rows
are judged like others; of rows that share a labelled doc_id, the one with the least statistics is learned from.
Documents with several labels count as bad if any label says so. Texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Lean, free_name, least_hashed, stored

#: The columns of the base rule, then those that only the learned rules use.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = [
    "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share",
    "word_variety", "short_line_share", "stop_share", "mark_end_share", "line_words", "space_share",
]
#: Frequent short words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with be by this from or have an not at but they which their one all"
    " der die und das von zu den mit ist im des auf für nicht ein eine als auch es sich dem"
    " le la les de des et un une du en que qui dans pour par sur est pas plus il au"
    " el los las y del se por con una su para como más o lo al".split()
)
_BLANK = " \t\n\x0b\x0c\r"
#: Classes of ASCII characters as bytes; deleting a class from a text's bytes counts it.
_CLASSES = {"blank": _BLANK.encode(), "symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": b"0123456789", "punct": b".,;:!?"}
_MARK_ENDS = [m + b for m in "!|*#&%$>" for b in " \n"]


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    reach = n = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, reach)
            reach = i + 3
    return n


def statistics(text: str | None) -> list[float]:
    """COUNTS then RATIOS of a whole text. Words are runs of other characters than ASCII white space."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the ASCII white space
    n = len(words)
    full = [x for x in text.split("\n") if x.strip(_BLANK)]
    dup = len(full) - len(set(full))
    of = {k: len(raw) - len(raw.translate(None, c)) for k, c in _CLASSES.items()}
    chars = len(text) - of["blank"]
    repeats = repeated_words(words)
    per, lowered = max(n, 1), text.lower().split()
    marked = sum(map(text.count, _MARK_ENDS)) if of["symbol"] or "!" in text else 0
    ratios = [
        chars / per,
        of["symbol"] / max(chars, 1),
        dup / max(len(full), 1),
        repeats / per,
        of["upper"] / max(chars, 1),
        of["digit"] / max(chars, 1),
        of["punct"] / max(chars, 1),
        len(set(lowered)) / per,
        sum(1 for x in full if len(x) < 40) / max(len(full), 1),
        sum(map(STOP_WORDS.__contains__, lowered)) / per,
        marked / per,
        n / max(len(full), 1),
        of["blank"] / max(len(text), 1),
    ]
    return [n, chars, of["symbol"], dup, repeats, *ratios]


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, COUNTS as longs, RATIOS as doubles), one row per document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics(t) for t in batch["text"]], columns=COUNTS + RATIOS)
            out[COUNTS] = out[COUNTS].astype("int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy() if kind == "string" else batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(Lean(run), schema)


@dataclass(frozen=True)
class Condition:
    column: str
    above: bool
    threshold: float

    def of(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.column] > self.threshold if self.above else table[self.column] <= self.threshold

    def column_expr(self) -> Column:
        return F.col(self.column) > F.lit(self.threshold) if self.above else F.col(self.column) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.column} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.of(table)
    return out


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's information gain of going from p0 positives and n0 negatives to p and n."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(table: dict[str, np.ndarray], y: np.ndarray, columns: list[str], most: int) -> Rule:
    """Adds the threshold with the most gain until no negative is covered, none helps or `most` are in."""
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(rule) < most and (p0 := int(y[inside].sum())) and (n0 := int((~y[inside]).sum())):
        best: tuple[float, Condition] | None = None
        for c in columns:
            x, t = table[c][inside], y[inside]
            order = np.argsort(x, kind="stable")
            xs, pos = x[order], np.cumsum(t[order])
            ends = np.flatnonzero(np.diff(xs) > 0)
            if not len(ends):
                continue
            cut, below = (xs[ends] + xs[ends + 1]) / 2, ends + 1
            for above in (False, True):
                p = p0 - pos[ends] if above else pos[ends]
                n = (len(xs) - below if above else below) - p
                g = _gain(p.astype(float), n.astype(float), p0, n0)
                k = int(np.argmax(g))
                if best is None or g[k] > best[0] + 1e-12:
                    best = (float(g[k]), Condition(c, above, float(cut[k])))
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        inside &= best[1].of(table)
    return tuple(rule)


def _prune(rule: Rule, table: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The front part of the rule with the best (p - n) / (p + n) on the pruning rows; ties to the shorter one."""
    best, worth = rule, -np.inf
    for k in range(1, len(rule) + 1):
        hit = _covers(rule[:k], table, len(y))
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth = rule[:k], value
    return best


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, columns: list[str], precision: float = 0.97, least: int = 5, most_rules: int = 24, most_conditions: int = 4, seed: int = 7) -> list[Rule]:
    """Sequential covering of the bad rows. A rule must cover at least `least` rows and be `precision` precise on the
    growing and on the pruning rows; the first that isn't ends the list."""
    rules: list[Rule] = []
    rng, left = np.random.default_rng(seed), np.arange(len(bad))
    while len(rules) < most_rules and bad[left].any() and not bad[left].all():
        order = rng.permutation(left)
        part = np.zeros(len(bad), bool)
        for kind in (True, False):  # two thirds of either kind
            own = order[bad[order] == kind]
            part[own[: -(-2 * len(own) // 3)]] = True
        grow, prune = order[part[order]], order[~part[order]]
        rule = _grow({c: table[c][grow] for c in columns}, bad[grow], columns, most_conditions)
        if not rule:
            break
        if len(prune):
            rule = _prune(rule, {c: table[c][prune] for c in columns}, bad[prune])
        hit = {k: i[_covers(rule, {c: table[c][i] for c in columns}, len(i))] for k, i in (("all", left), ("grow", grow), ("prune", prune))}
        if len(hit["all"]) < least or any(len(i) and bad[i].mean() < precision for i in hit.values()):
            break
        rules.append(rule)
        left = np.setdiff1d(left, hit["all"])
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """One ordered conditional expression: the number, from 1, of the first rule that holds, or 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column_expr()
        out = F.when(hit, F.lit(k)).otherwise(out)
    return out


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def labelled(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", sample: int = 20_000) -> DataFrame:
    """(doc_id, q) of at most `sample` labelled documents, those with the least hash."""
    held = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("q")).filter("doc_id is not null and q is not null")
    held = held.groupBy("doc_id").agg(F.min("q").alias("q"))
    return least_hashed(held, "doc_id", sample)


def fit_rules(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", sample: int = 20_000) -> list[Rule]:
    """Rules that find documents labelled quality 0, learned from at most `sample` labelled rows."""
    rows = stats.join(F.broadcast(labelled(labels, doc_id, quality, sample)), "doc_id").select("doc_id", "q", *COUNTS, *RATIOS)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*")
    rows = rows.toPandas().sort_values("doc_id", kind="stable")  # bounded by sample: one row for each document
    if rows.empty:
        return []
    columns = [*RATIOS, "n_words"]
    return learn_rules({c: rows[c].to_numpy(float) for c in columns}, rows["q"].to_numpy() == 0, columns)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000) -> DataFrame:
    """(doc_id, statistics, base_failed, rule, kept): one row per document."""
    stats = stored(with_statistics(docs, doc_id, text))
    out = stats.withColumn("rule", rules_column(fit_rules(stats, labels, sample=sample)))
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judge(docs, labels)
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000) -> DataFrame:
    """The documents that the rules keep, with all their columns. Statistics are computed beside the row, in one more
    pass over the texts, so no text is shuffled."""
    chosen = F.broadcast(labelled(labels, doc_id, sample=sample).select(F.col("doc_id").alias(doc_id)))  # bounded by sample
    rules = fit_rules(with_statistics(docs.join(chosen, doc_id, "left_semi"), doc_id, text), labels, doc_id, sample=sample)
    names = COUNTS + RATIOS
    spot = free_name(docs, "quality_stats")

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=names).astype(float)

    verdict = free_name(docs, "quality_kept")
    rows = docs.withColumn(spot, measure(F.col(text)))

    def of(c: Condition) -> Column:
        x = F.col(spot)[c.column]
        return x > F.lit(c.threshold) if c.above else x <= F.lit(c.threshold)

    bad = base_failed(F.col(spot)["n_words"], F.col(spot)["n_repeat_words"])
    for rule in rules:
        hit = F.lit(True)
        for c in rule:
            hit = hit & of(c)
        bad = bad | hit
    return rows.withColumn(verdict, ~bad).filter(F.col(verdict)).drop(spot, verdict)
