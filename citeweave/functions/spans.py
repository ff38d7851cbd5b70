"""Span algebra (P-01 to P-14, J-10 to J-14): predicates on intervals and greedy folds over arrays of spans.

An interval is half open, [start, end), in code points. A span is a struct with at least start and end. The greedy
steps are folds with `aggregate` over sorted arrays, per document, in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column, Column], Column]


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def crosses(a: Column, b: Column) -> Column:
    """J-10: at least one character in common; touching isn't crossing."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def distance(a: Column, b: Column) -> Column:
    """J-11: characters between, negative where they cross."""
    return F.greatest(b["start"] - a["end"], a["start"] - b["end"])


def iou(a: Column, b: Column) -> Column:
    """P-01: intersection over the envelope, 0 where they don't cross."""
    inside = overlap(a, b)
    return F.when(inside > 0, inside / (F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"]))).otherwise(0.0)


def iou_columns(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    inside = F.least(end1, end2) - F.greatest(start1, start2)
    return F.when(inside > 0, inside / (F.greatest(end1, end2) - F.least(start1, start2))).otherwise(0.0)


def trimmed(start: Column, end: Column, text: Column) -> Column:
    """T-16: (start, end, quote) without space at both ends and without . , ; : at the right; null if nothing is left."""
    quote = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
    lead = F.char_length(F.regexp_extract(quote, r"^(?U)[\s ]+", 0))
    rest = F.substring(quote, lead + 1, F.char_length(quote))
    tail = F.char_length(F.regexp_extract(rest, r"(?U)[\s .,;:]+$", 0))
    left = F.char_length(rest) - tail
    found = F.struct((start + lead).cast("int").alias("start"), (start + lead + left).cast("int").alias("end"), F.substring(rest, F.lit(1), left).alias("quote"))
    return F.when(left > 0, found)


def _kept_by(spans: Column, clash: Predicate, kind: str) -> Column:
    """Spans in order, each kept if it clashes with none kept before."""
    return F.aggregate(
        spans,
        F.array().cast(f"array<{kind}>"),
        lambda kept, s: F.when(F.exists(kept, lambda k: clash(k, s)), kept).otherwise(F.concat(kept, F.array(s))),
    )


def without_overlap(spans: Column, kind: str, least: float = 0.5) -> Column:
    """P-02: by start, the longest first; a span stays if its IoU with all that stay is below `least`. `kind` is the
    spans' SQL struct type."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])))
    return _kept_by(order, lambda k, s: iou(k, s) >= least, kind)


def best_scored(spans: Column, kind: str) -> Column:
    """X-19, P-14: by score, the best first; a span stays if it crosses none that stays. Ties to the earlier, then
    shorter span."""
    by = F.array_sort(spans, lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]).cast("int")).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]))
    return _kept_by(by, crosses, kind)


def without_glued_vague(spans: Column, gap: int = 2) -> Column:
    """P-03: a vague span within `gap` characters of another span goes, whichever that is."""
    n = F.size(spans)

    def stays(s: Column, i: Column) -> Column:
        others = F.transform(spans, lambda o, j: (i != j) & (distance(s, o) <= gap))
        return ~s["kind"].isin("vague", "VAGA") | ~F.exists(others, lambda x: x)

    return F.when(n > 0, F.filter(spans, stays)).otherwise(spans)


def replace_weak(spans: Column, reserve: Column, least: float = 0.95) -> Column:
    """P-04: spans with a confidence below `least` go; a reserve span comes in if it crosses one of them and no strong
    one. Spans without confidence are strong. By start."""
    strong = F.filter(spans, lambda s: s["conf"].isNull() | (s["conf"] >= least))
    weak = F.filter(spans, lambda s: s["conf"] < least)
    extra = F.filter(reserve, lambda r: F.exists(weak, lambda w: crosses(r, w)) & ~F.exists(strong, lambda s: crosses(r, s)))
    return F.array_sort(F.concat(strong, extra), lambda a, b: a["start"] - b["start"])


def guarded(spans: Column, reserve: Column, gap: int = 2, least: float = 0.95) -> Column:
    """P-05: first the glued vague spans go, then weak ones are replaced."""
    return replace_weak(without_glued_vague(spans, gap), reserve, least)


def union_without_overlap(first: Column, second: Column) -> Column:
    """J-14: the first spans and those of the second that cross none of them, by start."""
    extra = F.filter(second, lambda s: ~F.exists(first, lambda f: crosses(f, s)))
    return F.array_sort(F.concat(first, extra), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]))


PAIR = "struct<gi:int,pi:int,iou:double>"


def _candidates(gold: Column, pred: Column, allowed: Predicate, least: float) -> Column:
    pairs = F.transform(gold, lambda g, i: F.transform(pred, lambda p, j: F.struct(i.cast("int").alias("gi"), j.cast("int").alias("pi"), iou(g, p).alias("iou"), allowed(g, p).alias("ok"))))
    good = F.filter(F.flatten(pairs), lambda c: c["ok"] & (c["iou"] >= least))
    return F.transform(good, lambda c: F.struct(c["gi"].alias("gi"), c["pi"].alias("pi"), c["iou"].alias("iou")))


def _one_to_one(candidates: Column) -> Column:
    return _kept_by(candidates, lambda k, c: (k["gi"] == c["gi"]) | (k["pi"] == c["pi"]), PAIR)


def any_pair(a: Column, b: Column) -> Column:
    return F.lit(True)


def match_greedy(gold: Column, pred: Column, least: float = 0.5, allowed: Predicate = any_pair) -> Column:
    """P-07: pairs (gi, pi, iou), the highest IoU first, then by place in gold and prediction; each span once."""
    order = lambda a, b: F.when(a["iou"] != b["iou"], F.signum(b["iou"] - a["iou"]).cast("int")).when(a["gi"] != b["gi"], a["gi"] - b["gi"]).otherwise(a["pi"] - b["pi"])
    return _one_to_one(F.array_sort(_candidates(gold, pred, allowed, least), order))


def same_kind(a: Column, b: Column) -> Column:
    return a["kind"] == b["kind"]


def match_first(gold: Column, pred: Column, least: float = 0.5, allowed: Predicate = same_kind) -> Column:
    """P-08: gold spans in order, each with the first unused prediction that fits."""
    order = lambda a, b: F.when(a["gi"] != b["gi"], a["gi"] - b["gi"]).otherwise(a["pi"] - b["pi"])
    return _one_to_one(F.array_sort(_candidates(gold, pred, allowed, least), order))


def match_best(gold: Column, pred: Column, least: float = 0.5, allowed: Predicate = any_pair) -> Column:
    """P-09: gold spans in order, each with its best unused prediction; ties to the first."""
    order = lambda a, b: F.when(a["gi"] != b["gi"], a["gi"] - b["gi"]).when(a["iou"] != b["iou"], F.signum(b["iou"] - a["iou"]).cast("int")).otherwise(a["pi"] - b["pi"])
    return _one_to_one(F.array_sort(_candidates(gold, pred, allowed, least), order))


def agreed(first: Column, second: Column, least: float = 0.8) -> Column:
    """P-11: for each pair of spans of one kind that two annotators set nearly alike, their envelope."""
    pairs = match_first(first, second, least)
    at = lambda spans, i: F.element_at(spans, i + 1)
    return F.transform(pairs, lambda p: F.struct(
        F.least(at(first, p["gi"])["start"], at(second, p["pi"])["start"]).alias("start"),
        F.greatest(at(first, p["gi"])["end"], at(second, p["pi"])["end"]).alias("end"),
        at(first, p["gi"])["kind"].alias("kind"),
    ))


def choose(fixed: Column, eligible: Column, least: float, kind: str, model_first: bool = True) -> Column:
    """P-14: eligible spans with a score of at least `least`, the best first (ties: the model's first, or last), that
    cross neither fixed ones nor each other; with the fixed ones, by start."""
    rank = lambda s: F.when(s["origin"] == "model", 0 if model_first else 1).otherwise(1 if model_first else 0)
    good = F.filter(eligible, lambda s: (s["score"] >= least) & ~F.exists(fixed, lambda f: crosses(f, s)))
    by = F.array_sort(good, lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]).cast("int")).when(rank(a) != rank(b), rank(a) - rank(b)).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]))
    return F.array_sort(F.concat(fixed, _kept_by(by, crosses, kind)), lambda a, b: a["start"] - b["start"])


def windows(n: Column, width: int, step: int) -> Column:
    """X-14: windows [i, j) of at most `width` tokens that cover n tokens, `step` apart."""
    if width < 1 or not 1 <= step <= width:
        raise ValueError(f"no windows of width {width} and step {step}")
    last = F.greatest(F.ceil((n - width) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).cast("int").alias("start"), F.least(k * step + width, n).cast("int").alias("end")))


def owner(token: Column, cover: Column) -> Column:
    """X-15: the index of the window that has a token farthest from its edges; of equal ones the first."""
    start = F.struct(F.lit(0).alias("best"), F.lit(-1).alias("far"))

    def step(acc: Column, w: Column) -> Column:
        far = F.when((w["w"]["start"] <= token) & (token < w["w"]["end"]), F.least(token - w["w"]["start"], w["w"]["end"] - 1 - token)).otherwise(-1)
        return F.when(far > acc["far"], F.struct(w["i"].alias("best"), far.cast("int").alias("far"))).otherwise(acc)

    numbered = F.transform(cover, lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("i")))
    return F.aggregate(numbered, start, step, lambda a: a["best"])
