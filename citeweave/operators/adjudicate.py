"""Annotation: agreement, adjudication, verifier policies and audits (P-11 to P-17, L-19, L-20, M-25, M-29, M-37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import spans as S
from ..functions import text as T

SPAN = "struct<start:int,end:int,kind:string>"


def agreement(first: Column, second: Column, least: float = 0.8) -> Column:
    """P-11: (agreed envelopes, divergent spans) of two annotators' arrays of spans."""
    both = S.agreed(first, second, least)
    rest = F.filter(F.concat(first, second), lambda s: ~F.exists(both, lambda b: S.crosses(s, b)))
    return F.struct(both.alias("agreed"), rest.alias("divergent"))


def adjudicated(text: Column, agreed: Column, divergent: Column, third: Column) -> Column:
    """P-12: arrays of spans (start, end, kind) that two annotators agree on, that they don't, and of a third one (null:
    no vote) as one array (start, end, kind, how). Agreed spans stay. A divergent one goes if the criteria drop it or
    leave what is agreed already; alone it stays as the criteria leave it; among versions that cross it the conventions
    choose, else the one version that the third confirms; where the third marks nothing there, it goes; else it stays
    ambiguous. Each span comes once, with the first reason."""
    none = F.array().cast(f"array<{SPAN}>")
    as_how = lambda spans, how: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(how).alias("how")))

    def same(a: Column, b: Column) -> Column:
        return (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["kind"] == b["kind"])

    def decided(s: Column) -> Column:
        rivals = F.filter(divergent, lambda o: ~same(o, s) & S.crosses(o, s))

        def choose(r: Column) -> Column:
            known = r.isNull() | F.exists(agreed, lambda a: S.iou(r, a) >= 0.5)

            def among(versions: Column) -> Column:
                confirmed = F.filter(versions, lambda c: F.exists(third, lambda v: (S.iou(c, v) >= 0.8) & (c["kind"] == v["kind"])))
                untouched = ~F.exists(versions, lambda c: F.exists(third, lambda v: S.crosses(c, v)))

                def by_third(own: Column) -> Column:
                    return F.when(F.size(own) == 1, as_how(own, "third")).when((F.size(own) == 0) & untouched, as_how(none, "third"))

                vote = F.when(third.isNotNull(), T.let(confirmed, by_third))
                return F.coalesce(as_how(L.preferred_spans(text, versions), "preferred"), vote, as_how(F.array(s), "ambiguous"))

            alone = as_how(F.array(r), "criteria")
            return F.when(known, as_how(none, "criteria")).when(F.size(rivals) == 0, alone).otherwise(T.let(F.concat(F.array(s), rivals), among))

        return T.let(L.by_criteria(text, s), choose)

    every = F.concat(as_how(agreed, "agreed"), F.flatten(F.transform(divergent, decided)))
    kept = F.array().cast("array<struct<start:int,end:int,kind:string,how:string>>")
    once = F.aggregate(every, kept, lambda acc, s: F.when(F.exists(acc, lambda k: same(k, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(once)


def adjudicate(rows: DataFrame) -> DataFrame:
    """P-12 over documents (doc_id, text, agreed, divergent, third): one row per span that stays. No shuffle."""
    spans = adjudicated(F.col("text"), *[F.col(c).cast(f"array<{SPAN}>") for c in ("agreed", "divergent", "third")])
    return rows.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")


def candidate_scores(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """P-15: candidates with the best score of another extractor's spans of their kind and IoU of at least a half; 0
    without one."""
    c, s = candidates.alias("c"), spans.select("doc_id", "start", "end", "kind", F.col("score").alias("other")).alias("s")
    near = (F.col("c.doc_id") == F.col("s.doc_id")) & (F.col("c.kind") == F.col("s.kind")) & (F.col("c.start") < F.col("s.end")) & (F.col("s.start") < F.col("c.end"))
    iou = S.iou_columns(F.col("c.start"), F.col("c.end"), F.col("s.start"), F.col("s.end"))
    rows = c.join(s, near & (iou >= 0.5), "left").groupBy(*[F.col(f"c.{x}").alias(x) for x in candidates.columns])
    return rows.agg(F.coalesce(F.max("s.other"), F.lit(0.0)).alias("score"))


def oracle_scores(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """P-16: 1 for candidates that are gold, else 0."""
    hit = gold.select("doc_id", "start", "end", "kind").distinct().withColumn("score", F.lit(1.0))
    return candidates.join(hit, ["doc_id", "start", "end", "kind"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def guard_groups(spans: Column, reserve: Column, gap: int = 2, least: float = 0.95) -> Column:
    """P-13: the guard's four groups: strong, weak, glued and reserve spans that may come in."""
    kept = S.without_glued_vague(spans, gap)
    strong = F.filter(kept, lambda s: s["conf"].isNull() | (s["conf"] >= least))
    weak = F.filter(kept, lambda s: s["conf"] < least)
    glued = F.array_except(spans, kept)
    extra = F.filter(reserve, lambda r: F.exists(weak, lambda w: S.crosses(r, w)) & ~F.exists(strong, lambda s: S.crosses(r, s)))
    return F.struct(strong.alias("strong"), weak.alias("weak"), glued.alias("glued"), extra.alias("extra"))


def changed_documents(a: DataFrame, b: DataFrame, doc: str = "doc_id") -> DataFrame:
    """P-17: documents whose sorted spans differ."""
    pack = lambda x, n: x.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(n))
    rows = pack(a, "x").join(pack(b, "y"), doc, "full")
    return rows.filter(~F.col("x").eqNullSafe(F.col("y"))).select(doc)


def precision_study(a: DataFrame, b: DataFrame, least: float = 0.95) -> DataFrame:
    """M-29: spans in both runs, the largest change of confidence, and how many cross the threshold."""
    rows = a.select("doc_id", "start", "end", F.col("conf").alias("x")).join(b.select("doc_id", "start", "end", F.col("conf").alias("y")), ["doc_id", "start", "end"], "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return rows.agg(
        F.count_if(both).alias("both"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"),
        F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"), F.count_if((F.col("x") >= least) != (F.col("y") >= least)).alias("crossings"),
    )


def ignoring_zones(outcomes: DataFrame, zones: DataFrame) -> DataFrame:
    """M-37: outcomes that cross no zone still in dispute."""
    o, z = outcomes.alias("o"), zones.alias("z")
    return o.join(z, (F.col("o.doc_id") == F.col("z.doc_id")) & (F.col("o.start") < F.col("z.end")) & (F.col("z.start") < F.col("o.end")), "left_anti")
