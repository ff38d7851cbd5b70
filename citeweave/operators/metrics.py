"""Evaluation statistics (M-01 to M-38): grouped conditional sums, ranks and resampling by hashed weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

VERDICTS = ["real", "inventada", "incompleta"]


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / max(1, 2 tp + fp + fn)."""
    return 2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn)


def official_score(outcomes: DataFrame) -> DataFrame:
    """M-01 to M-04: one row per level (null: both, the second weighing double) with macro F1, tau, Brier and score.

    outcomes: level, gold_verdict (null: spurious), verdict (null: missed), link_ok, conf. A wrong link costs a false
    positive of `real` only; a wrong verdict costs a miss and a false positive. A verdict that neither gold nor
    prediction has is left out of the macro mean; without confidences there is no bonus."""
    g, v = F.col("gold_verdict"), F.col("verdict")
    right = (g == v) & ((g != "real") | F.col("link_ok"))
    wrong_link = (g == v) & (g == "real") & ~F.col("link_ok")
    sums = []
    for name in VERDICTS:
        tp = F.count_if(right & (g == name))
        fp = F.count_if((v == name) & (g.isNull() | (g != name))) + (F.count_if(wrong_link) if name == "real" else F.lit(0))
        fn = F.count_if((g == name) & (v.isNull() | (v != name)))
        sums += [tp.alias(f"tp_{name}"), fp.alias(f"fp_{name}"), fn.alias(f"fn_{name}")]
    brier = F.avg(F.when(g.isNotNull() & v.isNotNull() & F.col("conf").isNotNull(), F.pow(F.col("conf") - right.cast("double"), 2)))
    fake = F.count_if(g == "inventada")
    tau = F.when(fake > 0, F.count_if((g == "inventada") & (v == "real")) / fake).otherwise(0.0)
    rows = outcomes.groupBy("level").agg(*sums, tau.alias("tau"), brier.alias("brier"))
    used = [F.when(F.col(f"tp_{n}") + F.col(f"fp_{n}") + F.col(f"fn_{n}") > 0, f1(F.col(f"tp_{n}"), F.col(f"fp_{n}"), F.col(f"fn_{n}"))) for n in VERDICTS]
    seen = F.array_compact(F.array(*used))
    macro = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(seen), F.lit(1))
    rows = rows.withColumn("macro_f1", macro)
    bonus = F.when(F.col("brier").isNotNull(), 1 + 0.10 * (1 - F.col("brier"))).otherwise(1.0)
    rows = rows.withColumn("score", F.col("macro_f1") * (1 - 0.5 * F.col("tau")) * bonus).select("level", "macro_f1", "tau", "brier", "score")
    weight = F.when(F.col("level") == 2, 2.0).otherwise(1.0)
    both = rows.agg((F.sum(weight * F.col("score")) / F.sum(weight)).alias("score"))
    null = F.lit(None)
    return rows.unionByName(both.select(null.cast("int").alias("level"), null.cast("double").alias("macro_f1"), null.cast("double").alias("tau"), null.cast("double").alias("brier"), "score"))


def extraction_scores(counts: DataFrame, by: str = "kind") -> DataFrame:
    """M-06, M-07: precision, recall and F1 per kind and, with a null kind, over all. counts: (by, tp, fp, fn)."""
    rows = counts.rollup(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    one = F.lit(1)
    return rows.select(
        by, "tp", "fp", "fn", (F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))).alias("recall"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
    )


def error_buckets(outcomes: DataFrame) -> DataFrame:
    """M-08."""
    g, v = F.col("gold_verdict"), F.col("verdict")
    kind = F.when(v.isNull(), "NAO_EXTRAIDO").when(g.isNull(), "ESPURIO").when(g != v, "CLASSE_ERRADA").when((g == "real") & ~F.col("link_ok"), "LINK_ERRADO")
    return outcomes.withColumn("error", kind).filter("error is not null").groupBy("level", "error").agg(F.count(F.lit(1)).alias("n"))


def with_sums_before(rows: DataFrame, by: str, sums: list[str], descending: bool = False, buckets: int = 256) -> DataFrame:
    """rows, one per value of `by`, with the sums of columns over all rows before each (`<column>_before`), in two levels:
    rows are cut into ranges of `by` at approximate quantiles; ranges are summed up, a few hundred rows; and within a
    range each task runs over its own rows. No task sees all rows."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx(by, F.array(*map(F.lit, shares)), F.lit(10_000)).alias("c")).first()["c"] or []  # at most `buckets` numbers
    cuts = sorted(set(cuts))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))) if cuts else F.lit(0)
    dealt = rows.withColumn("range_", -below if descending else below)
    order = F.desc(by) if descending else F.asc(by)
    totals = dealt.groupBy("range_").agg(*[F.sum(c).alias(f"{c}_range") for c in sums])
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range_", *[F.coalesce(F.sum(f"{c}_range").over(earlier), F.lit(0)).alias(f"{c}_range") for c in sums])
    own = Window.partitionBy("range_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(totals), "range_")  # at most `buckets` rows
    out = out.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"{c}_range") for c in sums})
    return out.drop("range_", *[f"{c}_range" for c in sums])


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: added up for small n, else by its expansion, which is exact to a double's last digits."""
    n = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(64.0)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / k)
    series = F.log(n) + F.lit(0.5772156649015329) + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n * n * n * n)
    return F.when(n < 1, 0.0).when(n <= 64, small).otherwise(series)


def auroc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """M-19: the Mann-Whitney statistic from mid-ranks over distinct scores."""
    rows = scores.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    rows = with_sums_before(rows, score, ["n"]).withColumn("mid", F.col("n_before") + (F.col("n") + 1) / 2)
    s = rows.agg(F.sum(F.col("p") * F.col("mid")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return s.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auroc"))


def risk_coverage(scores: DataFrame, score: str = "score", error: str = "error") -> DataFrame:
    """M-20: one point per distinct confidence, the highest first: coverage and risk of all that is no less sure."""
    rows = scores.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(error).cast("long")).alias("e"))
    total = rows.agg(F.sum("n").alias("total"))
    rows = with_sums_before(rows, score, ["n", "e"], descending=True).crossJoin(F.broadcast(total))  # one row
    seen, wrong = F.col("n_before") + F.col("n"), F.col("e_before") + F.col("e")
    return rows.select(score, (seen / F.col("total")).alias("coverage"), (wrong / seen).alias("risk"))


def aurc(scores: DataFrame, score: str = "score", error: str = "error") -> DataFrame:
    """M-21: the mean risk over all coverages, within ties the expected one; that of an oracle; the excess. Sums of
    (a + b k) / (c + k) over the rows of a tie, and those of the oracle, are differences of harmonic numbers."""
    rows = scores.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(error).cast("long")).alias("e"))
    rows = with_sums_before(rows, score, ["n", "e"], descending=True)
    n, e, n0, e0 = (F.col(c) for c in ("n", "e", "n_before", "e_before"))
    part = e + (e0 - e * n0 / n) * (harmonic(n0 + n) - harmonic(n0))
    s = rows.agg(F.sum(part).alias("risk"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    best = e - (n - e) * (harmonic(n) - harmonic(n - e))
    return s.select((F.col("risk") / n).alias("aurc"), (best / n).alias("oracle"), ((F.col("risk") - best) / n).alias("excess"))


#: The edges of the confidence bands.
BAND_EDGES = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99]


def band_table(scores: DataFrame, score: str = "score", error: str = "error") -> DataFrame:
    """M-22: rows and errors per confidence band."""
    place = sum(((F.col(score) >= e).cast("int") for e in BAND_EDGES), F.lit(0))
    return scores.groupBy(place.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(error).cast("long")).alias("errors"))


def reliability(scores: DataFrame, score: str = "score", correct: str = "correct") -> DataFrame:
    """M-24: the share of hits of each confidence."""
    return scores.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("hit_rate"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """M-25: the Wilson interval (low, high)."""
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct((mid - half).alias("low"), (mid + half).alias("high"))


def timing(rows: DataFrame, seconds: str, by: list[str]) -> DataFrame:
    """M-26: mean, median v[n // 2], 95th value v[int(.95 n) - 1] and maximum."""
    s = rows.groupBy(*by).agg(F.sort_array(F.collect_list(seconds)).alias("v"), F.avg(seconds).alias("mean"))
    n = F.size("v")
    at = lambda i: F.get("v", F.greatest(i, F.lit(0)).cast("int"))
    return s.select(*by, "mean", at(F.floor(n / 2)).alias("median"), at((F.lit(0.95) * n).cast("int") - 1).alias("p95"), F.array_max("v").alias("max"))


#: A prime below 2^31: products of two numbers below it fit into a long, in every engine.
_PRIME = 2147483647


def _poisson_steps() -> list[int]:
    """Where the distribution of a Poisson(1) number steps up, as parts of _PRIME: a draw is the count of steps reached."""
    p = [0.36787944117144233]
    for k in range(7):
        p.append(p[-1] / (k + 1))
    return [int(total * _PRIME) for total in accumulate(p)]


def resample_weight(doc: Column, resample: Column, seed: int) -> Column:
    """A document's weight in a resample: a Poisson(1) draw by inversion at a number hashed from seed, resample and
    document by squaring in a prime field. The bootstrap of documents needs no count of them, no driver and no join."""
    mixed = (F.pmod(doc, F.lit(_PRIME)) * 48271 + resample * 69621 + seed) % _PRIME
    for _ in range(2):
        mixed = T.let(mixed, lambda x: (x * x % _PRIME * 48271 + resample + 11) % _PRIME)
    return T.let(mixed, lambda x: sum(((x >= step).cast("int") for step in _poisson_steps()), F.lit(0)))


#: Weights that a Python worker holds at once: a few arrays of so many numbers stay in a core's own cache.
_WEIGHTS_AT_ONCE = 32_000


def _weighted_sums(names: list[str], resamples: int, seed: int) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches (number, then the columns named): for each resample the sums of the columns times
    resample_weight of the number, and of the weights (drawn); as resample -1 the plain sums. Weights are drawn for
    many documents at once and meet the columns in a matrix product, so there is no row per document and resample."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        which = np.arange(resamples, dtype=np.int64)
        shift, later = ((which * 69621 + seed) % _PRIME).astype(np.uint64), (which + 11).astype(np.uint64)
        steps = _poisson_steps()
        sums, plain = np.zeros((resamples, len(names) + 1)), np.zeros(len(names) + 1)
        most = max(1, _WEIGHTS_AT_ONCE // resamples)
        shape = (most, resamples)
        wide, high, narrow = np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.empty(shape, np.uint32)
        hits, counts, weights = np.empty(shape, bool), np.empty(shape, np.uint8), np.empty(shape)

        def draw(number: np.ndarray) -> np.ndarray:
            """The weights of documents (rows) in all resamples. 2^31 is 1 modulo _PRIME, so adding the bits above the
            31st to those below keeps the remainder; no product passes 2^64."""
            n = len(number)
            x, y, z, hit, count = wide[:n], high[:n], narrow[:n], hits[:n], counts[:n]

            def fold() -> None:
                np.right_shift(x, 31, out=y)
                np.bitwise_and(x, _PRIME, out=x)
                np.add(x, y, out=x)

            np.add(number[:, None], shift, out=x)
            for _ in range(2):
                np.multiply(x, x, out=x)
                fold()
                np.multiply(x, 48271, out=x)
                np.add(x, later, out=x)
                fold()
            np.subtract(x, _PRIME, out=y)  # wraps around to a large number where x is less
            np.minimum(x, y, out=x)
            z[:] = x
            count[:] = 0
            for step in steps:
                np.greater_equal(z, step, out=hit)
                np.add(count, hit.view(np.uint8), out=count)
            weights[:n] = count
            return weights[:n]

        seen = False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            values = np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in names)])
            plain += values.sum(axis=0)
            named = np.asarray(batch.column("number").is_valid().to_numpy(zero_copy_only=False))
            number = batch.column("number").fill_null(0).to_numpy(zero_copy_only=False)[named]
            number, values = (number * 48271 % _PRIME).astype(np.uint64), values[named]
            for i in range(0, len(number), most):
                sums += draw(number[i : i + most]).T @ values[i : i + most]
        if seen:
            out = {"resample": [-1, *range(resamples)]}
            rows = np.vstack([plain, sums])
            yield pa.RecordBatch.from_pydict(out | {c: rows[:, i] for i, c in enumerate(["drawn", *names])}, pa.schema([("resample", pa.int32())] + [(c, pa.float64()) for c in ["drawn", *names]]))

    return run


def _number_of(doc: str, frame: DataFrame) -> Column:
    """A document's name as a long: itself, if it is a whole number."""
    kind = frame.schema[doc].dataType.simpleString()
    return F.col(doc).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(doc)


def resampled(rows: DataFrame, resamples: int, seed: int = 0, doc: str = "doc_id") -> DataFrame:
    """rows, once for each resample in which their document has a weight, with (resample, weight)."""
    each = rows.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    return each.withColumn("weight", resample_weight(_number_of(doc, rows), F.col("resample"), seed)).filter("weight > 0")


def resampled_sums(rows: DataFrame, sums: list[str], resamples: int, seed: int = 0, doc: str = "doc_id") -> DataFrame:
    """(resample, drawn, sums): the sums of columns over resampled(rows), times the weight, and of the weights; the rows'
    own sums are resample -1. Each task adds up its rows for all resamples and returns one row for each; all numbers
    are whole, so the order of adding doesn't matter below 2^53."""
    number = F.pmod(_number_of(doc, rows), F.lit(_PRIME)).cast("long").alias("number")
    given = rows.select(number, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums])
    parts = given.mapInArrow(_weighted_sums(sums, resamples, seed), ", ".join(["resample int", *[f"{c} double" for c in ["drawn", *sums]]]))
    return parts.groupBy("resample").agg(*[F.sum(c).alias(c) for c in ["drawn", *sums]]).filter("resample < 0 or drawn > 0")


def bootstrap_f1_difference(counts: DataFrame, resamples: int = 2000, seed: int = 0, doc: str = "doc_id") -> DataFrame:
    """M-13, M-14: the difference of two extractors' F1, its interval from the sorted resamples of documents (of 2,000,
    those at 50 and 1949), and how often the first is better. counts: (doc, tp_a, fp_a, fn_a, tp_b, fp_b, fn_b)."""
    cols = [f"{c}_{x}" for x in "ab" for c in ("tp", "fp", "fn")]
    difference = f1(F.col("tp_a"), F.col("fp_a"), F.col("fn_a")) - f1(F.col("tp_b"), F.col("fp_b"), F.col("fn_b"))
    per_doc = counts.groupBy(doc).agg(*[F.sum(c).alias(c) for c in cols])
    each = resampled_sums(per_doc, cols, resamples, seed, doc).select(difference.alias("d"), (F.col("resample") < 0).alias("whole"))
    drawn = F.sort_array(F.collect_list(F.when(~F.col("whole"), F.col("d"))))  # one value per resample
    all_ = each.agg(F.max(F.when(F.col("whole"), F.col("d"))).alias("difference"), drawn.alias("v"))
    low = resamples // 40
    at = lambda i: F.get("v", F.least(F.lit(i), F.size("v") - 1))
    better = F.when(F.size("v") > 0, F.size(F.filter("v", lambda x: x > 0)) / F.size("v"))
    return all_.select("difference", at(low).alias("low"), at(resamples - 1 - low).alias("high"), better.alias("p_better"))


def threshold_sweep(spans: DataFrame, gold_n: DataFrame, grid: list[float], near: float = 0.95) -> DataFrame:
    """M-17, M-18: F1 per threshold and the chosen one: the best F1, ties to the threshold nearest `near`, then to the
    larger. spans: (conf, hit); gold_n: one row with n. Confidences are summed up once for each threshold they pass."""
    steps = F.filter(F.array(*map(F.lit, grid)), lambda t: F.col("conf") >= t)
    rows = spans.select(F.explode(steps).alias("t"), "hit").groupBy("t").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    rows = rows.crossJoin(F.broadcast(gold_n)).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("n") - F.col("tp")))  # gold_n is one row
    order = Window.orderBy(F.desc("f1"), F.abs(F.col("t") - near), F.desc("t"))
    return rows.select("t", "tp", "fp", "f1", (F.row_number().over(order) == 1).alias("chosen"))


def weighted_scores(counts: DataFrame, population: DataFrame, stratum: str = "stratum") -> DataFrame:
    """M-15: F1 with each stratum weighted by its share of the population over its share of the sample."""
    n = counts.groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    rows = n.join(population, stratum).withColumn("w", F.col("size") / F.col("sampled"))
    s = rows.agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    return s.select(f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def dispersion(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """M-27."""
    v = F.col(value)
    return values.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.stddev_samp(v).alias("stdev"))


def pooled_f1(counts: DataFrame, by: list[str]) -> DataFrame:
    """M-28: F1 of the sums of tp, fp and fn over documents and seeds."""
    s = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def confidence_tail(spans: DataFrame, conf: str = "conf", hit: str = "hit", least: int = 10) -> DataFrame:
    """M-30: of the hits, how many there are, the least confidence, how many lie below 0.98, 0.95 and 0.90, and the
    `least` smallest; and how many spans are no hit."""
    c, h = F.col(conf), F.col(hit)
    smallest = spans.filter(h & c.isNotNull()).select(c.alias("c")).orderBy("c").limit(least)
    smallest = smallest.agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: F.round(x, 4)).alias("smallest"))
    below = [F.count_if(h & (c < t)).alias(f"below_{round(100 * t):03d}") for t in (0.98, 0.95, 0.9)]
    counts = spans.agg(F.count_if(h).alias("hits"), F.count_if(~h).alias("false_positives"), F.round(F.min(F.when(h, c)), 4).alias("least"), *below)
    return counts.crossJoin(smallest)  # one row each


def unseen_mass(items: DataFrame, item: str) -> DataFrame:
    """M-33: Chao's estimate of the kinds not seen, from how many were seen once and twice."""
    n = items.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    s = n.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count(F.lit(1)).alias("kinds"))
    return s.select("kinds", "once", "twice", F.when(F.col("twice") > 0, F.col("once") * F.col("once") / (2 * F.col("twice"))).otherwise(F.col("once") * (F.col("once") - 1) / 2).alias("unseen"))


def most_common(rows: DataFrame, value: str, k: int) -> DataFrame:
    """M-32: the k most frequent values, ties by value."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(k)


def within_tolerance(measured: Column, published: Column, digits: int) -> Column:
    """M-31."""
    return F.abs(measured - published) <= F.lit(max(0.5 * 10**-digits, 5e-5))
