"""Sums over resampled documents without a row per document and resample (F1)."""

import pytest
from pyspark.sql import functions as F

from citeweave.operators import metrics as M

COLS = [f"{c}_{x}" for x in "ab" for c in ("tp", "fp", "fn")]


def counts_of(spark, docs, kind="long"):
    rows = [(d, *[(i * k + k) % 7 for k in range(1, 7)]) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, ", ".join([f"doc_id {kind}", *[f"{c} long" for c in COLS]]))


@pytest.mark.parametrize(("docs", "kind", "seed"), [([*range(300), 2**31 - 1, 2**31, 2**62 + 5, -3, None], "long", 0), (["a", "b", None, "é"], "string", -7_000_000), ([5], "int", 3)])
def test_sums_are_those_of_resampled_rows(spark, docs, kind, seed):
    counts = counts_of(spark, docs, kind)
    got = {r.resample: tuple(r)[1:] for r in M.resampled_sums(counts, COLS, 150, seed).collect()}
    rows = M.resampled(counts, 150, seed).groupBy("resample").agg(F.sum("weight"), *[F.sum(F.col("weight") * F.col(c)) for c in COLS])
    assert got.pop(-1) == tuple(counts.agg(F.count(F.lit(1)), *[F.sum(c) for c in COLS]).first())
    assert got == {r.resample: tuple(r)[1:] for r in rows.collect()}


def test_bootstrap_makes_no_row_per_document_and_resample(spark):
    counts = counts_of(spark, range(0, 3_000_000, 1000)).repartition(3)
    out = M.bootstrap_f1_difference(counts)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.first()
    tp, fp, fn = ([sum((i * k + k) % 7 for i in range(3000)) for k in ks] for ks in ((1, 4), (2, 5), (3, 6)))
    f1 = [2 * t / (2 * t + p + n) for t, p, n in zip(tp, fp, fn, strict=True)]
    assert row.difference == pytest.approx(f1[0] - f1[1]) and row.low <= row.difference <= row.high and 0 <= row.p_better <= 1


def test_bootstrap_of_nothing(spark):
    assert tuple(M.bootstrap_f1_difference(counts_of(spark, [])).first()) == (None, None, None, None)
