"""Numbers of zeros only, which large order keys give: 10.O00.000 leaves 00.000 (F2)."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from citeweave.operators import studies as U
from citeweave.plans import rule_queries as Q


def test_zeros_are_no_digits_of_a_case(spark):
    text = " " * 400 + "REsp 10.O00.000, 000.012.345, 00000, 00001, 0.012.345 e 10000"
    found = spark.range(1).select(U.case_numbers(F.lit(text)).alias("x")).first().x
    assert [(n.quote, n.key) for n in found] == [("000.012.345", "12345"), ("0.012.345", "12345"), ("10000", "10000")]


def test_twin_at_large_keys(spark, tmp_path):
    keys = [k for base in (1_285_714, 1_500_000, 4_500_000, 8_999_999) for k in range(base - 3, base + 4)]
    rows = [(k, n, k % 20_000) for k in keys for n in range(1, 8)]
    lines = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey"]).astype({"l_linenumber": "int32"})
    lines.to_parquet(tmp_path / "lineitem.parquet")
    want = duckdb.connect().execute(Q.CASES_SQL.replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'")).fetchall()
    assert sorted(map(tuple, Q.case_numbers(spark, str(tmp_path)).collect())) == sorted(want)
    assert any(k == 1_500_000 and n == 3 for k, n in {r[:2] for r in want})
