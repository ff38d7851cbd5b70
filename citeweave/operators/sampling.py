"""Sampling, splits and draws by hash (R-01 to R-11): deterministic, and the same wherever a row lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(seed: str, *cols: Column, digits: int = 13) -> Column:
    """A uniform number in [0, 1) from seed and columns."""
    text = F.concat_ws("-", F.lit(seed), *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long") / F.lit(float(16**digits))


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    """R-01, R-03, R-05: k rows of each group, those with the least draw. Each group's rows are cut down to k in every
    hash bucket first, so a hot group isn't sorted in one task."""
    rows = rows.withColumn("draw", draw(seed, F.col(key))).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(64)))
    for part in ([group, "bucket"], [group]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("draw", key))).filter(F.col("place") <= k)
    return rows.drop("draw", "bucket", "place")


def equal_quota(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """R-02: n rows in all, as many of each group."""
    groups = max(1, rows.select(group).distinct().count())
    return sample_per_group(rows, group, key, n // groups, seed)


def held_out(rows: DataFrame, used_ids: DataFrame, used_texts: DataFrame, key: str, text: Column, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """R-04: n rows whose id and normalised text aren't used yet, and the others."""
    free = rows.withColumn("text_key", text).join(used_ids.select(key), key, "left_anti").join(used_texts.select("text_key"), "text_key", "left_anti")
    chosen = free.withColumn("draw", draw(seed, F.col(key))).orderBy("draw", key).limit(n)
    return chosen.drop("draw"), free.join(chosen.select(key), key, "left_anti")


def hash_mod(key: Column, mod: int) -> Column:
    """R-06: the SHA-1 of a key, as a 160-bit number, modulo `mod`: a fold over its hexadecimal digits."""
    digits = F.transform(F.split(F.sha1(key.cast("binary")), ""), lambda c: F.conv(c, 16, 10).cast("long"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % mod)


def fold_of(seed: str, key: Column, k: int) -> Column:
    """R-07: a fold from 0 to k - 1."""
    return F.floor(draw(seed, key) * k).cast("int")


def weighted_choice(u: Column, table: list[tuple[str, float]]) -> Column:
    """R-08: the value at u of the inverse of the table's cumulative weights."""
    total = sum(w for _, w in table)
    out, run = None, 0.0
    for value, weight in table[:-1]:
        run += weight / total
        out = F.when(u < run, value) if out is None else out.when(u < run, value)
    return F.lit(table[-1][0]) if out is None else out.otherwise(table[-1][0])
