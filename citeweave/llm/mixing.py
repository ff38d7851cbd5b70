"""Mixing sources to target weights by Poisson replication.

Every document of a source gets a count drawn from a Poisson distribution whose mean is the source's target repetition
rate: the mixture's size times the source's target share, over what the source holds. The draw inverts the distribution
at a uniform number hashed from (seed, doc_id), so it depends on nothing else: not on partitions, order or retries.
Each document is exploded by its count and the copies are shuffled globally by a hash of (seed, doc_id, copy).

Defined cases: documents of a null source form a source of their own. Rows without a doc_id draw by a hash of their
other columns; rows that share a doc_id draw the same number. Texts aren't read. A source whose target weight is 0, or that weighs nothing, gives no copies. An empty table gives an empty
result. Columns are kept; copy and order columns are named copy and shuffle_key, with underscores before them if the
input has such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name

#: Sources up to this number are broadcast (a row of theirs has a bounded size); more are joined in a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 32


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array: up to where the rest is below a uniform number's resolution. In logs, so
    that a large rate doesn't underflow."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.lit(0.0).alias("ln"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        ln = F.when(k == 0, -rate).otherwise(acc["ln"] + F.log(rate) - F.log(F.greatest(k, F.lit(1)).cast("double")))
        total = acc["sum"] + F.exp(ln)
        return F.struct(ln.alias("ln"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(0), most), start, step, lambda a: a["cdf"])
    return F.when(rate > 0, cdf).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source: str, mass: Column, weights: dict[str, float] | None, power: float, epochs: float) -> DataFrame:
    """(source, rate): the target repetition rate of each source. Target shares are `weights`, or, where none are given,
    proportional to the source's mass to `power`. The mixture's mass is `epochs` times that of the input."""
    held = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(mass.cast("double")).alias("mass"))
    if weights is None:
        held = held.withColumn("weight", F.when(F.col("mass") > 0, F.pow("mass", F.lit(power))).otherwise(0.0))
    else:
        chosen = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        held = held.withColumn("weight", F.coalesce(F.try_element_at(chosen, F.col("mix_source").cast("string")), F.lit(0.0)).cast("double"))
    sums = held.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("mass") > 0) & (F.col("all_weight") > 0), F.lit(epochs) * F.col("all_mass") * F.col("weight") / F.col("all_weight") / F.col("mass")).otherwise(0.0)
    return held.crossJoin(F.broadcast(sums)).select("mix_source", rate.alias("rate"))  # sums is one row


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", mass: Column | None = None, weights: dict[str, float] | None = None,
    power: float = 0.5, epochs: float = 1.0, seed: str = "mix-1", shuffle: bool = True,
) -> DataFrame:
    """docs, each as often as drawn, in a global shuffle. mass: what a document weighs (default: 1)."""
    copy, order = free_name(docs, "copy"), free_name(docs, "shuffle_key")
    mass = F.lit(1.0) if mass is None else mass
    rates = source_rates(docs, source, mass, weights, power, epochs).withColumn("cdf", poisson_cdf(F.col("rate"))).select("mix_source", "cdf")
    drawn, salt = free_name(docs, "drawn"), free_name(docs, "mix_salt")
    others = F.concat(F.lit("-"), F.hex(F.xxhash64(*[c for c in docs.columns if c != doc_id], F.lit(0))))
    named = F.coalesce(F.col(doc_id).cast("string"), others)
    rows = docs.withColumn(drawn, uniform(seed, named))
    if rates.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col("mix_source")), "left")
    else:
        spread = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(doc_id, drawn), F.lit(SALTS)).cast("int"))
        rows = rows.join(spread, F.col(source).eqNullSafe(F.col("mix_source")) & (F.col(salt) == F.col("rate_salt")), "left").drop(salt, "rate_salt")
    count = F.size(F.filter("cdf", lambda c: c <= F.col(drawn)))
    copies = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    out = rows.withColumn(copy, F.explode(copies)).drop("cdf", "mix_source", drawn)
    text = F.concat_ws("|", F.lit(seed), F.lit("order"), named, F.col(copy).cast("string"))
    out = out.withColumn(order, F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))
    if not shuffle:
        return out
    # rows that share a doc_id share their place too: the partition they come from spreads them
    out = out.withColumn(drawn, F.spark_partition_id())
    return out.repartition(order, drawn).drop(drawn).sortWithinPartitions(order)


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, copy, shuffle_key) of the mixture of production: shares by the square root of a source's
    characters, as many characters as the input."""
    rows = docs.select("doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"))
    return mix_sources(rows, mass=F.col("chars"), power=0.5, epochs=1.0).select("doc_id", "source", "copy", "shuffle_key")


MIX_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(length(text), 0)::DOUBLE AS chars FROM documents),
held AS (SELECT source, sum(chars) AS mass, CASE WHEN sum(chars) > 0 THEN pow(sum(chars), 0.5) ELSE 0 END AS weight FROM d GROUP BY source),
rates AS (
  SELECT source, CASE WHEN mass > 0 THEN (SELECT sum(mass) FROM held) * weight / (SELECT sum(weight) FROM held) / mass ELSE 0 END AS rate FROM held),
steps AS (
  SELECT source, rate, k, CASE WHEN k = 0 THEN -rate ELSE -rate + k * ln(rate) - lgamma(k + 1) END AS ln_p
  FROM rates, (SELECT unnest(range(0, 400)) AS k) WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate) + 24)),
cdf AS (SELECT source, k, sum(exp(ln_p)) OVER (PARTITION BY source ORDER BY k) AS p FROM steps),
drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d),
counts AS (
  SELECT x.doc_id, x.source, x.u, count(c.k) AS n FROM drawn x LEFT JOIN cdf c ON x.source IS NOT DISTINCT FROM c.source AND c.p <= x.u
  GROUP BY x.doc_id, x.source, x.u),
copies AS (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM counts WHERE n > 0)
SELECT doc_id, source, copy::INTEGER AS copy,
       ('0x' || substr(md5('mix-1|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""
