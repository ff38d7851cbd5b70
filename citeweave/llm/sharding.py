"""Sharding by histogram sort: shards of near equal bytes, cut from one order over all rows.

Rows are ordered by a 128-bit key, (hash of the text, hash of the doc_id and the row's number): copies of a text are
neighbours, and no two rows share a key, even if they are equal or have no doc_id. Splitters are found by counting: each round counts the exact bytes
of the rows below every candidate boundary of the key ranges that still hold an unmet splitter, over all partitions,
and refines those ranges `digit` bits further, until each splitter's boundary is within the tolerance of its target, or
no row is left to cut between. A round sends at most (shards - 1) * 2^digit sums to the driver. Then rows are exchanged once.

All of it is DataFrame functions. Law: `bytes`, sizes near equal: each boundary lies within `tolerance` of an ideal
shard's bytes, or as near as single keys allow.

Defined cases: a null text weighs `overhead` bytes and has CRC 0; a null doc_id hashes as such. Repeated rows are cut
like others. Texts of any length are read whole; a text heavier than a shard makes its shard as heavy as itself. With no rows there is nothing to cut and the result is empty. More shards than rows leave shards
empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import free_name, stored

_SIGN = -(2**63)
#: A splitter: rows with (h1, h2), as signed longs, below it belong to its left.
Splitter = tuple[int, int]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", overhead: int = 8, number: bool = False) -> DataFrame:
    """(key columns, size, text_crc32) of every row, with all of its columns but the text. With `number` the key holds
    the row's number too: store the result, since numbers depend on how the input is read."""
    rest = [F.col(c) for c in docs.columns if c != text]
    data = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    return docs.select(
        *rest,
        F.xxhash64(text).alias(free_name(docs, "h1")),
        F.xxhash64(F.lit(1), doc_id, *[F.monotonically_increasing_id()] * number).alias(free_name(docs, "h2")),
        (F.octet_length(data) + overhead).cast("long").alias(free_name(docs, "size")),
        F.crc32(data).cast("long").alias(free_name(docs, "text_crc32")),
    )


def _digit(h1: Column, h2: Column, at: int, bits: int) -> Column:
    """Bits at to at + bits of the 128-bit key whose halves, with the sign flipped, are unsigned."""
    h, shift = (h1, 64 - bits - at) if at < 64 else (h2, 128 - bits - at)
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(_SIGN)), shift).bitwiseAND(F.lit(2**bits - 1))


def _key_of(prefix: int, at: int) -> Splitter:
    """The least key whose first `at` bits are prefix."""
    whole = prefix << (128 - at)
    return (whole >> 64) + _SIGN, (whole & (2**64 - 1)) + _SIGN


def find_splitters(rows: DataFrame, shards: int, h1: str = "h1", h2: str = "h2", size: str = "size", tolerance: float = 0.001, digit: int = 10) -> tuple[list[Splitter | None], int]:
    """The shards - 1 splitters in order (None: all rows lie left of it) and the number of rounds."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    if not total or shards < 2:
        return [None] * (shards - 1), 0
    targets = {i: total * (i + 1) / shards for i in range(shards - 1)}
    slack, found, best = tolerance * total / shards, {}, {}
    open_at: dict[int, tuple[int, float]] = {i: (0, 0) for i in targets}  # splitter -> (prefix, bytes below it)
    at = 0
    rounds = 0
    while open_at and at < 128:
        bits, rounds = min(digit, 64 - at % 64), rounds + 1  # no digit lies in both halves
        here = F.lit(0).cast("long")
        if at:
            # the ordinal of the open range that a row lies in, or null
            ranges = sorted({p for p, _ in open_at.values()})
            here = F.lit(None).cast("long")
            for k, p in enumerate(ranges):
                (a1, a2), top = _key_of(p, at), p + 1
                low = (F.col(h1) > a1) | ((F.col(h1) == a1) & (F.col(h2) >= a2))
                if top < 2**at:
                    b1, b2 = _key_of(top, at)
                    low &= (F.col(h1) < b1) | ((F.col(h1) == b1) & (F.col(h2) < b2))
                here = F.when(low, F.lit(k).cast("long")).otherwise(here)
        else:
            ranges = [0]
        counted = rows.select(here.alias("k"), _digit(F.col(h1), F.col(h2), at, bits).alias("d"), F.col(size).alias("b"))
        counted = counted.filter("k is not null").groupBy("k", "d").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        sums: dict[int, dict[int, tuple[int, int]]] = {}
        for k, d, b, n in counted:
            sums.setdefault(ranges[k], {})[d] = (b, n)
        at += bits
        for i, (prefix, below) in list(open_at.items()):
            run, target, n = below, targets[i], 0
            for d in sorted(sums.get(prefix, {})):
                (b, n), edge = sums[prefix][d], (prefix << bits) + d
                for cut, value in ((edge, run), (edge + 1, run + b)):
                    if i not in best or abs(value - target) < best[i][0]:
                        best[i] = (abs(value - target), cut, at)
                if run + b >= target:
                    open_at[i] = (edge, run)
                    break
                run += b
            if best[i][0] <= slack or at >= 128 or n == 1:  # a single row can't be cut
                found[i] = best[i][1:]
                del open_at[i]
    return [None if found[i][0] >= 2 ** found[i][1] else _key_of(*found[i]) for i in range(shards - 1)], rounds


def shard_of(h1: Column, h2: Column, splitters: list[Splitter | None]) -> Column:
    """The number of splitters at or below a key."""
    out = F.lit(0)
    for s in splitters:
        if s is not None:
            out = out + ((h1 > F.lit(s[0])) | ((h1 == F.lit(s[0])) & (h2 >= F.lit(s[1])))).cast("int")
    return out


def assign_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.001, rows_per_bucket: int = 500_000) -> DataFrame:
    """docs without the text, with size, text_crc32, law, shard, slot and grown_shard (names that docs has already get
    underscores before them).

    The one exchange of rows is on (shard, bucket), a bucket being a hash of the key: a shard is never one task. A slot
    is the place in the bucket plus the sizes of the shard's buckets before it."""
    names = {c: free_name(docs, c) for c in ("h1", "h2", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "bucket", "before")}
    rows = stored(keyed(docs, doc_id, text, number=True))
    splitters, _ = find_splitters(rows, shards, names["h1"], names["h2"], names["size"], tolerance)
    shard, bucket, before, slot = (names[c] for c in ("shard", "bucket", "before", "slot"))
    n_buckets = max(16, -(-rows.count() // (shards * rows_per_bucket)))
    dealt = rows.withColumn(shard, shard_of(F.col(names["h1"]), F.col(names["h2"]), splitters).cast("int"))
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(names["h2"], names["h1"]), F.lit(n_buckets)).cast("int"))
    sums = dealt.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(before))
    within = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(before).over(within), F.lit(0)))  # at most shards * buckets rows
    place = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(names["h1"], names["h2"]))
    out = dealt.withColumn(slot, place).join(sums, [shard, bucket])
    kept = [c for c in docs.columns if c != text]
    return out.select(
        *kept, names["size"], names["text_crc32"], F.lit("bytes").alias(names["law"]), shard,
        (F.col(slot) - 1 + F.col(before)).cast("long").alias(slot), F.lit(None).cast("int").alias(names["grown_shard"]),
    )


def exchange(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.001, sub: int = 8) -> DataFrame:
    """docs, whole texts included, in the order of the shards, exchanged once: sub partitions for each shard, sorted by
    key within; rows that share text and doc_id stay together. For writing shards as folders, add partitionBy("shard") to the writer."""
    names = [free_name(docs, c) for c in ("h1", "h2", "shard")]
    full = docs.withColumn(names[0], F.xxhash64(text)).withColumn(names[1], F.xxhash64(F.lit(1), doc_id))
    size = keyed(docs, doc_id, text)
    size = stored(size.select(*(size.columns[-4:])))
    splitters, _ = find_splitters(size, shards, *size.columns[:3], tolerance=tolerance)
    full = full.withColumn(names[2], shard_of(F.col(names[0]), F.col(names[1]), splitters).cast("int"))
    part = F.pmod(F.col(names[1]), F.lit(sub))
    return full.repartition(shards * sub, names[2], part).sortWithinPartitions(names[2], names[0], names[1]).drop(*names[:2])
