"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words and pads lines, as a SQL string. Spark SQL reads \f as the letter f.
BLANKS = "' \\t\\n\\u000b\\u000c\\r'"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: For texts held in Python as UTF-8 bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, where all run on one
    machine, gets a folder of its own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that stored() wrote and nothing deleted yet, in order.
_WRITTEN: list[str] = []


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df, written once as a table in the shared folder and read again: this cuts the lineage, and what reads it
    twice doesn't compute it twice. Lost executors cost no recomputation of what lies before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeweave/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_run(rows: DataFrame, joins_runs: bool = False) -> DataFrame:
    """rows (h1, h2 and others) that an aggregate or a join has dealt by (h1, h2), stored as a table that is bucketed and
    sorted by them. Buckets are what the shuffle dealt, so each is one file, and joins of such tables neither exchange
    nor sort them again: rows that join runs are computed with the order taken as known."""
    spark = rows.sparkSession
    name, n = f"run_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, as_sorted = f"{shared_dir(spark)}/citeweave/{name}", "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(as_sorted)
    spark.conf.set(as_sorted, "true" if joins_runs else before)
    try:
        rows.write.bucketBy(n, "h1", "h2").sortBy("h1", "h2").option("path", path).format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(as_sorted, before)
    _WRITTEN.append(path)
    out = spark.table(name)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if (name := folder.rsplit("/", 1)[-1]).startswith("run_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _WRITTEN[:] = [p for p in _WRITTEN if p != folder]


def _collect(spark: SparkSession) -> None:
    """Spark keeps the files of a shuffle until its driver finds that nothing refers to it: asks for that now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave, once all that reads them is stored too."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)
    if tables:
        _collect(tables[0].sparkSession)


def written() -> int:
    """A mark for keep_only: how many stored tables there are now."""
    return len(_WRITTEN)


def keep_only(result: DataFrame, mark: int) -> DataFrame:
    """Deletes all tables stored since the mark but result, which stored() gave: what a step left behind on its way."""
    for path in _WRITTEN[mark:]:
        if path != result.stored_at:
            _delete(result.sparkSession, path)
    _collect(result.sparkSession)
    return result


def drop_stored(spark: SparkSession) -> None:
    """Deletes all tables that stored() wrote; call it when no result that reads them is needed any more."""
    _delete(spark, f"{shared_dir(spark)}/citeweave")


#: What a Python worker keeps between tasks, by owner; kept by one owner at a time.
_KEPT: dict[str, object] = {}


def kept_by_worker(owner: str, make: Callable[[], object]) -> object:
    """make()'s object, kept for the next tasks of this worker that ask for the same owner. What other owners kept goes,
    so a worker that lives through many stages holds one such object at most."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]


def give_back() -> None:
    """Returns memory that Python, Arrow and the C library hold for later to the system: workers are used again for as
    long as the executor lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


class Lean:
    """A function for mapInPandas that sees at most `rows` rows at a time, whatever an Arrow batch holds, and whose
    worker gives memory back at its end. Unless it is the owner, what the worker kept for others goes first."""

    def __init__(self, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], rows: int = 2000, owner: str | None = None):
        self.run, self.rows, self.owner = run, rows, owner

    def _parts(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), self.rows):
                yield batch.iloc[at : at + self.rows].reset_index(drop=True)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if self.owner not in _KEPT:
            _KEPT.clear()
        try:
            yield from self.run(self._parts(batches))
        finally:
            give_back()


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A hot key holds at least a ten-thousandth of the rows, so there are at most this many.
MOST_HOT = 10_000


def hot_keys(counts: DataFrame, n: str, total: int) -> DataFrame:
    """Of (key columns, n), a row per key of a table of `total` rows: the hot keys with the number of parts (salts_) that
    they are split into, each of about the size that makes a key hot. At most MOST_HOT rows, so it can be broadcast."""
    least = max(64, -(-total // MOST_HOT))
    return counts.filter(F.col(n) >= least).withColumn("salts_", F.ceil(F.col(n) / least).cast("int")).drop(n)


def salted_join(rows: DataFrame, unique: DataFrame, on: list[str], hot: DataFrame, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """rows joined (inner, left or left_semi) with unique, which has each key once, in one shuffled merge join. A hot
    key's rows are dealt over its salts by their columns `by` (all, if not given) and their partition, and its row in
    unique is copied to each of them: no key meets a single task, and all copies together are at most twice MOST_HOT. The
    join is shuffled at every size, so that a small input shows the plan of a large one."""
    small = F.broadcast(hot)
    deal = F.pmod(F.xxhash64(*(by or rows.columns)) + F.spark_partition_id(), F.coalesce(F.col("salts_"), F.lit(1))).cast("int")
    dealt = rows.join(small, on, "left").withColumn("salt_", deal).drop("salts_")
    copies = unique.join(small, on, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts_"), F.lit(1)) - 1))).drop("salts_")
    return dealt.join(copies.hint("merge"), [*on, "salt_"], how).drop("salt_")


def least_hashed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose key has the least hash (ties by key), or all. Before they are ordered, rows are cut down to about
    2 n by their hash, so that what the partitions send stays in proportion to n."""
    total = rows.count()
    h = F.xxhash64(key)
    if total > 4 * n:
        rows = rows.filter(h < F.lit(-(2**63) + int(2**64 * (2 * n / total))))
    return rows.orderBy(h, key).limit(n)
