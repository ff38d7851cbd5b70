"""Sources (S-01 to S-09): the corpus in SQLite, documents, gold labels, span recordings and predictions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

RECORDS = "ord long, id string, natureza string, tribunal string, ano int, relator string, texto string"
GOLD = "nivel int, documento_id string, citacao_id string, inicio int, fim int, trecho string, tipo string, classificacao string, id_canonico string"


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    """Reads a table by ranges of its rowid, so that several tasks can read a large one. `ord` is the rowid's place in
    the scan: ties between records are decided by it."""

    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("dbtable", "documentos")
        self.parts = int(options.get("numpartitions", "1"))

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[RowRange]:
        con = self._connect()
        try:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        finally:
            con.close()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        con = self._connect()
        try:
            sql = f'SELECT rowid, id, natureza, tribunal, ano, relator, texto FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid'
            yield from con.execute(sql, (partition.low, partition.high))
        finally:
            con.close()


class SQLiteRecords(DataSource):
    """spark.read.format("sqlite_records").option("path", ...).option("dbtable", "documentos").load()"""

    @classmethod
    def name(cls) -> str:
        return "sqlite_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> SQLiteReader:
        return SQLiteReader(self.options)


def read_records(spark: SparkSession, path: str, nature: str | None = None, partitions: int = 1) -> DataFrame:
    """S-01, S-02: the frozen corpus; at scale it is staged as Parquet once (stage_records) and filtered there."""
    spark.dataSource.register(SQLiteRecords)
    rows = spark.read.format("sqlite_records").option("path", path).option("numPartitions", partitions).load()
    return rows.filter(F.col("natureza") == nature) if nature else rows


def stage_records(spark: SparkSession, path: str, out: str) -> DataFrame:
    read_records(spark, path).write.mode("overwrite").partitionBy("natureza").parquet(out)
    return spark.read.parquet(out)


@F.pandas_udf(StringType())
def _windows_1252(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c).decode("cp1252", "replace") for c in content], dtype=object)


def decoded(content: Column) -> Column:
    """S-04: UTF-8 as it is, line ends and byte order mark kept."""
    return F.decode(content, "UTF-8")


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """S-03, S-04: (name, text, recoded) of a folder's files. Files that aren't UTF-8 are read as Windows-1252 by a
    Python function that sees those files only. An empty folder is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = files.select(name.alias("name"), "content", F.expr("is_valid_utf8(cast(content as string))").alias("utf8"))
    good = rows.filter("utf8").select("name", F.col("content").cast("string").alias("text"), F.lit(False).alias("recoded"))
    other = rows.filter("not utf8").select("name", _windows_1252("content").alias("text"), F.lit(True).alias("recoded"))
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return good.unionByName(other)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """S-05: gold labels from CSV; quotes may hold line feeds, and the file may begin with a byte order mark."""
    names = [c.split()[0] for c in GOLD.split(", ")]
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    kinds = dict(c.split() for c in GOLD.split(", "))
    return rows.select(*[F.col(c).cast(kinds[c]) for c in names if c in rows.columns])


def gold_by_document(gold: DataFrame) -> DataFrame:
    return gold.groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("inicio", "fim", "tipo", "classificacao", "id_canonico"))).alias("spans"))


def read_recordings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S-06: (set, id, seconds, spans) of JSON lines files whose first line is a description. Spans come with 3, 4 or 6
    elements: (start, end, form or label[, conf | digits, conf, ...]). Of documents in several files the last counts."""
    element = "struct<conjunto:string,id:string,segundos:double,spans:array<array<string>>>"
    out = None
    for k, path in enumerate(paths):
        rows = spark.read.text(path).filter(~F.col("value").rlike(r'^\s*\{\s*"meta"')).select(F.from_json("value", element).alias("r"), F.lit(k).alias("file"))
        out = rows if out is None else out.unionByName(rows)
    rows = out.filter("r.id is not null").select("r.*", "file")
    last = Window.partitionBy("conjunto", "id").orderBy(F.desc("file"))
    rows = rows.withColumn("place", F.row_number().over(last)).filter("place = 1")

    def span(s: Column) -> Column:
        conf = F.when(F.size(s) == 4, F.get(s, F.lit(3))).when(F.size(s) == 6, F.get(s, F.lit(5)))
        return F.struct(F.get(s, F.lit(0)).cast("int").alias("start"), F.get(s, F.lit(1)).cast("int").alias("end"), F.get(s, F.lit(2)).alias("kind"), conf.try_cast("double").alias("conf"))

    return rows.select(F.col("conjunto").alias("set"), "id", F.col("segundos").alias("seconds"), F.transform("spans", span).alias("spans"))


def read_predictions(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """S-07: one array of citations per document; a document without a file has an empty one."""
    kind = "documento_id string, citacoes array<struct<id:string,inicio:int,fim:int,trecho:string,tipo:string,classificacao:string,resolucao:struct<fonte:string,id_canonico:string>,confianca:double>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(folder)
    rows = documents.select(F.col("name").alias("documento_id")).join(rows, "documento_id", "left")
    return rows.withColumn("citacoes", F.coalesce("citacoes", F.from_json(F.lit("[]"), kind.split("citacoes ")[1])))


def read_shards(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S-08: columns of sharded Parquet files."""
    return spark.read.parquet(path).select(*columns)


def read_banks(spark: SparkSession, paths: list[str], bank: str) -> DataFrame:
    """S-09: a phrase bank's entries over several files."""
    out = None
    for k, path in enumerate(paths):
        rows = spark.read.option("multiLine", True).json(path)
        rows = rows.select(F.explode(bank).alias("entry"), F.lit(k).alias("file"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
