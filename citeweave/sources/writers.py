"""Sinks (S-10 to S-17): JSON documents, packed cells, gold sets, packages, span recordings, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_documents(outputs: DataFrame, folder: str, doc: str = "doc_id", body: str = "json") -> None:
    """S-10: one indented UTF-8 JSON file per document. Written by tasks through Hadoop's file system API of the JVM is
    not open to Python workers, so this sink suits folders that all workers mount; at scale use write_dataset."""

    def put(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, f"{r[doc]}.json"), "w", encoding="utf-8", newline="\n") as f:
                f.write(json.dumps(json.loads(r[body]), ensure_ascii=False, indent=2))

    outputs.select(doc, body).foreachPartition(put)


def write_dataset(outputs: DataFrame, folder: str, body: str = "json") -> None:
    """S-10 at scale: a JSON lines dataset, one document in a line."""
    outputs.select(body).write.mode("overwrite").text(folder)


def packed_cells(spans: DataFrame, doc: str, parts: list[Column], order: str) -> DataFrame:
    """S-11, S-12: one cell per document: spans as comma-separated parts, | between, - if there are none."""
    cell = F.concat_ws(",", *[p.cast("string") for p in parts])
    rows = spans.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col(order).isNotNull(), F.struct(F.col(order), cell.alias("c"))))).alias("v"))
    return rows.select(doc, F.coalesce(F.nullif(F.array_join(F.transform("v", lambda x: x["c"]), "|"), F.lit("")), F.lit("-")).alias("cell"))


def write_gold_set(documents: DataFrame, gold: DataFrame, folder: str) -> None:
    """S-13: texts by document, gold labels and metadata."""
    documents.select("documento_id", "texto").write.mode("overwrite").parquet(f"{folder}/textos")
    gold.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{folder}/gabarito")
    documents.drop("texto").write.mode("overwrite").json(f"{folder}/meta")


def write_package(rows: DataFrame, ids: DataFrame, key: str, folder: str) -> None:
    """S-14: the rows of some ids."""
    rows.join(ids.select(key), key, "left_semi").write.mode("overwrite").parquet(folder)


def write_recording(spans: DataFrame, folder: str) -> DataFrame:
    """S-15: JSON lines, and a digest that doesn't depend on their order: the SHA-256 of the sorted lines' digests, of
    which there are 256 groups at most."""
    lines = spans.select(F.to_json(F.struct("*")).alias("value"))
    lines.write.mode("overwrite").text(folder)
    each = lines.select(F.sha2("value", 256).alias("h")).groupBy(F.left("h", F.lit(2)).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("g", "h"))).getField("h"), ""), 256).alias("sha256"))


def markdown(table: DataFrame, title: str, most: int = 200) -> str:
    """S-16: a report's table, of aggregates with at most `most` rows."""
    rows, names = table.limit(most).collect(), table.columns
    body = "\n".join("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)
    return f"## {title}\n\n| {' | '.join(names)} |\n|{'---|' * len(names)}\n{body}\n"


def request_key(*parts: Column) -> Column:
    """S-17: the key under which a request's answer is kept."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
