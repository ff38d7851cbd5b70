"""Line dedup over levelled sorted runs of line hashes.

A *run* is a table of (h1, h2, n_docs, last_doc), one row per line key, bucketed and sorted by the 128-bit hash of the
key, so that runs meet each other and a batch without an exchange. A store keeps runs in levels: each batch
merge-anti-joins the runs; the keys that no run holds become the batch's own run on level 0, and what the batch adds to
the counts of the others becomes rows of that run without a last_doc. When a level holds `fanout` runs they are
compacted into one run of the next level, counts of equal keys added up, so n batches leave O(fanout * log n) runs and
each hash is rewritten O(log n) times.

A line's key is the line without ASCII white space at both ends, with A-Z lower-cased. A key takes part if it has at
least `min_chars` code points. Keys found in at least `min_docs` documents lose all their lines except those of the
largest doc_id that holds the key: so batches go from the largest doc_ids to the smallest, and the first batch to bring
a key holds the document that keeps it. The runs then say how many documents hold a key and which one keeps it.

Defined cases: a null or empty text is one empty line and stays as it is. A null doc_id counts as smaller than any
other. Every row is a document of its own when documents are counted; where lines stay, rows with the largest doc_id all
keep them. Lines that a document repeats count once for it. Texts of any length are read whole. An empty table gives an
empty result. Columns of the input are kept, whatever their names; the counts are
named n_lines and n_dropped, with underscores before them if the input has such columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, ascii_lower, forget, free_name, hot_keys, salted_join, stored, stored_run

_LEAST = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.call_function("btrim", line, F.expr(BLANKS)))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _keys_of(text: Column, min_chars: int) -> Column:
    """The hashes of a text's distinct keys that take part."""
    keys = F.filter(F.transform(F.split(text, "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)
    return F.transform(F.array_distinct(keys), _hashes)


class RunStore:
    """Levelled runs, each a bucketed, sorted table in the shared folder."""

    def __init__(self, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch (unique by h1, h2) whose key no run holds yet: one merge anti join per run."""
        for held in self.runs():
            batch = batch.join(held.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (h1, h2, n_docs, last_doc), unique by key, and compacts the levels that are full. Returns the run
        of the batch: keys that no run held have a last_doc there, the others only add to counts."""
        if self.levels:
            whole = stored_run(batch)
            fresh = self.unseen(whole).select("h1", "h2", F.lit(True).alias("fresh"))
            batch = whole.join(fresh.hint("merge"), ["h1", "h2"], "left")
            batch = batch.select("h1", "h2", "n_docs", F.when(F.col("fresh"), F.col("last_doc")).alias("last_doc"))
            added = rows = stored_run(batch, joins_runs=True)
            forget(whole)
        else:
            added = rows = stored_run(batch)
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(rows)
            if len(self.levels[level]) < self.fanout:
                return added
            rows, old = stored_run(self._merged(self.levels[level])), self.levels[level]
            forget(*(run for run in old if run is not added))
            self.levels[level] = []
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several: counts are added up; a key has its last_doc in one of them at most. The runs are read as
        plain files: a union of bucketed scans isn't dealt as its parts are."""
        plain = [run.sparkSession.read.schema(run.schema).parquet(run.stored_at) for run in runs]
        return reduce(DataFrame.unionByName, plain).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def totals(self) -> DataFrame | None:
        """(h1, h2, n_docs, last_doc) of all keys."""
        return self._merged(self.runs()) if self.runs() else None


def _without(rows: DataFrame, gone: DataFrame, key: list[str], text: str, min_chars: int) -> DataFrame:
    """rows without the lines whose (key columns, h1, h2) gone holds, with the counts of lines."""
    drops, before, after = (free_name(rows, c) for c in ("gone_keys", "n_lines", "n_dropped"))
    kept = free_name(rows, "kept_lines")
    gone = gone.groupBy(*key).agg(F.collect_set(F.struct("h1", "h2")).alias(drops))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)

    def stays(line: Column) -> Column:
        k = line_key(line)
        return (F.char_length(k) < min_chars) | ~F.array_contains(F.col(drops), _hashes(k))

    joined = rows.join(gone, key, "left")
    joined = joined.withColumn(before, F.size(lines).cast("long"))
    joined = joined.withColumn(kept, F.when(F.col(drops).isNotNull(), F.filter(lines, stays)))
    joined = joined.withColumn(after, F.when(F.col(kept).isNotNull(), F.col(before) - F.size(kept)).otherwise(F.lit(0)).cast("long"))
    return joined.withColumn(text, F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text))).drop(kept, drops)


def drop_seen_lines(batch: DataFrame, store: RunStore, text: str = "text", min_chars: int = 20) -> DataFrame:
    """The incremental form: a batch loses the lines whose key an earlier batch holds, and its own new keys are added
    to the store. Within the batch nothing is dropped. The result is computed once, before the store changes."""
    key = free_name(batch, "row_key")
    rows = stored(batch.withColumn(key, F.expr("uuid()")))
    keys = rows.select(F.col(key), F.explode(_keys_of(F.col(text), min_chars)).alias("h")).select(key, "h.h1", "h.h2")
    counts = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
    run = store.add(counts.withColumn("last_doc", F.lit(0).cast("long")))
    seen, often = run.filter("last_doc is null").select("h1", "h2"), hot_keys(run.select("h1", "h2", "n_docs"), "n_docs", keys.count())
    return _without(rows, salted_join(keys, seen, ["h1", "h2"], often), [key], text, min_chars).drop(key)


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """docs with the text that stays, and n_lines and n_dropped. The documents arrive in `batches` batches, in ranges
    of doc_id from the largest to the smallest. What a row loses is gathered by its doc_id and its text's hash, so rows
    that share a doc_id, or have none, never meet."""
    own, of_text = free_name(docs, "own_doc"), free_name(docs, "own_text")
    named = docs.withColumn(own, F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST))).withColumn(of_text, F.xxhash64(F.col(text)))
    cuts = named.agg(F.percentile_approx(own, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = reduce(lambda a, b: a + b, [(F.col("doc") > c).cast("int") for c in cuts], F.lit(0))
    keys = named.select(F.col(own).alias("doc"), F.col(of_text).alias("of_text"), F.explode(_keys_of(F.col(text), min_chars)).alias("h"))
    keys = stored(keys.select("doc", "of_text", "h.h1", "h.h2", batch.alias("batch")), ["batch"])
    store = RunStore(fanout)
    for b in reversed(range(batches)):
        part = keys.filter(F.col("batch") == b)
        store.add(part.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc")))
    shared = stored(store.totals().filter(F.col("n_docs") >= min_docs))
    often = hot_keys(shared.select("h1", "h2", "n_docs"), "n_docs", keys.count())
    rows = keys.select("doc", "of_text", "h1", "h2")
    gone = salted_join(rows, shared.drop("n_docs"), ["h1", "h2"], often).filter(F.col("doc") < F.col("last_doc"))
    gone = gone.select(F.col("doc").alias(own), F.col("of_text").alias(of_text), "h1", "h2")
    return _without(named, gone, [own, of_text], text, min_chars).drop(own, of_text)


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per document: n_lines, n_dropped and the SHA-256 of the text that stays."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
