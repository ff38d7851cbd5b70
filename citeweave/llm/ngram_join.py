"""Jaccard self-join of documents on word n-grams by prefix filtering, and its components.

A document's set: its distinct n-word shingles, lower-cased, as 64-bit hashes; with fewer words than n, the whole
sequence as one; without words, empty and linked with nothing. Two sets link when 100 * intersection >= percent * union.

1. Every text is read once for its set's size, its 128-bit hash and a histogram of its shingles; documents with the same
   set become one *class*, named by its smallest doc_id, and are never compared with each other.
2. Shingles are ordered rare first, by a count over all documents in 2^18 cells (a fixed size, so it can be broadcast)
   and then by hash. If two sets link, their prefixes, the rarest n - ceil(percent * n) + 1 shingles, share a shingle.
3. Classes that share a prefix shingle are candidates, if length filter and positional filter allow. First each class
   meets only the shingle's *pivot*, its most central class; each pair is verified once. Most groups of near copies are
   then connected already, with pairs in proportion to their members.
4. Exactly what is left is looked at next: shingles whose classes lie in different components. Pairs across components
   that pass the length, positional and suffix filter (a lower bound on the sets' difference from counts of shingles in
   fixed ranges) are verified once too. No link between classes of different components is lost.
5. Components by alternating large-star and small-star steps, each a stored table.

Shingles and classes that hold at least a ten-thousandth of the rows (so at most 10,000 of them) are split by salt, so a
hot one meets no single task. In step 4 the classes of a shingle meet within a length class only (two sets that link lie
in the same or in neighbouring ones), and a large meeting is split by salt too; its work is still quadratic in the
classes of one shingle and length that step 3 left in different components.

Defined cases: a null text has no words. Rows without a doc_id get no component (null) and link with nothing. Rows that
share a doc_id are judged each by its text. Texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ._common import LOWER_BYTES, Lean, forget, free_name, hot_keys, salted_join, stored

CELL_BITS = 18
BINS = 16
_CHUNKS = 64
_NEEDED_BITS = 20
#: A token that no more classes hold has all of them meet at once.
_MEET = 512
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Shingler:
    """The sorted distinct shingle hashes of texts. Hashes of words are kept, up to a bounded number."""

    def __init__(self, words: int, most: int = 400_000):
        self.n, self.most, self.known = words, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
        if not words:
            return np.empty(0, _U)
        known = self.known
        try:
            ids = [known[w] for w in words]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = [known[w] for w in words]
        a = np.array(ids, dtype=_U)
        n = min(self.n, len(a))
        out = a[: len(a) - n + 1] + _U(n)
        for i in range(1, n):
            out = _mix(out) + a[i : len(a) - n + 1 + i]
        return np.unique(_mix(out))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def signature(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in ranges of their low bits, 8 to 16 in a range on average, at most 255 in a byte."""
    bins = max(16, 1 << max(0, (len(s) - 1) // 16).bit_length())
    return np.minimum(np.bincount((s & _U(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """What two sets differ in at least, from their signatures: the finer one is folded to the ranges of the other.
    Ranges that reach 255 count for no more than is sure."""
    a, b = sorted((np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)), key=len)
    if len(a) < len(b):
        if b.max(initial=0) >= 255:
            return 0
        b = np.minimum(b.reshape(-1, len(a)).sum(0), 255)
    return int(np.abs(a - b).sum())


@F.pandas_udf(IntegerType())
def _differ(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([least_difference(a, b) for a, b in zip(x, y, strict=True)], dtype="int32")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _digest(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: of a document (doc_id, n, s1, s2, bins), and of a chunk of the partition's shingle counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, cells = Shingler(words), np.zeros(2**CELL_BITS, np.int64)
        for batch in batches:
            rows, sets = [], []
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle(t)
                sets.append(s)
                rows.append((i, len(s), *_set_hash(s), np.bincount((s & _U(BINS - 1)).astype(np.int64), minlength=BINS).astype(np.int32), signature(s)))
            cells += np.bincount((np.concatenate(sets) >> _U(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)) if sets else 0
            out = pd.DataFrame(rows, columns=["doc_id", "n", "s1", "s2", "bins", "sig"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(chunk=pd.array([pd.NA] * len(out), "Int32"), counts=None)
        part = np.split(cells, _CHUNKS)
        none = [None] * _CHUNKS
        yield pd.DataFrame(
            {"doc_id": pd.array(none, "Int64"), "n": pd.array(none, "Int64"), "s1": pd.array(none, "Int64"), "s2": pd.array(none, "Int64"),
             "bins": none, "sig": none, "chunk": pd.array(range(_CHUNKS), "Int32"), "counts": [p.tobytes() for p in part]}
        )

    return docs.mapInPandas(Lean(run), "doc_id long, n long, s1 long, s2 long, bins array<int>, sig binary, chunk int, counts binary")


def _cells(digest: DataFrame) -> np.ndarray:
    """The counts of all partitions, added up in two levels."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(c, np.int64) for c in rows["counts"]), np.zeros(2**CELL_BITS // _CHUNKS, np.int64))
        return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "counts": [total.tobytes()]})

    parts = digest.filter("chunk is not null").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("part"))
    parts = parts.groupBy("chunk", "part").applyInPandas(add, "chunk int, counts binary")
    rows = parts.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()  # 64 rows, 2 MB in all
    out = np.zeros(2**CELL_BITS, np.int64)
    for chunk, counts in rows:
        size = len(out) // _CHUNKS
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(counts, np.int64)
    return out


def _postings(docs: DataFrame, words: int, percent: int, cells: np.ndarray) -> DataFrame:
    """Rows of two kinds, 16 bytes for each prefix shingle: (p, s1), p being 48 bits of the shingle, whether its cell is
    hot (one bit) and its place in the set's order (15 bits, at most; a smaller place only weakens the filter); and
    (null, s1, rank) for each set: rank is small for sets whose shingles are frequent. Shingles that share 48 bits, or
    sets that share s1, are candidates too many, never too few. A set that a partition holds again is left out there, as
    its class is the same."""
    shared = docs.sparkSession.sparkContext.broadcast((cells, max(1000, int(cells.sum()) // 10_000)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, (counts, hot), seen = Shingler(words), shared.value, set()
        for batch in batches:
            packed, owners, ranks = [], [], []
            for t in batch["text"]:
                s = shingle(t)
                if not len(s) or (h := _set_hash(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(h)
                df = counts[(s >> _U(64 - CELL_BITS)).astype(np.int64)]
                k = prefix_length(len(s), percent)
                order = np.lexsort((s, df))[:k]
                place = np.minimum(np.arange(k), 2**15 - 1).astype(_U) | ((df[order] >= hot).astype(_U) << _U(15))
                packed.append((s[order] & ~_U(0xFFFF)) | place)
                owners.append(np.full(k, h[0], np.int64))
                ranks.append((h[0], -int(df.mean() * 16)))
            if packed:
                yield pd.DataFrame({"p": np.concatenate(packed).view(np.int64), "s1": np.concatenate(owners)}).assign(rank=pd.array([pd.NA], "Int64").repeat(sum(map(len, packed))))
                n = len(ranks)
                yield pd.DataFrame({"p": pd.array([pd.NA], "Int64").repeat(n), "s1": [r[0] for r in ranks], "rank": pd.array([r[1] for r in ranks], "Int64")})

    return docs.filter("doc_id is not null").select("text").mapInPandas(Lean(run), "p long, s1 long, rank long")


def _shared_postings(postings: DataFrame) -> DataFrame:
    """(token, pos, s1) of the shingles that different sets have in their prefixes. The postings of cold shingles are
    dealt once, by shingle: what they are summed up to and what that is joined with is the same exchange. Hot ones are
    summed up before they move and joined with salts."""
    cut = F.shiftright("p", 16).alias("token"), F.col("p").bitwiseAND(F.lit(2**15 - 1)).cast("int").alias("pos"), "s1"
    is_hot = F.col("p").bitwiseAND(F.lit(2**15)) != 0
    rows = postings.filter("p is not null")

    def sums(part: DataFrame) -> DataFrame:
        return part.groupBy("token").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("token", "n")

    cold = rows.filter(~is_hot).select(*cut).repartition("token")
    hot = rows.filter(is_hot).select(*cut)
    shared = stored(sums(hot))
    split = salted_join(hot, shared.select("token"), ["token"], hot_keys(shared, "n", hot.count()))
    return cold.join(sums(cold).select("token").hint("merge"), "token").unionByName(split)


def _may_link(n1: Column, n2: Column, pos1: Column, pos2: Column, percent: int) -> Column:
    """Length filter, and positional filter as if the shingle were the first that both share."""
    least = F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (1 + F.least(n1 - pos1 - 1, n2 - pos2 - 1) >= least)


def _suffix_allows(n1: Column, n2: Column, bins1: Column, bins2: Column, percent: int) -> Column:
    """Sets that link differ in at most n1 + n2 - 2 * overlap shingles; counts in fixed ranges bound that from below."""
    most = n1 + n2 - 2 * F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))
    differ = F.aggregate(F.zip_with(bins1, bins2, lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    return differ <= most


def _busy(pairs: DataFrame) -> DataFrame:
    """The hot classes among those of pairs (class_id, salts_): a pivot is in as many pairs as its group has members."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id"))
    return stored(hot_keys(ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")), "n", 2 * pairs.count()))


def _with_ends(pairs: DataFrame, of_class: DataFrame, busy: DataFrame) -> DataFrame:
    """pairs with the columns c of of_class (class_id, c ...) for either end, as c_a and c_b."""
    for end in ("a", "b"):
        named = of_class.select(F.col("class_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in of_class.columns if c != "class_id"])
        pairs = salted_join(pairs, named, [end], busy.withColumnRenamed("class_id", end), by=["a", "b"])
    return pairs


def _plausible(pairs: DataFrame, classes: DataFrame, busy: DataFrame, percent: int) -> DataFrame:
    """The suffix filter: the pairs whose signatures allow as many shingles in common as a link needs."""
    rows = _with_ends(pairs, classes.select("class_id", "n", "sig"), busy)
    n = F.col("n_a") + F.col("n_b")
    most = n - 2 * F.ceil(F.lit(percent) * n / F.lit(100 + percent))
    return rows.withColumn("differ", _differ("sig_a", "sig_b")).filter(F.col("differ") <= most).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link. Only texts of classes in a pair are read into sets again: which ones these
    are is sent around as a fixed number of hash cells, so no text is shuffled; the few sets of others meet no pair."""
    busy = _busy(pairs)
    pairs = near = stored(_plausible(pairs, classes, busy, percent))
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(2**_NEEDED_BITS)).cast("int")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = docs.withColumn("cell", cell).join(F.broadcast(needed.select(cell.alias("cell")).distinct()), "cell", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [shingle(t) for t in batch["text"]]
            out = pd.DataFrame([_set_hash(s) for s in sets], columns=["s1", "s2"])
            yield out.assign(class_id=batch["doc_id"].to_numpy(), shingles=[s.view(np.int64) for s in sets])

    sets = kept = stored(texts.select("doc_id", "text").mapInPandas(Lean(run), "s1 long, s2 long, class_id long, shingles array<long>"))
    if not sets.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # rows share a doc_id: of these only the text that the class is of
        own = classes.select("s1", "s2", "class_id")
        sets = sets.join(own, ["s1", "s2", "class_id"], "left_semi").dropDuplicates(["s1", "s2", "class_id"])
    both = _with_ends(pairs, sets.select("class_id", "shingles"), busy)
    both = both.withColumn("common", F.size(F.array_intersect("shingles_a", "shingles_b")))
    linked = both.filter(100 * F.col("common") >= percent * (F.size("shingles_a") + F.size("shingles_b") - F.col("common")))
    linked = stored(linked.select("a", "b").distinct())
    forget(kept, near, busy)
    return linked


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its smallest node. Rounds go on until
    the edges no longer change, O(log n) of them for alternating stars."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64(F.lit(1), "a", "b") % 2**31)).first())

    def hot(e: DataFrame) -> DataFrame:
        return hot_keys(e.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "n", before[0])

    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # a star's centre has as many edges as its component has nodes
        above = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = stored(salted_join(above, least, ["a"], hot(above)).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, ["a"], hot(large)).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.filter("a <> b").distinct())
        if (now := state(edges)) == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that share a token, lie in different components and pass all filters. Of a token that
    `m` classes hold, m being small, all meet; those of other tokens meet by length class and in parts."""
    x, y = rest.filter(F.col("m") <= _MEET).alias("x"), rest.filter(F.col("m") <= _MEET).alias("y")
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.class_id") > F.col("y.class_id")) & _cross_filters(percent)
    pairs = x.join(y, meets).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"))
    return pairs.unionByName(_across_by_length(rest.filter(F.col("m") > _MEET).drop("m"), percent)).distinct()


def _cross_filters(percent: int) -> Column:
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    may = _may_link(x("n"), y("n"), x("pos"), y("pos"), percent)
    return (x("component") != y("component")) & may & _suffix_allows(x("n"), y("n"), x("bins"), y("bins"), percent)


def _across_by_length(rest: DataFrame, percent: int) -> DataFrame:
    """The same for tokens that many classes hold. A class meets those of its own length class and of the one above, m
    classes in about sqrt(m / 256) parts."""
    step = F.lit(100 / percent)
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(step) + 1e-9) if percent < 100 else F.col("n")
    rest = stored(rest.withColumn("size", size.cast("long")))
    held = stored(rest.groupBy("token", "size").agg(F.count(F.lit(1)).alias("m")))
    parts = held.filter("m > 256").select("token", "size", F.ceil(F.sqrt(F.col("m") / 256)).cast("int").alias("parts"))
    if parts.isEmpty():
        rest = rest.withColumns({"parts": F.lit(1), "parts_below": F.lit(1)})
    else:
        below = parts.select("token", (F.col("size") + 1).alias("size"), F.col("parts").alias("parts_below"))
        rest = salted_join(rest, parts.join(below, ["token", "size"], "full"), ["token", "size"], hot_keys(held, "m", rest.count()), "left")
        rest = rest.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "parts_below")})
    x = rest.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    # y goes to the parts of its own length class and of the one below
    to = F.array(F.struct(F.col("size").alias("s"), F.col("parts").alias("k")), F.struct((F.col("size") - 1).alias("s"), F.col("parts_below").alias("k")))
    y = rest.withColumn("to", F.explode(to)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("to.k") - 1)))
    x, y = x.alias("x"), y.alias("y")
    meets = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.size") == F.col("y.to.s")) & (F.col("x.part") == F.col("y.part"))
        & ((F.col("x.size") < F.col("y.size")) | (F.col("x.class_id") > F.col("y.class_id"))) & _cross_filters(percent)
    )
    return x.join(y, meets).select(F.greatest("x.class_id", "y.class_id").alias("a"), F.least("x.class_id", "y.class_id").alias("b"))


def link_classes(docs: DataFrame, words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, text): the digest (doc_id, n, s1, s2) of every row, the classes (s1, s2, class_id, n_docs) and
    (node, component) of all classes that are linked."""
    digest = stored(_digest(docs, words))
    postings = stored(_postings(docs, words, percent, _cells(digest)))
    rows = digest.filter("chunk is null").select("doc_id", "n", "s1", "s2", "bins", "sig")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("sig").alias("sig")
    )
    ranks = postings.filter("p is null").groupBy("s1").agg(F.min("rank").alias("rank"))
    classes = stored(classes.join(ranks.hint("merge"), "s1"))
    live = _shared_postings(postings).join(classes.select("s1", "class_id", "n", "rank").hint("merge"), "s1").drop("s1")
    live = stored(live.groupBy("token", "class_id").agg(F.min("pos").alias("pos"), *[F.first(c).alias(c) for c in ("n", "rank")]))
    forget(postings)
    n_live = live.count()
    pivots = stored(live.groupBy("token").agg(F.min(F.struct("rank", "class_id", "n", "pos")).alias("p"), F.count(F.lit(1)).alias("held")))
    often = hot_keys(pivots.select("token", "held"), "held", n_live)
    star = salted_join(live, pivots.drop("held"), ["token"], often).filter(
        (F.col("class_id") != F.col("p.class_id")) & _may_link(F.col("n"), F.col("p.n"), F.col("pos"), F.col("p.pos"), percent)
    )
    star = stored(star.select(F.greatest("class_id", "p.class_id").alias("a"), F.least("class_id", "p.class_id").alias("b")).distinct())
    links = _verified(star, docs, classes, words, percent)
    # what the pivots haven't connected
    groups = stored(components(links))
    bare = live
    live = live.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    live = stored(live)
    forget(bare)
    split = live.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi")
    rest = salted_join(live.drop("rank"), stored(split.select("token", "m")), ["token"], often)
    rest = stored(rest.join(classes.select("class_id", "bins").hint("merge"), "class_id"))
    pairs = _across(rest, percent)
    pairs = stored(pairs.join(star, ["a", "b"], "left_anti"))
    more = _verified(pairs, docs, classes, words, percent)
    forget(live, rest, star, pairs, pivots)
    rows, classes = rows.select("doc_id", "n", "s1", "s2"), classes.drop("bins", "sig", "rank", "n")
    if more.isEmpty():
        return rows, classes, groups
    # links between components: components of the graph whose nodes they are
    name = groups.select(F.col("node").alias("x"), F.col("component").alias("c"))
    for end in ("a", "b"):
        more = more.join(name, F.col(end) == F.col("x"), "left").withColumn(end, F.coalesce("c", end)).drop("x", "c")
    joined = components(more).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = groups.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = joined.join(groups.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return rows, classes, moved.unionByName(alone)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, classes, groups = link_classes(docs, words, percent)
    named = classes.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = stored(named.select("s1", "s2", F.coalesce("component", "class_id").alias("component_id"), "n_docs"))
    often = hot_keys(named.select("s1", "s2", "n_docs"), "n_docs", rows.count())
    linked = salted_join(rows.filter("n > 0 and doc_id is not null"), named.drop("n_docs"), ["s1", "s2"], often)
    alone = rows.filter("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = linked.unionByName(alone.select(*linked.columns))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest doc_id stays. Of rows that share
    a doc_id one stays. Rows without a doc_id stay."""
    found = similar_documents(docs, doc_id, text, words, percent)
    gone, mark = free_name(docs, "gone_id"), free_name(docs, "row_of_id")
    found = stored(found.filter("doc_id is not null"))
    lose = found.groupBy("doc_id").agg(F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias("lost"), F.count(F.lit(1)).alias("n"))
    lose = stored(lose.filter("lost = 1 or n > 1").select(F.col("doc_id").alias(gone), F.col("lost").alias(mark)))
    same = F.col(doc_id).cast("long") == F.col(gone)
    if lose.filter(F.col(mark) == 0).isEmpty():
        return docs.join(lose, same, "left_anti")
    rows = docs.join(lose, same, "left")
    again = rows.filter(F.col(mark) == 0).dropDuplicates([gone])
    return rows.filter(F.col(gone).isNull()).unionByName(again).drop(gone, mark)
