"""Maximum inner product search by anisotropic product quantisation, four-bit table scans and exact reranking.

Quantiser: vectors are cut into blocks of two dimensions, each coded by one of 16 codewords (four bits). The codebooks
minimise a score-aware loss: the error parallel to the vector weighs eta times the error across it, since only the
former changes the inner products that are large. Codes are found by coordinate descent over the blocks, codewords by
solving each block's weighted least squares. Codebooks are fitted on at most `sample` vectors (those with the least hash
of their id), a documented bound; every vector is indexed.

All query blocks meet all index blocks, so the work grows with the product of their numbers; there is no coarse
partitioning that would leave vectors out.

Search: all vectors lie in packed blocks of about `block_rows`; queries in blocks of `query_rows`. Each pair of blocks
builds the queries' tables (16 products per dimension pair; two tables are merged so that one byte reads eight bits),
scans the codes, takes the `rerank` best different vectors for each query and computes their inner products exactly, in
double precision. Reranking goes on with every other vector that can still reach the k-th exact score: an inner product
is at most the coded score plus the query's norm times that of the vector's residual, which the index stores. Where many
vectors are left, as in a group of near copies, one float32 matrix product with its rounding bound narrows them down
first. So each pair of blocks gives the k best for a query, and the k best of these are the result: that of brute force.

Vectors that are equal bit by bit are scanned once for a block and keep their k + 1 smallest ids there: more can't be
among the k nearest, as ties go to smaller ids. So a vector that a third of all rows share costs no more than one.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id. Only vectors of one length are compared. Of rows that share an id the one with the least vector counts,
and none of them is its own neighbour. A query with fewer than k candidates gets all. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Lean, least_hashed, stored

CODES = 16
WIDTH = 2


class Quantiser:
    """Codebooks (blocks, 16, 2) for vectors of `dim` dimensions, padded with zeros to whole pairs of blocks."""

    def __init__(self, dim: int, books: np.ndarray, eta: float):
        self.dim, self.books, self.eta = dim, books, eta

    @staticmethod
    def _padded(x: np.ndarray) -> np.ndarray:
        whole = -(-x.shape[1] // (2 * WIDTH)) * 2 * WIDTH
        return np.pad(x, ((0, 0), (0, whole - x.shape[1])))

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.3, rounds: int = 8, seed: int = 3) -> Quantiser:
        """threshold: the inner product, as a share of the norms, from which errors matter."""
        dim, x = x.shape[1], cls._padded(x.astype(np.float64))
        rng, blocks = np.random.default_rng(seed), x.shape[1] // WIDTH
        eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        parts = x.reshape(len(x), blocks, WIDTH)
        start = rng.choice(len(x), CODES, replace=len(x) < CODES)
        out = cls(dim, parts[start].transpose(1, 0, 2) + rng.normal(0, 1e-6, (blocks, CODES, WIDTH)), eta)
        for r in range(rounds):
            codes = out.encode(x, sweeps=1, weigh=r >= rounds // 2)
            out._refit(parts, codes, eta if r >= rounds // 2 else 1.0)
        return out

    def _refit(self, parts: np.ndarray, codes: np.ndarray, eta: float) -> None:
        weight = (eta - 1) / np.maximum((parts**2).sum((1, 2)), 1e-30)
        near = self.books[np.arange(parts.shape[1]), codes]
        along = ((parts - near) * parts).sum(2)  # of each block: the residual's product with the vector
        for b in range(parts.shape[1]):
            rest, own = along.sum(1) - along[:, b], parts[:, b]
            reach = weight * (rest + (own**2).sum(1))
            for c in np.unique(codes[:, b]):
                i = codes[:, b] == c
                left = i.sum() * np.eye(WIDTH) + np.einsum("n,ni,nj->ij", weight[i], own[i], own[i])
                self.books[b, c] = np.linalg.solve(left, (own[i] * (1 + reach[i])[:, None]).sum(0))
            along[:, b] = ((own - self.books[b, codes[:, b]]) * own).sum(1)

    def encode(self, x: np.ndarray, sweeps: int = 2, weigh: bool = True, rows: int = 4096) -> np.ndarray:
        """The codes (n, blocks) by coordinate descent on the score-aware loss, from the nearest codewords."""
        if x.shape[1] != self.books.shape[0] * WIDTH:
            x = self._padded(x)
        out = np.empty((len(x), self.books.shape[0]), np.uint8)
        for at in range(0, len(x), rows):
            p = x[at : at + rows].astype(np.float64).reshape(-1, self.books.shape[0], WIDTH)
            gap = p[:, :, None, :] - self.books[None]  # n, blocks, 16, 2
            plain, along = (gap**2).sum(3), (gap * p[:, :, None, :]).sum(3)
            code = plain.argmin(2)
            if weigh and self.eta > 1:
                weight = (self.eta - 1) / np.maximum((p**2).sum((1, 2)), 1e-30)
                n = np.arange(len(p))
                total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
                for _ in range(sweeps):
                    for b in range(p.shape[1]):
                        rest = total - along[n, b, code[:, b]]
                        code[:, b] = (plain[:, b] + weight[:, None] * (rest[:, None] + along[:, b]) ** 2).argmin(1)
                        total = rest + along[n, b, code[:, b]]
            out[at : at + rows] = code
        return out

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes in a byte: (n, blocks / 2)."""
        codes = self.encode(x)
        return codes[:, ::2] * np.uint8(CODES) + codes[:, 1::2]

    def residuals(self, x: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """The norm of what the codes leave of each vector."""
        codes = np.stack([packed // CODES, packed % CODES], 2).reshape(len(packed), -1)
        near = self.books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
        return np.linalg.norm(self._padded(x) - near, axis=1)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, n) from tables."""
        q = self._padded(queries.astype(np.float64)).reshape(len(queries), -1, WIDTH)
        tables = np.einsum("qbw,bcw->qbc", q, self.books)
        pairs = (tables[:, ::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q), -1, CODES * CODES).astype(np.float32)
        out = np.zeros((len(q), len(packed)), np.float32)
        for b in range(packed.shape[1]):
            out += np.take(pairs[:, b], packed[:, b], axis=1)
        return out


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def fit_quantisers(rows: DataFrame, sample: int = 20_000, threshold: float = 0.3) -> dict[int, Quantiser]:
    """A quantiser for each of the 64 commonest lengths of vectors, from at most `sample` vectors in all and at least a few
    of each length. Blocks of further lengths get one of their own vectors. Either way the search is exact: quantisers
    only decide how many vectors are reranked."""
    lengths = [r[0] for r in rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count")).limit(64).collect()]
    out = {}
    for dim in lengths:
        own = least_hashed(rows.filter(F.size("embedding") == dim), "vec_id", max(64, sample // len(lengths)))
        found = [r[0] for r in own.select("embedding").collect()]  # bounded by sample
        out[dim] = Quantiser.fit(np.array(found, np.float64), threshold)
    return out


def index(rows: DataFrame, quantisers: dict[int, Quantiser], k: int, block_rows: int = 16_384) -> DataFrame:
    """The packed blocks: (dim, block, ids, starts, vectors, codes, residuals). ids holds, for each different vector, its k + 1
    smallest ids; starts says where those of a vector begin. own_ids and own_of hold every id with its vector."""
    shared = rows.sparkSession.sparkContext.broadcast(quantisers)
    n_blocks = max(1, -(-rows.count() // block_rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        x, ids = np.array(pdf["embedding"].tolist(), np.float64).reshape(-1, dim), pdf["vec_id"].to_numpy(np.int64)
        order = np.lexsort((*x.T[::-1], ids))
        x, ids = x[order], ids[order]
        first = np.r_[True, ids[1:] != ids[:-1]]
        x, ids = np.ascontiguousarray(x[first]) + 0.0, ids[first]
        _, at, of = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
        vectors = x[at]
        by = np.argsort(of, kind="stable")  # ids stay in order within a vector
        begin = np.searchsorted(of[by], np.arange(len(at) + 1))
        keep = np.arange(len(by)) - begin[of[by]] <= k
        starts = np.searchsorted(of[by][keep], np.arange(len(at) + 1))
        quantiser = shared.value.get(dim) or Quantiser.fit(vectors[:1000])
        codes = quantiser.packed(vectors)
        packed = [ids[by][keep], starts, vectors, codes, quantiser.residuals(vectors, codes), ids, of.astype(np.int64)]
        return pd.DataFrame([[dim, int(pdf["block"].iloc[0]), *(a.tobytes() for a in packed)]], columns=["dim", "block", "ids", "starts", "vectors", "codes", "residuals", "own_ids", "own_of"])

    dealt = rows.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block"), "vec_id", "embedding")
    kinds = "dim int, block long, ids binary, starts binary, vectors binary, codes binary, residuals binary, own_ids binary, own_of binary"
    return stored(dealt.groupBy("dim", "block").applyInPandas(pack, kinds))


def search(blocks: DataFrame, quantisers: dict[int, Quantiser], k: int = 20, every: int = 20, rerank: int = 160, query_rows: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id `every` divides, against all rows."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(quantisers)

    def queries_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, ids, of, vectors in zip(batch["dim"], batch["own_ids"], batch["own_of"], batch["vectors"], strict=True):
                ids, of = np.frombuffer(ids, np.int64), np.frombuffer(of, np.int64)
                x, mine = np.frombuffer(vectors).reshape(-1, dim), np.flatnonzero(ids % every == 0)
                for at in range(0, len(mine), query_rows):
                    i = mine[at : at + query_rows]
                    yield pd.DataFrame({"q_dim": [dim], "q_ids": [ids[i].tobytes()], "q_vectors": [x[of[i]].tobytes()]})

    asked = stored(blocks.select("dim", "own_ids", "own_of", "vectors").mapInPandas(Lean(queries_of), "q_dim int, q_ids binary, q_vectors binary"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if row.dim != row.q_dim:
                    continue
                ids, starts = np.frombuffer(row.ids, np.int64), np.frombuffer(row.starts, np.int64)
                x = np.frombuffer(row.vectors).reshape(-1, row.dim)
                quantiser = shared.value.get(row.dim) or Quantiser.fit(x[:1000])
                codes = np.frombuffer(row.codes, np.uint8).reshape(len(x), -1)
                q_ids, q = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_vectors).reshape(-1, row.dim)
                residuals = np.frombuffer(row.residuals)
                for at in range(0, len(q), 64):
                    yield best(q_ids[at : at + 64], q[at : at + 64], ids, starts, x, codes, residuals, quantiser)

    def best(q_ids, q, ids, starts, x, codes, residuals, quantiser) -> pd.DataFrame:
        scores, most = quantiser.scan(q, codes), max(rerank, k + 1)
        found: list[list] = [[], [], []]
        norms, size = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1) + residuals
        close = None
        for i in range(len(q)):
            near = np.argpartition(-scores[i], most)[:most] if len(x) > most else np.arange(len(x))
            exact = (x[near] * q[i]).sum(1)  # summed row by row, so equal vectors score equally
            if len(x) > most:
                # k other ids at least reach the (k + 1)-th score; what isn't surely below it is reranked too
                least = np.partition(exact, -k - 1)[-k - 1]
                slack = norms[i] * size
                slack = np.where(slack < 1e37, q.shape[1] * (slack * 2.0**-22 + 1e-37), np.inf)  # of sums in float32
                may = ~(scores[i] + norms[i] * residuals + slack < least)
                may[near] = False
                if np.count_nonzero(may) > most:
                    close = q.astype(np.float32) @ x.astype(np.float32).T if close is None else close
                    may &= ~(close[i] + slack < least)
                more = np.flatnonzero(may)
                near, exact = np.r_[near, more], np.r_[exact, (x[more] * q[i]).sum(1)]
            count = starts[near + 1] - starts[near]
            which = np.repeat(starts[near], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            all_ids, all_scores = ids[which], np.repeat(exact, count)
            order = np.lexsort((all_ids, -all_scores))
            order = order[all_ids[order] != q_ids[i]][:k]
            for c, v in zip(found, (np.full(len(order), q_ids[i]), all_ids[order], all_scores[order]), strict=True):
                c.append(v)
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), found, strict=True)})

    n = blocks.count()
    pairs = blocks.select("dim", "ids", "starts", "vectors", "codes", "residuals").repartition(max(1, n)).crossJoin(asked.repartition(max(1, min(24 // max(n, 1), 8))))
    near = pairs.mapInPandas(Lean(scan), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, every: int = 20, sample: int = 20_000, rerank: int = 160) -> DataFrame:
    rows = _valid(vectors, vec_id, embedding)
    quantisers = fit_quantisers(rows, sample)
    return search(index(rows, quantisers, k), quantisers, k, every, rerank)
