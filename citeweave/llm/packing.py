"""Packing documents into token sequences with few sequences.

Documents become token pieces: whole ones, or, where a document is longer than a sequence, full pieces and a rest. Only
lengths matter for packing, and there are at most `capacity` different lengths, so the plan is made on their histogram:
its size doesn't grow with the data. The plan first applies Martello and Toth's dominance reduction (a set of at most
three pieces that dominates every other set holding its largest piece is fixed for good), then best fit, longest first,
on what is left. A plan is a list of (lengths in a sequence, number of such sequences). Each piece has a rank among the
pieces of its length, and its rank gives its place in the plan: no task ever sees more than its own pieces.

Defined cases: a null text is an empty one; it still has its end token. Texts of any length are read whole. Null doc_ids are kept. Repeated rows are packed
each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Lean, free_name, kept_by_worker, stored

Plan = list[tuple[tuple[int, ...], int]]


class _Sizes:
    """A histogram of lengths with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def largest(self, limit: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to limit of which a piece is left besides those of without."""
        i = bisect_right(self.order, limit) - 1
        while i >= 0 and self.n[self.order[i]] <= without.count(self.order[i]):
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, k: int, without: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(k - len(out), self.n[s] - without.count(s))
            if len(out) == k:
                break
        return out


def _best_pair(sizes: _Sizes, limit: int, without: tuple[int, ...]) -> tuple[int, int] | None:
    """Two pieces with the largest sum up to limit."""
    best, order, i = None, sizes.order, bisect_right(sizes.order, limit) - 1
    j = 0
    while i >= 0 and j <= i:
        a, b = order[j], order[i]
        if a + b > limit or sizes.n[b] <= without.count(b):
            i -= 1
            continue
        need = (a, b)
        if all(sizes.n[s] - without.count(s) >= need.count(s) for s in need) and (best is None or a + b > sum(best)):
            best = (b, a)
            if a + b == limit:
                break
        j += 1
    return best


def _dominating(sizes: _Sizes, w: int, capacity: int) -> tuple[int, ...] | None:
    """The set that dominates all others that hold a piece of length w, if there is one of at most three pieces.

    For the space r beside w: if not even the smallest piece fits, {w}. If the largest piece b that fits fills r, or no
    two pieces fit together, {w, b}. If two fit together but no three, {w, b} if b is no smaller than the largest sum of
    two that fit, and {w, x, y} if that largest sum fills r with its larger piece equal to b."""
    room, own = capacity - w, (w,)
    few = sizes.smallest(3, own)
    fits = sum(1 for i in range(len(few)) if sum(few[: i + 1]) <= room)
    if not fits:
        return own
    b = sizes.largest(room, own)
    if fits == 1 or b == room:
        return (w, b)
    if fits == 2:
        pair = _best_pair(sizes, room, own)
        if b >= sum(pair):
            return (w, b)
        if pair[0] == b and sum(pair) == room:
            return (w, *pair)
    return None


def dominance_reduction(counts: dict[int, int], capacity: int, passes: int = 4) -> tuple[Plan, dict[int, int]]:
    """Fixes sequences that some best packing holds, from the longest pieces down; returns them and what is left. Pieces
    that no set dominates for stay among those that shorter pieces are compared with. What is fixed may make more sets
    dominate, so there are up to `passes` passes."""
    sizes, plan = _Sizes(counts), []
    for _ in range(passes):
        before = len(plan)
        for w in reversed(sizes.order[:]):
            while sizes.n.get(w) and (fixed := _dominating(sizes, w, capacity)):
                # fewer pieces never weaken the reasons, so the set holds as long as each of its lengths lasts
                need = {s: fixed.count(s) for s in fixed}
                times = min(sizes.n[s] // k for s, k in need.items())
                for s, k in need.items():
                    sizes.take(s, k * times)
                plan.append((fixed, times))
        if len(plan) == before:
            break
    return plan, dict(sizes.n)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first: a piece goes where it leaves the least space. Equal sequences are handled together."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms: list[int] = []

    def put(room: int, pieces: tuple[int, ...], n: int) -> None:
        if n:
            if not bins[room]:
                insort(rooms, room)
            bins[room][pieces] += n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n and (i := bisect_left(rooms, size)) < len(rooms):
            room = rooms[i]
            pieces, m = next(iter(bins[room].items()))
            each = room // size
            full = min(m, n // each)
            del bins[room][pieces]
            if not bins[room]:
                rooms.pop(i)
            put(room - each * size, pieces + (size,) * each, full)
            n -= full * each
            if full < m:
                if 0 < n < each:
                    put(room - n * size, pieces + (size,) * n, 1)
                    full, n = full + 1, 0
                put(room, pieces, m - full)
        each = capacity // size
        put(capacity - each * size, (size,) * each, n // each)
        if n % each:
            put(capacity - n % each * size, (size,) * (n % each), 1)
    return [(pieces, n) for room in rooms for pieces, n in bins[room].items()]


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Fixed sequences first, then best fit for what is left. Pieces that fill a sequence stand alone. If best fit over
    everything needs fewer sequences, that plan is taken."""
    fixed, left = dominance_reduction(counts, capacity)
    plan, plain = fixed + best_fit(left, capacity), best_fit(counts, capacity)
    return plan if sum(n for _, n in plan) <= sum(n for _, n in plain) else plain


class Places:
    """Where the piece of a length and rank goes: sorted starts of ranges of ranks, for numpy's searchsorted."""

    def __init__(self, plan: Plan):
        used: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for pieces, n in plan:
            at = 0
            for size in sorted(set(pieces), reverse=True):
                k = pieces.count(size)
                rows.append((size, used[size], first, k, at))
                used[size] += n * k
                at += size * k
            first += n
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.size, self.rank, self.first, self.k, self.at = table.T
        self.begin = {s: i for i, s in reversed(list(enumerate(self.size.tolist())))}
        self.end = {s: i + 1 for i, s in enumerate(self.size.tolist())}

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            own = size == s
            lo, hi, r = self.begin[s], self.end[s], rank[own]
            i = lo + np.searchsorted(self.rank[lo:hi], r, side="right") - 1
            past = r - self.rank[i]
            sequence[own] = self.first[i] + past // self.k[i]
            offset[own] = self.at[i] + past % self.k[i] * s
        return sequence, offset


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokenizer drops white space and its normalizer works on characters, so a text's ids are those of
    its words in order; the ids of a word are kept, up to a bounded number of words. A word of Latin letters, or of such
    with ASCII punctuation after them, is one pre-token or two: its letters in lower case go to the vocabulary's model
    directly, past the normalizer, which costs most of the time. All other words are encoded by the whole tokenizer,
    together, with a separator between that no word holds."""

    #: Letters of U+0041 to U+024F but U+0130, whose lower case is no letter; punctuation without the apostrophe.
    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, end: int, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.most = Tokenizer.from_file(path), end.to_bytes(4, "little"), most
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[str, bytes] = {}
        self.gap = self._ids("\x00")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _part(self, part: str) -> bytes:
        """The ids of a pre-token that is normalized already: those of the word that it is by itself."""
        found = self.known.get(part)
        if found is None:
            name = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(name)] if part else []
            found = self.known[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _learn(self, words: list[str]) -> None:
        others = []
        for w in words:
            if m := self.PLAIN.fullmatch(w):
                self.known[w] = self._part(m[1].lower()) + self._part(m[2])
            else:
                others.append(w)
        if others and len(self.gap) == 1 and not any("\x00" in w for w in others):
            ids = self._ids(" \x00 ".join(others))
            cuts = np.flatnonzero(ids == self.gap[0])
            if len(cuts) == len(others) - 1:
                data, at = ids.tobytes(), 0
                for w, cut in zip(others, [*(cuts * 4).tolist(), len(data)], strict=True):
                    self.known[w] = data[at:cut]
                    at = cut + 4
                return
        for w in others:
            self.known[w] = self._ids(w).tobytes()

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # these split in Python, but not in the tokenizer
            words = [w for w in re.split(r"[^\S\x1c-\x1f]+", text) if w]
        else:
            words = text.split()
        known = self.known
        try:
            return b"".join([known[w] for w in words]) + self.end
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        self._learn([w for w in dict.fromkeys(words) if w not in known])
        return b"".join([known[w] for w in words]) + self.end


def _owner(tokenizer: str, end: int) -> str:
    return f"encoder {tokenizer} {end}"


def _encoder(tokenizer: str, end: int) -> WordEncoder:
    """One encoder for a Python worker, so that tasks find the words of those before them; it goes when the worker turns
    to another operator."""
    import public_tokenizers

    return kept_by_worker(_owner(tokenizer, end), lambda: WordEncoder(public_tokenizers.path(tokenizer), end))


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and the ids themselves if asked for."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer, end)
        step = 4 * capacity
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = encode(t)
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((None if i != i else i, p, at // 4, len(part) // 4, zlib.crc32(part), *([part] * with_ids)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield out.astype({"doc_id": "Int64"}) if kind in ("bigint", "int") else out

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(Lean(cut, owner=_owner(tokenizer, end)), schema)


def pack(pieces: DataFrame, capacity: int = 4096, length: str = "length", key: list[str] | None = None, rows_per_bucket: int = 500_000) -> DataFrame:
    """pieces with sequence_id and offset; `length` is from 1 to capacity.

    A piece's rank among those of its length is its place in a bucket (a hash of its key columns) plus the sizes of
    the buckets before; so a length that a third of all pieces have is spread over buckets too.
    """
    rank, bucket, before = (free_name(pieces, c) for c in ("piece_rank", "piece_bucket", "ranks_before"))
    sequence, offset = free_name(pieces, "sequence_id"), free_name(pieces, "offset")
    key = key or [c for c in pieces.columns if c != length]
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    n_buckets = max(16, -(-sum(counts.values()) // rows_per_bucket))
    places = pieces.sparkSession.sparkContext.broadcast(Places(make_plan(counts, capacity)))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*key), F.lit(n_buckets)).cast("int"))
    sums = dealt.groupBy(length, bucket).agg(F.count(F.lit(1)).alias(before))
    within = Window.partitionBy(length).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(before).over(within), F.lit(0)))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(length, bucket).orderBy(*key)) - 1)
    ranked = ranked.join(sums, [length, bucket]).withColumn(rank, (F.col(rank) + F.col(before)).cast("long"))
    ranked = ranked.select(*pieces.columns, rank)

    @F.pandas_udf(f"{sequence} long, {offset} long")
    def place(size: pd.Series, at: pd.Series) -> pd.DataFrame:
        s, o = places.value.of(size.to_numpy(np.int64), at.to_numpy(np.int64))
        return pd.DataFrame({sequence: s, offset: o})

    spot = free_name(pieces, "spot")
    return ranked.withColumn(spot, place(F.col(length), F.col(rank))).select(*pieces.columns, f"{spot}.*")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) and the ids if asked for: one row per piece."""
    pieces = token_pieces(docs, doc_id, text, capacity, tokenizer, end, with_ids)
    # equal rows differ in their number, so that they are dealt over buckets like others
    pieces = stored(pieces.withColumn("piece_number", F.monotonically_increasing_id()))
    return pack(pieces, capacity, key=["piece_number"]).drop("piece_number")
