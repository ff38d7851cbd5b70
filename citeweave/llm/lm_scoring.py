"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens: A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`, then one end for each text. Documents whose crc32(doc_id as text)
mod 10 is 0 are held out; all others are learned from, whole.

Units. The model predicts units: the end, the most frequent words, each a unit with a vector of its own, and `classes`
classes of all other words by their last two characters (the endings with most tokens, and one class for the rest).
There are about 2 sqrt(V) units for V different words, `most_units` at most (a bound on what is broadcast). A word's
probability is its unit's probability in context times, in a class, (c + 0.1) / (n + 0.1 (v + 1)) with the class's n
tokens and v words; what is left belongs to the class's unseen words. So the probabilities of all words and one unseen
word per class add up to 1 in every context.

Model. A context is the units of the two tokens before (the end stands before a text). Log-bilinear: the predicted
vector is sum_i C_i r(u_i), with a matrix C_i for each place, and the score of unit w is its product with q(w), plus a
bias. It is trained in numpy on every token of the training texts, in minibatches: each has `noise` units drawn from the
unigram distribution, shared by its tokens, and the noise-contrastive objective tells tokens from noise. The texts are
kept as streams of two-byte units in the shared folder. In each of `rounds` rounds every task trains on its streams of
the round, from the same parameters; their means, weighted by tokens, are the next round's. All streams are seen the
same number of times: once, and more often where there are fewer than `least_tokens` tokens.

Scores are sums over the two places, so the normaliser of all contexts is one matrix product of exponentials,
Z = exp(A + b) exp(B)', and a token's normalised log-probability is A[two, w] + B[one, w] + b[w] - ln Z[two, one]: four
table look-ups.

Scale. Streams, counts and the words told apart grow with the corpus. What is sent around has a bounded size: the tables
of at most `most_units`^2 numbers, and the `head` most frequent words at most, with their counts. Counts of all other
words are met in a shuffle: each document brings its rare words to the vocabulary table. Words there are rare, so no key
is hot; the head needs no shuffle at all.

Defined cases: a null text is an empty one, with one end token. A null doc_id counts as the text "" (crc32 0: held
out). Repeated rows are counted and scored each for itself. With nothing to learn from, the base is the uniform one of
its formula (N = V = 0) and so is the model over its units. Texts of any length are read whole. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_BYTES, Lean, forget, stored

END = ""  # no word is empty
ALPHA = 0.1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def _ending(word: Column) -> Column:
    return F.right(word, F.lit(2))


def vocabulary(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, c) over the texts of docs, END among them. Counted in each partition, at most `most` words at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in held], "c": list(held.values())})

        for batch in batches:
            for t in batch["text"]:
                held.update(words_of(t))
            held[END.encode()] += len(batch)
            if len(held) > most:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select("text").mapInPandas(Lean(count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Units:
    """The units: END is 0, then single words, then classes; the last class is that of other endings."""

    singles: list[str]
    endings: list[str]
    tokens: np.ndarray  # of each unit
    words: np.ndarray

    def __post_init__(self):
        self.of_word = {w.encode(): i for i, w in enumerate(self.singles)}
        self.of_ending = {e: len(self.singles) + i for i, e in enumerate(self.endings)}
        self.other = len(self.singles) + len(self.endings)

    def __len__(self) -> int:
        return self.other + 1

    def of(self, word: bytes) -> int:
        u = self.of_word.get(word)
        return self.of_ending.get(word.decode("utf-8", "replace")[-2:], self.other) if u is None else u

    def class_column(self, word: Column) -> Column:
        """The unit of a word that is no single."""
        pairs = [F.lit(x) for e, u in self.of_ending.items() for x in (e, u)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), _ending(word)), F.lit(self.other)) if pairs else F.lit(self.other)


def frequent_words(vocab: DataFrame, head: int) -> list[tuple[str, int]]:
    """(word, count) of at most `head` words, the most frequent first: all whose count reaches the least step of a
    sixteenth of an octave that no more than `head` words reach. Only steps and those words go to the driver."""
    step = F.floor(F.log2("c") * 16).cast("int")
    held = vocab.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 16 for each octave
    least, room = None, head
    for r in sorted(held, key=lambda r: -r["step"]):
        if (room := room - r["n"]) < 0:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(((r["word"], r["c"]) for r in vocab.filter(step >= least).collect()), key=lambda x: (-x[1], x[0]))  # bounded by head


def choose_units(vocab: DataFrame, frequent: list[tuple[str, int]], units: int, classes: int = 64) -> Units:
    top = [(w, c) for w, c in frequent if w != END][: max(units - classes - 1, 0)]
    ends = vocab.filter(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    singles = [END, *(w for w, _ in top)]
    known = F.broadcast(vocab.sparkSession.createDataFrame([(w,) for w in singles], "word string"))  # as many as units
    rest = vocab.join(known, "word", "left_anti")
    mass = rest.groupBy(_ending(F.col("word")).alias("e")).agg(F.sum("c").alias("c"))
    endings = [r["e"] for r in mass.orderBy(F.desc("c"), "e").limit(classes - 1).collect()]
    out = Units(singles, endings, np.zeros(0), np.zeros(0))
    sums = rest.groupBy(out.class_column(F.col("word")).alias("u")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    out.tokens, out.words = np.zeros(len(out)), np.zeros(len(out))
    for i, n in enumerate([ends, *(c for _, c in top)]):
        out.tokens[i], out.words[i] = n, 1
    for u, c, v in sums.collect():  # at most `classes` rows
        out.tokens[u], out.words[u] = c, v
    return out


class UnitReader:
    """Words as units; those of words are kept, up to a bounded number."""

    def __init__(self, units: Units, most: int = 200_000):
        self.units, self.most, self.known = units, most, {}

    def __call__(self, words: list[bytes]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            of = self.units.of
            for w in words:
                if w not in known:
                    known[w] = of(w)
            return [known[w] for w in words]


def unit_streams(docs: DataFrame, units: Units, size: int = 1 << 18) -> DataFrame:
    """(ids, n): all texts of docs as units in two bytes each, an end after each text, in rows of about `size` units."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, held, n = UnitReader(shared.value), [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"ids": [b"".join(held)], "n": [n]})

        for batch in batches:
            for t in batch["text"]:
                ids = np.array([*read(words_of(t)), 0], np.uint16)
                held.append(ids.tobytes())
                n += len(ids)
                if n >= size:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return docs.select("text").mapInPandas(Lean(run), "ids binary, n long")


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a stream: the units two and one before each token; before a text stands the end."""
    one = np.r_[0, ids[:-1]].astype(np.int64)
    two = np.r_[0, 0, ids[:-2]][: len(ids)].astype(np.int64)
    two[one == 0] = 0
    return two, one


class LogBilinear:
    """The parameters, as one array of float32 with views into it."""

    def __init__(self, units: int, dim: int = 16, seed: int = 5, flat: np.ndarray | None = None):
        self.units, self.dim = units, dim
        rng, size = np.random.default_rng(seed), 2 * units * dim + 2 * dim * dim + units
        self.flat = np.zeros(size, np.float32) if flat is None else flat.astype(np.float32)
        cuts = np.cumsum([units * dim, units * dim, 2 * dim * dim])
        r, q, c, self.b = np.split(self.flat, cuts)
        self.r, self.q, self.c = r.reshape(units, dim), q.reshape(units, dim), c.reshape(2, dim, dim)
        if flat is None:
            self.r[:], self.q[:] = rng.normal(0, 0.1, (2, units, dim))
            self.c[:] = rng.normal(0, 0.1, (2, dim, dim)) + np.eye(dim)

    def gradient(self, two: np.ndarray, one: np.ndarray, word: np.ndarray, noise: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Of the noise-contrastive objective, to be maximised: sum of log s(score - ln(k P)) over the tokens and of
        log(1 - s(score - ln(k P))) over the noise that they share. shift: ln(k P) of each unit, k the number of noise units."""
        out = LogBilinear(self.units, self.dim, flat=np.zeros(len(self.flat)))
        r2, r1 = self.r[two], self.r[one]
        h = r2 @ self.c[0].T + r1 @ self.c[1].T
        true = 1 / (1 + np.exp((h * self.q[word]).sum(1) + self.b[word] - shift[word]))  # 1 - s
        false = -1 / (1 + np.exp(-(h @ self.q[noise].T + self.b[noise] - shift[noise])))  # -s
        g_h = true[:, None] * self.q[word] + false @ self.q[noise]
        out.b[:] = np.bincount(word, true, self.units)
        np.add.at(out.b, noise, false.sum(0))
        np.add.at(out.q, noise, false.T @ h)
        own = true[:, None] * h
        g2, g1 = g_h @ self.c[0], g_h @ self.c[1]
        for d in range(self.dim):
            out.q[:, d] += np.bincount(word, own[:, d], self.units)
            out.r[:, d] = np.bincount(two, g2[:, d], self.units) + np.bincount(one, g1[:, d], self.units)
        out.c[0], out.c[1] = g_h.T @ r2, g_h.T @ r1
        return out.flat

    def train(self, streams: list[np.ndarray], p_noise: np.ndarray, noise: int, rate: float, seed: int, batch: int = 4096) -> None:
        """One pass over streams of units in minibatches, each with noise units drawn anew; steps by Adagrad."""
        rng, draw = np.random.default_rng(seed), np.cumsum(p_noise)
        shift, seen = np.log(noise * p_noise).astype(np.float32), np.full(len(self.flat), 1e-2, np.float32)
        for ids in streams:
            two, one = contexts(ids)
            for at in range(0, len(ids), batch):
                cut = slice(at, at + batch)
                drawn = np.minimum(np.searchsorted(draw, rng.random(noise)), self.units - 1)
                g = self.gradient(two[cut], one[cut], ids[cut].astype(np.int64), drawn, shift) / len(ids[cut])
                seen += g * g
                self.flat += rate * g / np.sqrt(seen)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of exp(A), of exp(B + b) / 1 and of Z: a token's normalised log10 probability is
        A[two, w] + B[one, w] - Z[two, one]."""
        a, b = (self.r @ self.c[0].T) @ self.q.T, (self.r @ self.c[1].T) @ self.q.T + self.b
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.log(np.exp(a - top_a) @ np.exp(b - top_b).T + 1e-30) + top_a + top_b.T
        return tuple((x / np.log(10)).astype(np.float32) for x in (a, b, z))


def fit_model(streams: DataFrame, units: Units, dim: int, noise: int, rounds: int, rate: float, least_tokens: int) -> LogBilinear:
    """Training in rounds; in each the streams' tasks train side by side, and their parameters are averaged."""
    spark, n = streams.sparkSession, int(units.tokens.sum())
    p_noise = (units.tokens + 1) / (units.tokens + 1).sum()
    model = LogBilinear(len(units), dim)
    model.b[:] = np.log(p_noise)
    if not n:
        return model
    passes = max(1, -(-least_tokens // n))

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flat = sum((np.frombuffer(p, np.float64) for p in rows["flat"]), np.zeros(len(model.flat)))
        return pd.DataFrame({"part": [0], "flat": [flat.tobytes()], "n": [int(rows["n"].sum())]})

    for k in range(rounds):
        visits = [(k * passes + j) % rounds for j in range(passes)]
        shared = spark.sparkContext.broadcast((model.flat, visits))
        step = rate / (1 + 2 * k / rounds)

        def run(batches: Iterator[pd.DataFrame], shared=shared, step=step, k=k) -> Iterator[pd.DataFrame]:
            flat, visits = shared.value
            task = TaskContext.get()
            part, own, mine, done = task.partitionId() if task else 0, LogBilinear(len(units), dim, flat=flat), {}, 0
            for batch in batches:
                for ids, slot in zip(batch["ids"], batch["slot"], strict=True):
                    mine.setdefault(int(slot), []).append(np.frombuffer(ids, np.uint16))
            for j, slot in enumerate(visits):
                found = mine.get(slot, [])
                own.train(found, p_noise, noise, step, hash((k, j, part)) % 2**31)
                done += sum(map(len, found))
            yield pd.DataFrame({"part": [part % 32], "flat": [(own.flat.astype(np.float64) * done).tobytes()], "n": [done]})

        wanted = streams.filter(F.col("slot").isin(sorted(set(visits)))).select("ids", "slot")
        sums = wanted.mapInPandas(Lean(run), "part int, flat binary, n long").filter("n > 0")
        sums = sums.groupBy("part").applyInPandas(add, "part int, flat binary, n long").groupBy().applyInPandas(add, "part int, flat binary, n long")
        for row in sums.collect():  # one row
            model = LogBilinear(len(units), dim, flat=np.frombuffer(row["flat"], np.float64) / row["n"])
        shared.unpersist()
    return model


@dataclass
class Scorer:
    """What every executor needs; its size is bounded by the numbers of units and of frequent words."""

    units: Units
    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    head: dict[bytes, int]  # the place of a frequent word in:
    base: np.ndarray  # its base log10 probability
    inside: np.ndarray  # its log10 probability in its unit
    unit: np.ndarray


def _in_class(c: np.ndarray | float, tokens: float, words: float):
    return np.log10((c + ALPHA) / (tokens + ALPHA * (words + 1)))


def fit(
    docs: DataFrame, most_units: int = 1024, classes: int = 64, head: int = 30_000, dim: int = 16, noise: int = 32, rounds: int = 8, rate: float = 0.2, least_tokens: int = 8_000_000
) -> tuple[Scorer, DataFrame, int, int]:
    """The scorer, the vocabulary table, N and V, from all of docs."""
    vocab = stored(vocabulary(docs))
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = frequent_words(vocab, head)
    units = choose_units(vocab, frequent, max(2 * classes, min(most_units, int(2 * v**0.5))), classes)
    streams = unit_streams(docs, units).withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(rounds)).cast("int"))
    streams = stored(streams)
    model = fit_model(streams, units, dim, noise, rounds, rate, least_tokens)
    forget(streams)
    if END not in dict(frequent):  # it needs its place among the frequent words whatever its rank
        frequent = [*frequent, (END, int(units.tokens[0]))]
    counts, names = np.array([c for _, c in frequent], float), [w.encode() for w, _ in frequent]
    of = np.array([units.of(w) if w else 0 for w in names], np.int64)
    inside = np.where(of < len(units.singles), 0.0, _in_class(counts, units.tokens[of], units.words[of]))
    base = np.log10((counts + ALPHA) / (n + ALPHA * (v + 1)))
    return Scorer(units, model.tables(), {w: i for i, w in enumerate(names)}, base, inside, of), vocab, n, v


def _local_scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(row_id, doc_id, n_tokens, base, model, rare words and how often): all that needs no count of a rare word."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(scorer), docs.schema["doc_id"].dataType.simpleString()
    schema = f"row_id long, doc_id {kind}, n_tokens long, n_known long, base double, model double, rare array<string>, times array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, task = shared.value, TaskContext.get()
        row = (task.partitionId() if task else 0) << 36
        a, b, z = s.tables
        rare_unit, place, end = UnitReader(s.units), s.head.get, s.head[b""]
        for batch in batches:
            out = []
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(t)
                at = np.array([place(w, -1) for w in words] + [end], np.int64)
                ids, known = s.unit[at], at >= 0
                rare: Counter = Counter()
                if not known.all():
                    unknown = np.flatnonzero(~known).tolist()
                    strange = [words[k] for k in unknown]
                    ids[unknown] = rare_unit(strange)
                    rare.update(strange)
                    at = at[known]
                two, one = contexts(ids)
                model = (a[two, ids] + b[one, ids] - z[two, one]).sum(dtype=np.float64) + s.inside[at].sum()
                names = [w.decode("utf-8", "replace") for w in rare]
                out.append((row, i, len(words) + 1, len(at), s.base[at].sum(), model, names, list(rare.values())))
                row += 1
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            yield frame.astype({"doc_id": "Int64"}) if kind in ("bigint", "int") else frame

    return docs.select("doc_id", "text").mapInPandas(Lean(run), schema)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scorer, vocab, n, v = fit(docs.filter(~held_out(F.col("doc_id"))), **options)
    rows = stored(_local_scores(docs, scorer))
    units = scorer.units
    kinds = vocab.sparkSession.createDataFrame([(i, float(t), float(w)) for i, (t, w) in enumerate(zip(units.tokens, units.words, strict=True))], "unit int, tokens double, words double")
    rare = rows.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_id", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(vocab, "word", "left").withColumn("unit", units.class_column(F.col("word"))).join(F.broadcast(kinds), "unit")
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    base = F.log10((c + ALPHA) / F.lit(n + ALPHA * (v + 1)))
    model = F.log10((c + ALPHA) / (F.col("tokens") + ALPHA * (F.col("words") + 1)))
    sums = rare.groupBy("row_id").agg(F.sum(times * base).alias("b"), F.sum(times * model).alias("m"), F.sum(F.when(c > 0, times).otherwise(0)).alias("k"))
    none = F.lit(0.0)
    known_end = F.lit(0 if n else -1)  # without training texts not even the end is known
    return rows.drop("rare", "times").join(sums, "row_id", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + known_end + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", none)).alias("base_score"),
        (F.col("model") + F.coalesce("m", none)).alias("score"),
    )
