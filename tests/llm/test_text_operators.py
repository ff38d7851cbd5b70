"""Line dedup, quality rules, LM scoring, n-gram join, packing and sharding against brute force on small tables."""

import hashlib
import math
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeweave.llm import _common, line_dedup, lm_scoring, ngram_join, packing, quality_rules, sharding
from citeweave.llm._common import stored

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = "this very long line stands in many documents"
TEXTS = [
    (1, f"alpha beta\n{LONG}\n  {LONG.upper()} \nend"), (2, f"{LONG}\nother words here and there"), (3, f"x\n{LONG}\t"), (4, ""), (5, None), (6, "a\n\nb"),
    (7, "two in all, but this is long enough"), (8, "two in all, but this is long enough"), (None, f"{LONG}\nno id"), (9, "é" * 30), (9, "é" * 30),
]
SCHEMA = "doc_id long, text string"


def words_of(text):
    return (text or "").encode().split()


def test_line_dedup_is_brute_force(spark):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digest(spark.createDataFrame(TEXTS, SCHEMA)).collect()}
    ids = [-(2**63) if i is None else i for i, _ in TEXTS]
    held = defaultdict(list)
    for i, (_, t) in zip(ids, TEXTS):
        for k in {line.strip(BLANK).translate(LOWER) for line in (t or "").split("\n")}:
            held[k].append(i)
    want = set()
    for i, (d, t) in zip(ids, TEXTS):
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(k := x.strip(BLANK).translate(LOWER)) >= 20 and len(held[k]) >= 3 and max(held[k]) != i)]
        want.add((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    assert got == want


def test_line_keys_lose_blanks_and_no_letters(spark):
    lines = ["for one of", "For one OF", "files are kept below", "Files are kept belowF", "f", "ff F", "\x0c", ""]
    lines += [f"{b}f one of{b}{b}" for b in BLANK] + [f"{BLANK}{c}x{c}{BLANK}" for c in "fF"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup.line_key(F.col("line")).alias("k")).collect()
    assert [r.k for r in got] == [x.strip(BLANK).translate(LOWER) for x in lines]
    shared = ["files are kept below", "For more, see the last page", "\x0cthe form feed stands before"]
    docs = [(i, "\n".join(x.lower() if i == 2 else x.strip(BLANK) if i == 1 else x for x in shared)) for i in (1, 2, 3)]
    docs += [(4, "or more, see the last page"), (5, "or more, see the last page")]  # a key of its own, in two documents
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_digest(spark.createDataFrame(docs, SCHEMA)).collect()} == {1: 3, 2: 3, 3: 0, 4: 0, 5: 0}


def test_line_dedup_keeps_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 7, "x")], "doc_id long, text string, n_lines int, H1 string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "H1", "_n_lines", "n_dropped"] and out.first()["n_lines"] == 7
    assert line_dedup.line_digest(df.filter("false")).count() == 0


def test_runs_are_levelled_and_batches_lose_seen_lines(spark):
    store = line_dedup.RunStore(fanout=2)
    kept = []
    for k in range(4):
        batch = spark.createDataFrame([(k, f"{LONG}\nthis line belongs to batch {k} alone")], SCHEMA)
        kept.append(line_dedup.drop_seen_lines(batch, store).first()["text"])
    assert kept[0].startswith(LONG) and all(LONG not in t for t in kept[1:])
    assert [len(level) for level in store.levels] == [0, 0, 1] and store.runs()[0].count() == 5


def test_line_dedup_of_hot_lines_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i, f"{LONG}\n{'row %04d ' % i * 4}\n{'the line of a half ' * 2 if i % 2 else ''}") for i in range(900)]
    rows += [(None, LONG)] * 50 + [(5000, "x" * 200_000 + "\n" + LONG)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(rows)
    half = max(i for i in range(900) if i % 3 == 2 and i % 2) + 1000
    for r in out:
        lines = r.text.split("\n")
        assert (LONG in lines) == (r.doc_id == 5000)
        assert ("the line of a half " * 2 in lines) == (r.doc_id == half)
        assert r.n_lines - r.n_dropped == len(lines) if r.text else r.n_lines - r.n_dropped in (0, 1)


def test_salted_join_is_a_join(spark):
    rows = spark.createDataFrame([(k, v) for v in range(1000) for k in ((0,) if v % 3 else (0, v))], "k int, v int")
    unique = spark.createDataFrame([(k, str(k)) for k in range(0, 1000, 2)], "k int, name string")
    hot = _common.hot_keys(rows.groupBy("k").count(), "count", rows.count())
    assert [tuple(r) for r in hot.collect()] == [(0, 16)]
    for how in ("inner", "left", "left_semi"):
        got, want = (sorted(map(str, x.collect())) for x in (_common.salted_join(rows, unique, ["k"], hot, how), rows.join(unique, "k", how)))
        assert got == want


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeated_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    assert quality_rules.repeated_words(words) == len(covered)


def test_quality_rules_find_what_labels_say(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(80)) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(f"w{(i + j * j) % 997}###" for j in range(80))) for i in range(60)]
    rest = [(500, None), (501, ""), (502, "short"), (503, "same three words " * 40), (None, good[0][1])]
    docs = spark.createDataFrame(good + bad + rest, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad[:40]] + [(None, 1, 0), (502, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules.quality_digest(docs, labels).collect()}
    assert all(out[i].kept for i, _ in good) and not any(out[i].kept for i, _ in bad)
    assert out[None].kept and out[500].n_words == 0 and all(out[i].base_failed and not out[i].kept for i in (500, 501, 502, 503))
    assert out[503].n_repeat_words == 120 and out[100].n_symbols == 240
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    assert quality_rules.quality_digest(docs, labels.filter("false")).filter("rule <> 0").count() == 0


def test_lm_scores(spark):
    rows = [(i, f"the cat sat on the mat {i % 5} the end of it" if i % 2 else f"der hund lag auf der matte {i % 5} am ende") for i in range(120)]
    rows += [(1000, None), (1001, ""), (None, "Unknown words ONLY"), (1002, "zzz qqq " * 50)]
    out = lm_scoring.score(spark.createDataFrame(rows, SCHEMA), most_units=24, classes=8, head=12, rounds=4, least_tokens=60_000).collect()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update([*lm_scoring.words_of(t), b""])
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    for r in out:
        tokens = [*lm_scoring.words_of(texts[r.doc_id]), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
    seen = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen) + 10


def test_lm_score_is_brute_force(spark):
    rows = [(i, f"the cat sat on the mat {i % 7} rare{i // 9} end" if i % 2 else "der hund lag auf dem Ofen " * (i % 4)) for i in range(100)] + [(None, "x y"), (200, None)]
    docs, options = spark.createDataFrame(rows, SCHEMA).coalesce(1), {"most_units": 16, "classes": 4, "head": 9, "rounds": 2, "least_tokens": 5000}
    scorer, vocab, _, _ = lm_scoring.fit(docs.filter(~lm_scoring.held_out(F.col("doc_id"))), **options)
    units, counts, (a, b, z) = scorer.units, {r.word.encode(): r.c for r in vocab.collect()}, scorer.tables
    want = {}
    for i, t in rows:
        tokens, total = [b"", b"", *lm_scoring.words_of(t), b""], 0.0
        ids = [units.of(w) if w else 0 for w in tokens]
        for k in range(2, len(ids)):
            two = ids[k - 2] if k > 2 else 0
            total += a[two, ids[k]] + b[ids[k - 1], ids[k]] - z[two, ids[k - 1]]
            if ids[k] >= len(units.singles):
                total += math.log10((counts.get(tokens[k], 0) + 0.1) / (units.tokens[ids[k]] + 0.1 * (units.words[ids[k]] + 1)))
        want[i] = total
    assert {r.doc_id: r.score for r in lm_scoring.score(docs, **options).collect()} == {i: pytest.approx(x, rel=1e-4) for i, x in want.items()}


def test_lm_counts_the_end_beyond_the_head(spark):
    docs = spark.createDataFrame([(i, "aa bb cc " * 5) for i in range(1, 9)], SCHEMA)
    scorer, vocab, n, v = lm_scoring.fit(docs, classes=4, head=2, rounds=2, least_tokens=1)
    assert scorer.base[scorer.head[b""]] == pytest.approx(math.log10((8 + 0.1) / (n + 0.1 * (v + 1)))) and (n, v) == (128, 4)
    assert lm_scoring.frequent_words(vocab, 2) == [] and lm_scoring.frequent_words(vocab, 3) == [("aa", 40), ("bb", 40), ("cc", 40)]
    empty = lm_scoring.score(docs.filter("false"))
    assert empty.count() == 0 and {r.train_tokens for r in lm_scoring.score(spark.createDataFrame([(8, "only held out")], SCHEMA).filter(lm_scoring.held_out(F.col("doc_id")))).collect()} <= {0}


def test_lm_follows_its_gradient_and_is_normalised():
    rng = np.random.default_rng(1)
    model = lm_scoring.LogBilinear(9, 4)
    two, one, word, noise = rng.integers(0, 9, 50), rng.integers(0, 9, 50), rng.integers(0, 9, 50), rng.integers(0, 9, 6)
    shift = np.log(6 * np.full(9, 1 / 9)).astype(np.float32)

    def objective(flat):
        m = lm_scoring.LogBilinear(9, 4, flat=flat)
        h = (m.r[two] @ m.c[0].T + m.r[one] @ m.c[1].T).astype(float)
        s = lambda x: 1 / (1 + np.exp(-x))
        return np.log(s((h * m.q[word]).sum(1) + m.b[word] - shift[word])).sum() + np.log(1 - s(h @ m.q[noise].T + m.b[noise] - shift[noise])).sum()

    g, step = model.gradient(two, one, word, noise, shift), 1e-2
    for i in rng.integers(0, len(g), 30):
        d = np.zeros(len(g), np.float32)
        d[i] = step
        assert (objective(model.flat + d) - objective(model.flat - d)) / (2 * step) == pytest.approx(g[i], abs=2e-2, rel=2e-2)
    stream = np.array(([1, 2, 3, 0] * 40 + [4, 5, 6, 7, 0] * 40) * 20, np.uint16)
    model.train([stream], np.bincount(stream, minlength=9) / len(stream) + 1e-3, 8, 0.2, 3, batch=64)
    a, b, z = model.tables()
    p = 10 ** (a[:, None, :] + b[None, :, :] - z[:, :, None]).astype(float)
    assert np.allclose(p.sum(2), 1, atol=1e-4) and p[1, 2, 3] > 0.5 and p[0, 4, 5] > 0.5
    assert [x.tolist() for x in lm_scoring.contexts(np.array([3, 0, 4, 5, 0, 0], np.uint16))] == [[0, 0, 0, 0, 4, 0], [0, 3, 0, 4, 5, 0]]


def shingles(text, n):
    w = words_of(text and text.translate(LOWER))
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else []))


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "meet"), [(3, 90, 512), (5, 80, 512), (3, 90, 1)])
def test_ngram_join_is_brute_force(spark, monkeypatch, n, percent, meet):
    monkeypatch.setattr(ngram_join, "_MEET", meet)  # 1: all meet by length class
    rng = np.random.default_rng(n)
    rows = []
    for family in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, 60 + 10 * family)]
        for copy in range(12):
            words = list(base)
            for _ in range(copy % 4):
                words[rng.integers(len(words))] = f"e{rng.integers(10**6)}"
            rows.append((len(rows) * 3, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "One two"), (1003, "one TWO"), (1004, "one two three"), (None, rows[0][1]), (1005, "x " * 300)]
    out = ngram_join.similar_documents(spark.createDataFrame(rows, SCHEMA), words=n, percent=percent).collect()
    want = brute_components(rows, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    assert [r.component_id for r in out if r.doc_id is None] == [None] and len(out) == len(rows)


def test_keep_one_keeps_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "k"), (1, text, "k"), (2, text + " more", "k"), (9, "something else entirely different here", "k"), (None, text, "k"), (9, "something else entirely different here", "k")]
    out = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, gone_id string"))
    assert out.columns == ["doc_id", "text", "gone_id"] and sorted(r.doc_id or -1 for r in out.collect()) == [-1, 1, 9]
    assert ngram_join.keep_one(out.filter("false")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


# --- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.just(40))
def test_plans_hold_all_pieces(sizes, capacity):
    counts = Counter(sizes)
    for plan in (packing.best_fit(counts, capacity), packing.make_plan(counts, capacity)):
        got = Counter()
        for pieces, n in plan:
            assert n > 0 and sum(pieces) <= capacity
            for s in pieces:
                got[s] += n
        assert got == counts


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= sizes[i] and r not in rooms[:k]:
                go(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_fixed_sequences_are_in_some_best_packing(sizes):
    fixed, left = packing.dominance_reduction(Counter(sizes), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello, wörld's ÀÉ x y", "", None, "a\x00b \x85c \x1cd\x1fe é ́x ΑΣ Σ don't 12", "tok " * 300, "same", "same", "<|endoftext|> 日本 \U0001f600"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")] + [(10 + i, "word " * (i % 60)) for i in range(150)]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), capacity=64, with_ids=True).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = {i: [*encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = defaultdict(dict)
    places = defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length <= 64 and r.start == 64 * r.piece
        got[r.doc_id][r.piece] = ids
        places[r.sequence_id].append((r.offset, r.length))
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in got.items()} == want
    for v in places.values():
        v.sort()
        assert all(o == sum(n for _, n in v[:k]) for k, (o, _) in enumerate(v)) and sum(n for _, n in v) <= 64
    assert len(places) <= 1.05 * sum(map(len, want.values())) / 64 + 2
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


# --- sharding


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "é" * int(n)) for i, n in enumerate(rng.integers(0, 200, 3000))] + [(10_000 + i, "copy " * 4) for i in range(60)] + [(None, None), (7, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, SIZE string")
    out = sharding.assign_shards(df, shards=6)
    assert out.columns == ["doc_id", "SIZE", "_size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    sums, slots = Counter(), defaultdict(list)
    for r in got:
        sums[r.shard] += r["_size"]
        slots[r.shard].append(r.slot)
    assert max(sums.values()) - min(sums.values()) <= 2 * (408 + 0.001 * sum(sums.values()) / 6) and len(sums) == 6
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    assert Counter((r.doc_id, r.text_crc32, r["_size"]) for r in got) == want
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"copy copy copy copy ")}) <= 2


def test_one_text_in_all_rows_is_cut_by_the_second_half_of_the_key(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    n = Counter(r.shard for r in sharding.assign_shards(rows, shards=8).collect())
    assert len(n) == 8 and max(n.values()) - min(n.values()) <= 2


def test_shards_of_nothing_and_more_shards_than_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert sharding.assign_shards(df.filter("false"), shards=4).count() == 0
    assert {r.slot for r in sharding.assign_shards(df, shards=24).collect()} == {0}
    assert sharding.exchange(df, shards=2).count() == 2


def test_stored_reads_back(spark):
    assert stored(spark.range(5).toDF("a b")).count() == 5
