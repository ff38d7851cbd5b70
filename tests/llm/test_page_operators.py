"""HTML extraction, nearest neighbours, URL filters, mixing and the pipeline against brute force on small tables."""

import math
from collections import Counter

import numpy as np
import pytest

from citeweave.llm import ann, html_extract, mixing, url_filters

TREE = html_extract.grow_tree(*html_extract.labelled_table())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>Head</h1><p>One  two&nbsp;&amp;\n three<br>four</p><p>Ok.</p></article><footer>&copy; x</footer>", "Head\nOne two & three four\nOk."),
        ("<article><p>Body text</p><div class='ad'>Buy now</div><p>more</p><aside>side</aside><section id=comments><article class=comment>nice post</article></section></article>", "Body text\nmore"),
        ("<script>var t='</p><article>no</article>';</script><style>p{}</style><article><p>a<b>b</b>c &lt;d&gt; 1 < 2</p></article>", "abc <d> 1 < 2"),
        ("<div class=cookie-notice><p>We use cookies on this site for many reasons and more words</p></div><main><p><b>never closed<p>next</main>", "never closed\nnext"),
        ("<article><form><label>Name</label><input value='x > y'><textarea>t</textarea></form><p title='a > b'>kept</p><!-- <p>gone</p> --></article>", "kept"),
        ("<article><table><tr><td>a</td><td>b</td></tr></table><pre> x\n  y </pre></article>", "a\nb\nx y"),
        ("<article><p>tail without end", "tail without end"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html, TREE) == text


def test_tree_learns_its_table_and_works_without_articles():
    x, y = html_extract.labelled_table()
    assert (html_extract.classify(TREE, x) == y.astype(bool)).mean() > 0.99
    long = " ".join(["word"] * 50)
    page = f"<div><a href=/>Home</a> <a href=/b>About us</a></div><div><p>{long}</p><p>{long}</p></div><div><a href=/c>Next story here</a></div>"
    assert html_extract.main_text(page, TREE) == f"{long}\n{long}"


def test_counts_of_words_and_links_carry_the_decision():
    x, y = html_extract.labelled_table()
    sizes = [len(p) for p in html_extract.PAGES]
    pages = np.repeat(np.arange(len(sizes)), sizes)

    def accuracy(columns):  # each page judged by a tree that hasn't seen it
        right = 0
        for page in range(len(sizes)):
            own = pages == page
            tree = html_extract.grow_tree(x[~own][:, columns], y[~own])
            right += (html_extract.classify(tree, x[own][:, columns]) == y[own].astype(bool)).sum()
        return right / len(y)

    counts, hints = list(range(6)), list(range(6, 9))
    assert accuracy(counts + hints) > max(accuracy(counts), accuracy(hints)) + 0.05
    assert html_extract.FEATURES[TREE[0]] == "links"  # the first split
    bare = y[(x[:, 6] == 0) & (x[:, 7] == 0)]
    got = html_extract.classify(TREE, x[(x[:, 6] == 0) & (x[:, 7] == 0)])
    assert 0.3 < bare.mean() < 0.7 and (got == bare.astype(bool)).all()  # blocks without hints


def test_a_very_long_page_and_many_blocks():
    text = "word " * 200_000
    assert html_extract.main_text(f"<article><p>{text}</p></article>", TREE) == text.strip()
    page = "".join(f"<p>{'some running text here ' * 6}{i}</p>" for i in range(5000))
    assert len(html_extract.main_text(f"<body>{page}</body>", TREE).split("\n")) == 5000


def test_pages(spark):
    rows = [(1, "u", "<article><p>é😀</p></article>", "x"), (1, "u", "<article><p>é😀</p></article>", "x"), (None, None, None, None)]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and Counter(map(tuple, out.collect())) == {(1, "u", "é😀", 2): 2, (None, None, "", 0): 1}
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- nearest neighbours


def brute(rows, k, every):
    rows = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in rows:
        if q % every == 0:
            near = sorted((-float((rows[q] * v).sum()), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
            out[q] = near[:k]
    return out


def test_nearest_is_nearly_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 32))
    rows = [(i, (centres[i % 8] + rng.normal(size=32)).tolist()) for i in range(1500)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rerank=60).collect()
    exact = brute([(i, np.array(v, np.float32)) for i, v in rows], 20, 20)
    found = Counter()
    for r in out:
        found[r.query_id] += (-r.score, r.vec_id) in [(pytest.approx(s, abs=1e-9), i) for s, i in exact[r.query_id]]
    assert len(out) == 20 * len(exact) and sum(found.values()) >= 0.95 * len(out)


@pytest.mark.parametrize("jitter", [0.05, 0.005, 1e-6])
def test_nearest_finds_all_in_a_group_of_near_copies(spark, jitter):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2400, 64))
    x[::3] = x[0] + jitter * rng.normal(size=(800, 64))  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=60).collect()}
    assert got == {(q, n): i for q, near in brute(rows, 20, 60).items() for n, (_, i) in enumerate(near, 1)}


def test_nearest_with_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(100, [3.0, 3.0, 3.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, [1.0, None, 1.0]), (104, [float("nan"), 1.0, 1.0])]
    rows += [(105, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (106, []), (0, [1.0, 2.0, 3.0]), (120, [1.0, 1.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [100, 1, 2, 3, 4], 20: [100, 0, 1, 2, 3], 40: [100, 0, 1, 2, 3], 60: [100, 0, 1, 2, 3], 80: [100, 0, 1, 2, 3], 100: [0, 1, 2, 3, 4]}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_anisotropic_codes_keep_inner_products_better():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aware = ann.Quantiser.fit(x, threshold=0.6)
    plain = ann.Quantiser.fit(x, threshold=0.0)
    error = [abs((q.scan(x[i : i + 1], q.packed(x[i : i + 1]))[0, 0]) - 1) for q in (aware, plain) for i in range(200)]
    assert sum(error[:200]) < sum(error[200:])  # of a vector with itself: the residual along it


# --- URL filters

ENTRIES = [
    ("spam", False, "host", "Bad.example", "add", 100), ("spam", False, "host", "bad.example", "remove", 200), ("spam", False, "host", "bad.example", "add", 300),
    ("ok", True, "host", "good.bad.example", "add", 150), ("path", False, "prefix", "x.org/a/", "add", 0), ("spam", False, "host", None, "add", 0), ("spam", False, "host", "y.org", "add", None),
]
CAPTURES = [
    ("http://bad.example/p", 99), ("http://bad.example/p", 100), ("https://WWW.Bad.Example:8080/p?q", 199), ("http://bad.example/", 200), ("http://bad.example/", 300),
    ("http://good.bad.example/", 120), ("http://good.bad.example/", 310), ("http://notbad.example/", 150), ("http://x.org/a", 5), ("http://x.org/ab", 5), ("http://x.org/a/b/c#d", 5),
    ("http://bad.example/p", None), (None, 150), ("nonsense", 150), ("http://bad.example/p", 100),
]
KEPT = [True, False, False, True, False, False, True, True, False, True, False, True, True, True, False]


@pytest.mark.parametrize("most", [0, 100])
def test_captures_meet_the_entries_of_their_time(spark, most):
    entries = spark.createDataFrame(ENTRIES, "list string, allows boolean, kind string, pattern string, action string, dated long")
    captures = spark.createDataFrame([(k, *c, "own") for k, c in enumerate(CAPTURES)], "k int, url string, fetched_at long, list string")
    out = url_filters.filter_urls(captures, entries, broadcast_rows=most)
    assert out.columns == ["k", "url", "fetched_at", "list", "kept", "_list", "pattern", "n_matches"]
    rows = sorted(out.collect(), key=lambda r: r.k)
    assert [r.kept for r in rows] == KEPT
    assert url_filters.filter_urls(captures, entries.filter("false"), broadcast_rows=most).filter("not kept").count() == 0
    assert url_filters.filter_urls(captures.filter("false"), entries, broadcast_rows=most).count() == 0


# --- mixing


def test_counts_follow_the_target_rates(spark):
    rows = [(i, "a" if i < 3000 else "b" if i < 4000 else None, "t") for i in range(4200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, copy string")
    out = mixing.mix_sources(df, weights={"a": 1.0, "b": 3.0})
    assert out.columns == ["doc_id", "source", "copy", "_copy", "shuffle_key"]
    n = Counter(r.source for r in out.collect())
    assert set(n) == {"a", "b"} and abs(n["a"] - 1050) < 5 * math.sqrt(1050) and abs(n["b"] - 3150) < 5 * math.sqrt(3150)
    again = mixing.mix_sources(df.repartition(7), weights={"a": 1.0, "b": 3.0})
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    assert mixing.mix_sources(df.filter("false")).count() == 0 and None in {r.source for r in mixing.mix_sources(df).collect()}


def test_many_sources_join_by_salt(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(300)], "doc_id long, source string")
    want = sorted(map(str, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == want


def test_cdf_of_small_and_large_rates(spark):
    from pyspark.sql import functions as F

    for rate in (0.3, 900.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        k = int(rate)
        want = sum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(k + 1))
        assert cdf[k] == pytest.approx(want, rel=1e-9) and cdf[-1] == pytest.approx(1, abs=1e-9)
