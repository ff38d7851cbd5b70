"""The pipeline against a brute-force version on a small folder of tables."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from citeweave.llm import packing, quality_rules

from .test_text_operators import BLANK, LOWER, brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        words = [f"w{x}" for x in rng.integers(0, 500, 90)]
        lines = [" ".join(words[k : k + 9]) for k in range(0, 90, 9)]
        if i % 4 == 0:
            lines.insert(3, "A notice that many documents share, word for word")
        text = "\n".join(lines)
        if i % 10 == 9:
            text = " ".join(w + "###" for w in words)  # bad
        elif i % 10 == 8:
            text = rows[-1][1].replace("w1 ", "v1 ")  # a near copy
        rows.append((i, text, "en", f"s{i % 3 if i % 3 else 0}", len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 9), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, path)
        assert docs.columns == names
        docs.write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    good = {i: t for i, t, *_ in rows if t and i % 10 != 9 and not (s := quality_rules.statistics(t))[0] < 50 and 100 * s[4] <= 50 * s[0]}
    assert dict(kept[0]) == good
    held = defaultdict(set)
    for i, t in good.items():
        for line in t.split("\n"):
            held[line.strip(BLANK).translate(LOWER)].add(i)
    lined = {i: "\n".join(x for x in t.split("\n") if not (len(k := x.strip(BLANK).translate(LOWER)) >= 20 and len(held[k]) >= 3 and max(held[k]) != i)) for i, t in good.items()}
    assert dict(kept[1]) == lined
    alone = {i for i, (_, c) in brute_components(list(lined.items()), 5, 80).items() if c == i}
    assert {i for i, _ in kept[2]} == alone and len(alone) < len(lined)
    assert {i for i, _ in kept[3]} <= alone and all(lined[i] == t for i, t in kept[3])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    encode = packing._encoder("word_bpe_49k.json", 1)
    want = Counter({i: sum(len(encode(t)) // 4 for j, t in kept[3] if j == i) for i, _ in kept[3]})
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want


def test_run_gives_the_same_rows(spark, folder):
    path, _ = folder
    docs = corpus_pipeline.run(spark, path)
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and docs.count() > 50
