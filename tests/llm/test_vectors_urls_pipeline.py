"""Vector search, url rules, the registered queries and the whole pipeline."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborel.llm import registry, topk, urls

from . import cases


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(700)]
    vectors += [(i, vectors[3][1], "x") for i in range(700, 760)]  # ties
    vectors += [(800, None, "x"), (801, [None] * 6, "x"), (802, [float("nan")] * 6, "x"), (803, [float("inf")] + [0.0] * 5, "x"), (None, [0.5] * 6, "x"), (850, [], "x"), (851, [0.5], "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, tree string")
    good = [(i, np.floor(256 * np.resize(np.array(v + [0.0] * (6 - len(v)), np.float32).astype(float), 6))) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-int(v @ q), j) for j, v in good if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]


def test_tree_skips_leaves():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(size=(20000, 3)) * 1000)
    tree = topk.Tree.from_bytes(topk.Tree(np.arange(20000), points).to_bytes())
    ids, queries, best = np.arange(20), points[:20], [[] for _ in range(20)]
    read = tree.search(ids, queries, 5, best, np.full(20, -np.inf))
    assert read < 20 * 20000 / topk.LEAF_ROWS / 2


def test_kth_scores_go_from_tree_to_tree():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(8000, 3)) * 1000)
    trees = [topk.Tree(np.arange(i, 8000, 4), points[i::4]) for i in range(4)]
    ids, queries, none = np.arange(20), points[:20], np.full(20, -np.inf)
    carried, best = 0, [[] for _ in ids]
    for tree in trees:
        carried += tree.search(ids, queries, 5, best, none)
    apart = sum(tree.search(ids, queries, 5, [[] for _ in ids], none) for tree in trees)
    assert carried < 0.9 * apart
    assert sorted(-e[1] for e in best[0]) == sorted(np.argsort(np.where(np.arange(8000) == 0, -np.inf, points @ points[0]))[-5:].tolist())


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_rounds_of_trees_give_the_same(spark, monkeypatch, share):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "TASK_TREES", 2)
    monkeypatch.setattr(topk, "QUERY_BYTES", 500)
    monkeypatch.setattr(topk, "FIRST_SHARE", share if share else 0.3)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in vectors]
    want = [(i, r + 1, j, -s) for i, q in good if i % 50 == 0 for r, (s, j) in enumerate(sorted((-int(v @ q), j) for j, v in good if j != i)[:5])]
    assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()) == sorted(want)


URLS = [
    "http://a.example.net/en/1", "http://example.net/de/", "https://EXAMPLE.com/de/x?y=/en/", "http://x.org/fr/", "http://x.org/fr", "http://org/fr/1#a", "http://notorg/fr/1",
    "net/en/", None, "", "://", "http://", "http:///x", "http://net", "http://net/", "http://a.net?x/", "http://user@b.net:80/q", "http://Ünet.NET/é", "http://xexample.net/en/", "http://..net/",
]


def plain_judgement(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("sweep", [200_000, 2])
def test_url_rules_equal_brute_force(spark, monkeypatch, sweep):
    monkeypatch.setattr(urls, "SWEEP", sweep)
    pages = [(i if i % 7 else None, u, "html") for i, u in enumerate(URLS * 2)]
    more = [("a.b.c", "/x/y/", "block"), ("c", "/x/", "allow"), ("b.c", "", "block"), ("b.c", "/x/y/z", "allow")]
    pages += [(100 + i, f"http://{h}/{p}", "") for i, (h, p) in enumerate((h, p) for h in ("c", "b.c", "a.b.c", "q.a.b.c", "zb.c") for p in ("", "x", "x/", "x/y/", "x/y/z", "x/y/zz", "y"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for rules in (urls.RULES, more, []):
        table = spark.createDataFrame([*rules, *rules[:1], (None, "/", "block"), ("c", None, "block")], "host string, path string, verdict string")
        got = Counter(tuple(r) for r in urls.judge(df, table).collect())
        assert got == Counter((i, *plain_judgement(u, rules, "allow")) for i, u, _ in pages)
    assert urls.judge(df.limit(0), table).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    want = con.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    got = registry.QUERIES[name](spark, small).toArrow()
    rows = lambda t: Counter(zip(*[t[c].to_pylist() for c in sorted(want.column_names)], strict=True))
    assert rows(got) == rows(want)


def documents(spark, small):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


@pytest.mark.parametrize("name, columns, plain", [("op3_repeated_passages", ("doc_id", "n_words", "n_removed", "kept_sha256"), cases.repeats), ("op5_ngram_jaccard", ("doc_id", "n_shingles", "component_id"), cases.jaccard)])
def test_query_equals_brute_force(spark, small, name, columns, plain):
    got = Counter(tuple(r) for r in registry.QUERIES[name](spark, small).select(*columns).collect())
    assert got == plain(documents(spark, small))


def test_every_query_covers_its_table(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op1_token_records", "op2_toxicity", "op4_fuzzy_lines", "op7_source_mix", "op9_personal_data"):
        assert registry.QUERIES[name](spark, small).count() == n, name


def test_pipeline_stages(spark, small):
    """Each stage against what it may keep, over its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mix", "token_records"]
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before, columns = docs, docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small).cache()
        assert after.columns == columns
        kept[name] = [(r.doc_id, r.text, r.source) for r in after.collect()]
        before = after
    originals = {i: t for i, t, _ in documents(spark, small)}
    assert {i for i, _, _ in kept["toxicity"]} <= set(originals)
    groups = Counter(c for (_, n, c) in cases.jaccard(kept["toxicity"]) if n)
    empty = sum(not cases.words(t) for _, t, _ in kept["toxicity"])
    assert len(kept["ngram_jaccard_join"]) == len(groups) + empty
    gone = {i for i, _, _ in kept["ngram_jaccard_join"]} - {i for i, _, _ in kept["benchmark_decontamination"]}
    leaked = {i for i, t, _ in kept["ngram_jaccard_join"] if any(b in (t or "") for b in bench)}
    assert leaked <= gone and len(gone) <= len(leaked) + 2
    size = sum(len(cases.words(t)) for _, t, _ in kept["benchmark_decontamination"])
    assert abs(sum(len(cases.words(t)) for _, t, _ in kept["source_mix"]) - 1.5 * size) <= 40
    last = stages["token_records"](spark, before, small).collect()
    assert len(last) == len(kept["source_mix"]) and corpus_pipeline.run(spark, small).count() == len(last)


def test_stages_keep_columns_that_have_their_own_names(spark, small):
    names = ["_id", "_th", "_n", "_parts", "_toxicity", "_leaks", "_ID_", "pii", "leaks", "score", "key"]
    docs = corpus_pipeline.table(spark, small, "documents").limit(120)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names if n != "_ID_"}).withColumn("_TH_", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names if n != "_ID_"), name


def test_stages_leave_clashing_columns_alone(spark, small, tmp_path):
    data = cases.rows(3)
    wide = cases.frame(spark, data).selectExpr("*", "1.5D as score", "7 as predicted", "true as held_out", "'w' as size", "'t' as taken", "'r' as rank", "'a' as a", "'b' as b")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, small)
        assert out.columns == wide.columns
        rest = [c for c in wide.columns if c not in ("doc_id", "text", "source", "n_chars")]
        assert {tuple(r) for r in out.select(*rest).collect()} == {tuple(r) for r in wide.select(*rest).collect()}, name
        assert stage(spark, wide.limit(0), small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, small).count() == len(data)
