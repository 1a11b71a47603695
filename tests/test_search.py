import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinrank.functions.fieldnorm import quantize_int
from skeinrank.functions.scoring import weight_value
from skeinrank.operators import inspect, metrics
from skeinrank.operators.index import build, load
from skeinrank.operators.registry import Registry
from skeinrank.operators.search import more_like_this, score, search, search_batch, vectors, vectors_equal
from skeinrank.streaming.ingest import SegmentStore
from skeinrank.types import Bm25Query, IndexSpec


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, content string")


def indexed(spark, texts, config="simple", **more):
    return build(frame(spark, texts), IndexSpec("i", "content", config, **more))


def rows(df):
    return [(r["doc_id"], pytest.approx(r["score"], abs=1.1e-4)) for r in df.collect()]


def test_two_documents(spark):
    i = indexed(spark, ["hello world", "goodbye cruel world"])
    assert rows(search(i, "hello")) == [(1, -0.7549)]
    assert rows(search(i, "cruel")) == [(2, -0.6407)]
    assert i.corpus_stats.first()["avgdl"] == 2.5


def test_frequency_cap_and_long_lengths(spark):
    i = indexed(spark, ["x", "word", "word " * 100, "word " * 1000, "word " + "filler " * 500])
    assert i.corpus_stats.first()["avgdl"] == pytest.approx(122.6)
    assert rows(search(i, "word")) == [(4, -0.62768), (3, -0.62660), (2, -0.48411), (5, -0.20282)]


def test_high_frequencies(spark):
    i = indexed(spark, [f"{'keyword ' * n}" for n in (1, 10, 50, 100, 200)])
    found = search(i, "keyword").collect()
    assert [r["doc_id"] for r in found] == [5, 4, 3, 2, 1]
    assert found[0]["score"] == pytest.approx(-0.188789, abs=1e-6) and found[-1]["score"] == pytest.approx(-0.145851, abs=1e-6)


def test_repeated_query_terms_count(spark):
    i = indexed(spark, ["cat cat cat", "cat dog", "dog dog dog"])
    assert rows(search(i, "cat cat")) == [(1, -1.438620), (2, -1.047097)]


def test_unicode_terms(spark):
    i = indexed(spark, ["café résumé", "naïve", "北京 beijing", "emoji 🙂 ok"])
    assert [r["doc_id"] for r in search(i, "北京").collect()] == [3]
    assert [r["doc_id"] for r in search(i, "CAFÉ").collect()] == [1]


def test_empty_texts_are_outside_the_statistics(spark):
    i = indexed(spark, ["", "   ", "\t", "\n", None, "real words here"])
    assert i.corpus_stats.first()["n"] == 1
    assert search(i, "missing").count() == 0
    empty = indexed(spark, [None])
    assert search(empty, "x").count() == 0 and empty.corpus_stats.first()["n"] == 0


def test_score_keeps_rows_that_do_not_match(spark):
    docs = frame(spark, ["hello world", "goodbye world", None])
    got = {r["doc_id"]: r["score"] for r in score(build(docs, IndexSpec("i", "content", "simple")), "hello", docs).collect()}
    assert got == {1: pytest.approx(-0.693147, abs=1e-6), 2: 0.0, 3: None}


def test_ties_go_to_the_smaller_id(spark):
    i = indexed(spark, ["same text"] * 30)
    assert [r["doc_id"] for r in search(i, "same", k=5, offset=3).collect()] == [4, 5, 6, 7, 8]


def test_tenants_have_their_own_statistics(spark):
    texts = [(1, "alpha beta", 1), (2, "alpha gamma", 1), (3, "delta beta", 1)] + [(k, "filler " * 12 + "other words", 2) for k in range(4, 104)]
    docs = spark.createDataFrame(texts, "doc_id long, content string, tenant int")
    i = build(docs, IndexSpec("i", "content", "simple", tenant_column="tenant"))
    assert rows(search(i, "alpha", tenant=1)) == [(1, -0.4700036), (2, -0.4700036)]
    assert rows(search(i, "alpha")) == [(1, -5.7280746), (2, -5.7280746)]
    assert search(i, "alpha", tenant=999).count() == 0
    assert rows(search(i, Bm25Query("alpha", tenant_id=1))) == rows(search(i, "alpha", tenant=1))


def test_english_configuration_and_language_override(spark):
    i = indexed(spark, ["The databases were running", "A cat runs"], "english")
    assert [r["doc_id"] for r in search(i, "run").collect()] == [1, 2]
    assert search(i, "running", language="simple").count() == 0


def test_two_languages_in_one_token_column(spark):
    """Documents analysed by their own language, queries by an override: known values."""
    from skeinrank.functions.analysis import analyzer

    texts = [(1, "english", "quick brown foxes jump high over fences"), (2, "english", "a fox runs fast today"), (3, "french", "Le renard brun rapide saute par-dessus le chien")]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, content string")
    tokens = F.when(F.col("lang") == "french", analyzer("french")(F.col("content"))).otherwise(analyzer("english")(F.col("content")))
    i = build(docs.select("doc_id", tokens.alias("tokens")), IndexSpec("i", "tokens"))
    assert [r["doc_id"] for r in search(i, "foxes", language="english").collect()] == [2, 1]
    assert [r["doc_id"] for r in search(i, "renards", language="french").collect()] == [3]
    assert search(i, "renards", language="simple").count() == 0


def test_token_columns(spark):
    rows_ = spark.createDataFrame([(1, ["fox", "dog"], {"fox": 2}), (2, ["cat"], {"cat": 1})], "doc_id long, tokens array<string>, counts map<string,int>")
    for column in ("tokens", "counts"):
        i = build(rows_, IndexSpec("i", column))
        assert [r["doc_id"] for r in search(i, "fox", language="simple").collect()] == [1]
    with pytest.raises(ValueError, match="text_config"):
        build(frame(spark, ["x"]), IndexSpec("i", "content"))
    with pytest.raises(ValueError, match="type"):
        build(rows_, IndexSpec("i", "doc_id", "simple"))


def brute(texts, query, k1=1.2, b=0.75):
    tf = {d: Counter({t: min(n, 255) for t, n in Counter((x or "").lower().split()).items()}) for d, x in enumerate(texts, 1)}
    dl = {d: sum(c.values()) for d, c in tf.items() if c}
    n, avg = len(dl), sum(dl.values()) / len(dl)
    out = {}
    for t, qf in Counter(query.split()).items():
        df = sum(t in c for c in tf.values())
        for d, c in tf.items():
            if t in c:
                out[d] = out.get(d, 0) + weight_value(c[t], quantize_int(dl[d]), avg, df, n, k1, b, qf)
    return sorted(((d, round(-s, 6)) for d, s in out.items()), key=lambda x: (x[1], x[0]))


def corpus(seed, n=60):
    r = random.Random(seed)
    return [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.choice((1, 3, 20, 60, 300)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    i = indexed(spark, texts)
    for q, k1, b in (("a b c", 1.2, 0.75), ("a a p", 2.0, 0.0), ("d", 0.5, 1.0)):
        want = brute(texts, q, k1, b)
        got = [(r["doc_id"], r["score"]) for r in search(i, q, k=None, k1=k1, b=b).collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(dict(want), abs=2e-6)
        assert [s for _, s in got] == sorted(s for _, s in got)


def test_batch_equals_single_searches(spark):
    i = indexed(spark, corpus(3))
    queries = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "zz")], "query_id long, query_text string")
    batch = search_batch(i, queries, 5).collect()
    for q, text in ((1, "a b"), (2, "c"), (3, "zz")):
        assert [(r["doc_id"], r["score"]) for r in sorted(batch, key=lambda r: r["rank"]) if r["query_id"] == q] == [(r["doc_id"], r["score"]) for r in search(i, text, k=5).collect()]


def test_saved_index_and_segments_score_alike(spark, tmp_path):
    texts = corpus(4)
    docs, bulk = frame(spark, texts), indexed(spark, texts)
    want = search(bulk, "a b c").collect()
    assert search(load(spark, bulk.save(str(tmp_path / "i")) and str(tmp_path / "i")), "a b c").collect() == want
    store = SegmentStore(spark, str(tmp_path / "s"), IndexSpec("i", "content", "simple"), per_level=3)
    for k in range(5):
        assert store.append(docs.where(F.col("doc_id") % 5 == k), k)
    with pytest.warns(UserWarning, match="in the store already"):
        assert store.append(docs.where(F.col("doc_id") % 5 == 0), 0) is None and len(store.segments) == 3
    assert store.append(spark.createDataFrame([(999, "")], "doc_id long, content string"), 9) is None
    assert {s["level"] for s in store.segments} == {0, 1}
    assert search(store.index(), "a b c").collect() == want
    store.compact(everything=True)
    assert len(store.segments) == 1 and search(SegmentStore(spark, str(tmp_path / "s")).index(), "a b c").collect() == want
    store.upsert(spark.createDataFrame([(1, "zebra")], "doc_id long, content string"), 20)
    assert [r["doc_id"] for r in search(store.index(), "zebra").collect()] == [1] and store.index().corpus_stats.first()["n"] == len(texts)


def test_stream_of_files(spark, tmp_path):
    texts = corpus(5, 20)
    frame(spark, texts).repartition(3).write.parquet(str(tmp_path / "in"))
    store = SegmentStore(spark, str(tmp_path / "s"), IndexSpec("i", "content", "simple"))
    source = spark.readStream.schema("doc_id long, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store.stream(source, str(tmp_path / "c")).awaitTermination(120)
    assert search(store.index(), "a b").collect() == search(indexed(spark, texts), "a b").collect()


def test_streams_with_checkpoints_of_their_own(spark, tmp_path):
    """Both start at batch 0; neither loses a document."""
    store = SegmentStore(spark, str(tmp_path / "s"), IndexSpec("i", "content", "simple"))
    for name, doc in (("a", 1), ("b", 2)):
        spark.createDataFrame([(doc, "fox")], "doc_id long, content string").write.parquet(str(tmp_path / name))
        source = spark.readStream.schema("doc_id long, content string").parquet(str(tmp_path / name))
        store.stream(source, str(tmp_path / f"c-{name}")).awaitTermination(120)
    assert sorted(r["doc_id"] for r in search(store.index(), "fox").collect()) == [1, 2]


def test_store_changes_are_whole(spark, tmp_path, monkeypatch):
    row = lambda *r: spark.createDataFrame(list(r), "doc_id long, content string")
    ids = lambda *r: spark.createDataFrame([(x,) for x in r], "doc_id long")
    path = str(tmp_path / "s")
    found = lambda word: sorted(r["doc_id"] for r in search(SegmentStore(spark, path).index(), word).collect())
    store = SegmentStore(spark, path, IndexSpec("i", "content", "simple"), per_level=4)
    store.append(row((1, "red fox"), (2, "red dog"), (None, "red cat")), 0)
    held = store.index()
    with pytest.warns(UserWarning, match="in the store already"):
        assert store.upsert(row((1, "blue")), 0) is None
    assert found("fox") == [1]  # a repeated batch doesn't delete either
    store.upsert(row((1, "blue fox"), (3, None)), 1)
    assert found("blue") == [1] and SegmentStore(spark, path).index().corpus_stats.first()["n"] == 3
    monkeypatch.setattr(store, "_save", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.upsert(row((2, "green")), 2)
    monkeypatch.undo()
    assert found("dog") == [2] and found("green") == []  # nothing of an upsert that failed is seen
    store.delete(ids(2, 99))
    store.delete(ids())
    assert [r["doc_id"] for r in search(store.index(), "red").collect()] == [None]
    store.compact(everything=True)
    assert len(store.segments) == 1 and store.segments[0]["deletes"] == [] and store.segments[0]["docs"] == 2
    assert len(search(held, "red").collect()) == 3  # a reader of the old set still has its files
    store.grace = 0.0
    assert len(store.vacuum()) >= 3 and found("blue") == [1]


def test_two_writers_keep_both_changes(spark, tmp_path):
    one = SegmentStore(spark, str(tmp_path / "s"), IndexSpec("i", "content", "simple"))
    two, save = SegmentStore(spark, str(tmp_path / "s")), one._manifest.commit
    row = lambda k: spark.createDataFrame([(k, "fox")], "doc_id long, content string")

    def late(content):
        one._manifest.commit = save
        two.append(row(2), 2)
        return save(content)

    one._manifest.commit = late
    assert one.append(row(1), 1)
    assert sorted(r["doc_id"] for r in search(one.index(), "fox").collect()) == [1, 2]


def test_deletes_frozen_and_live(spark):
    docs = frame(spark, ["hello one", "hello two", "other", "other", "other"])
    i = build(docs, IndexSpec("i", "content", "simple"))
    live = docs.where("doc_id <> 1")
    frozen = search(i, "hello", live=live).collect()
    assert [r["doc_id"] for r in frozen] == [2] and frozen[0]["score"] == search(i, "hello").where("doc_id = 2").first()["score"]
    assert i.restricted(live).corpus_stats.first()["n"] == 4


def test_registry(spark):
    registry = Registry(("public", "other"))
    docs = frame(spark, ["hello"])
    registry.create(docs, "t", IndexSpec("a", "content", "simple"))
    assert registry.explicit("a", "t", "content") is registry.explicit("public.a") is registry.implicit("t", "content")
    registry.create(docs, "t", IndexSpec("other.b", "content", "simple"))
    with pytest.warns(UserWarning, match="multiple"):
        registry.implicit("t", "content")
    for wrong, message in ((lambda: registry.explicit("nope"), "does not exist"), (lambda: registry.explicit("a", "t", "title"), "is not on column"),
                           (lambda: registry.implicit("t", "title"), "no BM25 index"), (lambda: registry.create(docs, "t", IndexSpec("a", "content", "simple")), "already exists")):
        with pytest.raises(ValueError, match=message):
            wrong()
    registry.drop("a")
    with pytest.raises(ValueError):
        registry.explicit("a")


def test_more_like_this_vectors_and_reports(spark):
    docs = frame(spark, ["red fox", "red dog", "blue cat"])
    i = build(docs, IndexSpec("i", "content", "simple"))
    assert [r["doc_id"] for r in more_like_this(i, docs, 1).collect()] == [2]
    v = vectors(i)
    pair = v.select(F.col("vector").alias("a"), "doc_id").join(v.select(F.col("vector").alias("b"), "doc_id"), "doc_id")
    assert all(r[0] for r in pair.select(vectors_equal("a", "b")).collect())
    assert inspect.summarize(i)["total_docs"] == 3 and "red df=2" in inspect.dump(i)


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 13, 1), (2, 99, 1)], "query_id long, doc_id long, relevance int")
    get = lambda df, c: {r["query_id"]: r[c] for r in df.collect()}
    assert get(metrics.precision_at_k(ranking, qrels, 2), "precision") == {1: 0.5, 2: 0.0}
    assert get(metrics.recall_at_k(ranking, qrels, 2), "recall") == {1: 0.5, 2: 0.0}
    assert get(metrics.reciprocal_rank(ranking, qrels, 2), "rr") == {1: 0.5, 2: 0.0}
    assert get(metrics.ndcg_at_k(ranking, qrels, 2), "ndcg")[1] == pytest.approx((1 / 1.58496) / (1 + 1 / 1.58496), abs=1e-4)


def test_no_limit_means_every_match(spark):
    many = spark.range(120_000).select(F.col("id").alias("doc_id"), F.lit("same words").alias("content"))
    assert search(build(many, IndexSpec("i", "content", "simple")), "same", k=None).count() == 120_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_inside_their_rows(spark):
    """No hash table of (document, term) pairs, whose size would grow with a task's texts; counts, caps and lengths by brute force."""
    texts = [*corpus(11), "a " * 255, "a " * 256, "b " * 300 + "a " * 257 + "c", "", None, "É é e"]
    i = indexed(spark, texts)
    plan = plan_of(i.postings)
    assert "HashAggregate" not in plan and plan.count("regexp_extract_all") == 1
    tf = {d: {t: min(n, 255) for t, n in Counter((x or "").lower().split()).items()} for d, x in enumerate(texts, 1)}
    dl = {d: sum(c.values()) for d, c in tf.items() if c}
    got = i.postings.collect()
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in got) == sorted((d, t, n) for d, c in tf.items() for t, n in c.items())
    assert all(r["dl_q"] == quantize_int(dl[r["doc_id"]]) for r in got)
    assert {r["doc_id"]: r["dl"] for r in i.doc_stats.collect()} == dl
    assert sorted(i.matching(["a", "é"]).collect()) == sorted(r for r in got if r["term"] in ("a", "é"))


def test_sql_function_shuffles_scores_only(spark):
    """No sort-merge join: postings stay where they are, whatever size is expected of the query's terms."""
    from skeinrank.plans.sql_surface import register

    i = indexed(spark, corpus(12))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        register(i, "shuffled")
        found = spark.sql("SELECT * FROM shuffled_search('a b c', 10)")
        assert "SortMergeJoin" not in plan_of(found)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in search(i, "a b c", k=10).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("held", [7, 200_000])
def test_batch_keeps_the_best_in_its_tasks(spark, monkeypatch, held):
    """Ties, copies and small pieces: the same ranking as by the joins that larger batches take; no scores are shuffled."""
    from dataclasses import replace

    from skeinrank.operators import batch

    calls, best = [], batch._best
    texts = [*corpus(13), *["a b c d"] * 40, "", None, "a " * 400, *corpus(14)]
    i = indexed(spark, texts)
    queries = spark.createDataFrame([(1, "a b"), (2, "c c d"), (None, "p"), (4, "zz"), (5, "")], "query_id long, query_text string")
    for name in ("CELLS", "MATCHES", "HELD"):
        monkeypatch.setattr(batch, name, held)
    monkeypatch.setattr(batch, "_best", lambda *x: calls.append(x) or best(*x))
    for k in (1, 4, 100):
        got = {tuple(r) for r in search_batch(i, queries, k).collect()}
        assert len(calls) == 1 and got == {tuple(r) for r in search_batch(replace(i, documents=None), queries, k).collect()}
        assert len(calls) == 1 and len([r for r in got if r[0] is None]) == min(k, sum("p" in (t or "") for t in texts))
        calls.clear()
    monkeypatch.setattr(batch, "MOST_RESULTS", 1)
    assert {tuple(r) for r in search_batch(i, queries, 100).collect()} == got and not calls


def test_batch_pieces_choose_alike():
    """The worker's part alone, in small pieces, with many equal scores."""
    import numpy as np
    import pyarrow as pa

    from skeinrank.operators import batch

    r = random.Random(5)
    docs = [sorted(r.choice("abcdef") for _ in range(r.choice((0, 1, 2, 4)))) for _ in range(300)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(docs, pa.list_(pa.string())), pa.array(map(len, docs), pa.int64())], names=["doc_id", "tokens", "dl_q"])
    terms = batch.Terms.of([(0, "a", 1), (0, "b", 2), (1, "c", 1), (1, "x", 1)], 2)
    (got,) = batch._best(terms, np.array([0.5, 0.7, 0.9, 0.0]), 2.0, 1.2, 0.75, 5)(iter([rows]))
    want = []
    for q, weights in enumerate(({"a": 0.5, "b": 1.4}, {"c": 0.9})):
        scores = [(-round(sum(w * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / 2)) for t, w in weights.items()), 6), i) for i, d in enumerate(docs)]
        want += [(q, i) for s, i in sorted(scores)[:5] if s < 0]
    assert set(want) <= set(zip(got["q"].to_pylist(), got["doc_id"].to_pylist(), strict=True)) and got.num_rows < 100
