"""What Python workers hold at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from skeinrank.llm import arrowtext as at
from skeinrank.llm import ngram_join, quality
from skeinrank.llm.workspace import BATCH_BYTES


def bounded(whole):
    """An operator's function that fails where a batch is larger than it should be."""

    def make(*args):
        run = whole(*args)

        def told(batch):
            if batch.num_rows > 1 and batch.nbytes > 1.5 * BATCH_BYTES:
                raise ValueError(f"a batch of {batch.nbytes} bytes")
            return batch

        return lambda batches: run(map(told, batches))

    return make


def long_rows(spark):
    text = F.concat(F.col("doc_id"), F.repeat(F.lit(" a b c d e f g"), 60_000))
    return spark.range(0, 16, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length(text).cast("long").alias("n_chars"))


def test_batches_of_the_join_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_fragment", bounded(ngram_join._fragment))
    assert {tuple(r)[2] for r in ngram_join.jaccard_components(long_rows(spark)).collect()} == {0}


def test_batches_of_the_pipelines_first_stages_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_fragment", bounded(ngram_join._fragment))
    monkeypatch.setattr(quality, "_measure_batches", bounded(quality._measure_batches))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = long_rows(spark)
    corpus_pipeline.quality_rules(spark, docs, "").count()
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_fragments_of_many_groups_hold_little():
    """One flush of n-grams, dealt to as many groups as 6 GB have."""
    r = np.random.default_rng(1)
    rows = [" ".join(map(str, r.integers(0, 10**6, 1000))) for _ in range(2200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 100)), pa.array(rows[k : k + 100])], names=["id", "text"]) for k in range(0, len(rows), 100)]
    tracemalloc.start()
    grams = sum(len(at.unpack(at.split_blobs(x)[1])) for batch in ngram_join._fragment(1200, 64, 5)(iter(batches)) for x in batch.column(1).to_pylist() if len(at.split_blobs(x)) == 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert grams == len(rows) and peak < 130e6, peak


def test_pairs_of_a_long_list_are_summed_on_the_way(monkeypatch):
    """However many pairs are held at a time, the same pairs with the same counts come out."""
    docs, sets = list(range(40)), np.arange(3, dtype=np.uint64)
    packed = pa.RecordBatch.from_arrays([pa.array(docs), pa.array([4] * 40), pa.array([3] * 40), pa.array(docs), pa.array([at.pack(sets)] * 40, pa.binary()), pa.array([at.pack_sorted(sets)] * 40, pa.binary())], names=["doc_id", "n", "prefix", "comp", "grams", "place"])
    table = pa.Table.from_batches(list(ngram_join._prefix(1)(iter([packed]))))
    calls, counted = [], ngram_join._counted
    monkeypatch.setattr(ngram_join, "_counted", lambda *x: calls.append(len(x[0])) or counted(*x))
    want = ngram_join._all_pairs()((0,), table)
    assert want.num_rows == 40 * 39 // 2 and set(want["c"].to_pylist()) == {3}
    calls.clear()
    monkeypatch.setattr(ngram_join, "HELD_PAIRS", 50)
    assert ngram_join._all_pairs()((0,), table).equals(want)
    assert min(calls) < 100 < 3 * 780 < sum(calls)


def peak_of(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_prefixes_and_frequencies_of_a_full_task_hold_little():
    """An executor has little beside its JVM: a worker's arrays stay under 80 MB in each step."""
    r = np.random.default_rng(2)
    many, n = 20_000, 100
    grams, places = at.pack(np.sort(r.integers(0, 1 << 48, n).astype(np.uint64))), at.pack_sorted(np.arange(n, dtype=np.uint64))
    names = ["doc_id", "n", "prefix", "comp", "grams", "place"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 1000)), pa.array([n] * 1000), pa.array([n] * 1000), pa.array(range(k, k + 1000)), pa.array([grams] * 1000, pa.binary()), pa.array([places] * 1000, pa.binary())], names=names) for k in range(0, many, 1000)]
    held, peak = peak_of(lambda: sum(len(at.unpack(at.split_blobs(x)[2])) for batch in ngram_join._prefix(1200)(iter(batches)) for x in batch.column(1).to_pylist()))
    assert held == many * n and peak < 80e6, peak
    rows = [" ".join(map(str, r.integers(0, 10**6, 1000))) for _ in range(2200)]
    texts = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 100)), pa.array(rows[k : k + 100])], names=["id", "text"]) for k in range(0, len(rows), 100)]
    assert peak_of(lambda: sum(batch.num_rows for batch in ngram_join._fragment(1200, 64, 5)(iter(texts))))[1] < 80e6
