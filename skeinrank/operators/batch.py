"""Ranking a batch of queries against documents whose texts are at hand.

Every task holds the batch's terms, scores its documents against all queries at once and keeps the best of each
query; so neither (document, query) scores nor postings are shuffled.  One pass counts documents and terms, one ranks.

What a task keeps are all documents that can be among the k best: scores count as rounded to ``DIGITS``, with ties to the
smaller doc_id, so whatever is within ``MARGIN`` of the k-th score stays, of equal scores the k smallest doc_ids.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import DIGITS, TF_CAP, idf_value, operator_value
from .index import Index

#: (query, term) rows and results of a batch that the driver and every task may hold; larger batches are joined like a table.
MOST_TERMS, MOST_RESULTS = 100_000, 100_000
#: Scores and (query, term, document) matches that a task computes at a time, and results that it holds before it drops those beyond the k best.
CELLS, MATCHES, HELD = 1_000_000, 1_000_000, 200_000
MARGIN = 2 * 10.0**-DIGITS
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4_000_000


@dataclass(frozen=True)
class Terms:
    """The batch: its distinct terms and, for term t, queries[first[t]:first[t + 1]] with their counts of it."""

    vocabulary: list[str]
    first: np.ndarray
    queries: np.ndarray
    counts: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[int, str, int]], size: int) -> Terms:
        vocabulary = sorted({t for _, t, _ in rows})
        number = {t: k for k, t in enumerate(vocabulary)}
        rows = sorted((number[t], q, n) for q, t, n in rows)
        t, q, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return cls(vocabulary, np.searchsorted(t, np.arange(len(vocabulary) + 1)), q, n.astype(np.float64), size)


def _found(tokens: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the vocabulary's terms in rows of sorted tokens."""
    term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    row, term = row[term >= 0], term[term >= 0]
    starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[starts], term[starts], np.minimum(np.diff(np.append(starts, len(row))), TF_CAP)


def _counted(terms: Terms):
    """Documents that hold each term (i from 0 on), all documents (-1) and their tokens (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, n, total = pa.array(terms.vocabulary), np.zeros(len(terms.vocabulary), np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_found(batch.column(0), vocabulary)[1], minlength=len(df))
            n, total = n + batch.num_rows, total + (pc.sum(batch.column(1)).as_py() or 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]), pa.int64()), pa.array(np.append(df[some], [n, total]), pa.int64())], names=["i", "c"])

    return run


def _best(terms: Terms, idf: np.ndarray, avgdl: float, k1: float, b: float, k: int):
    """(q, doc_id, raw) of what can be among each query's k best."""

    def pruned(held: list, least: np.ndarray) -> list:
        q, doc, raw = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, -raw, q))
        q, doc, raw = q[order], doc[order], raw[order]
        start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        full = start[np.diff(np.append(start, len(q))) >= k]
        least[q[full]] = np.maximum(least[q[full]], raw[full + k - 1])
        equal = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (raw[1:] != raw[:-1]))))
        place = np.arange(len(q)) - np.repeat(equal, np.diff(np.append(equal, len(q))))
        keep = (place < k) & (raw >= least[q] - MARGIN)
        return [(q[keep], doc[keep], raw[keep])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, of_term, size = pa.array(terms.vocabulary), np.diff(terms.first), terms.size
        least, held, count = np.zeros(size), [], 0
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            row, term, tf = _found(batch.column(1), vocabulary)
            length = batch.column(2).to_numpy(zero_copy_only=False)
            norm = 1 - b + b * length / avgdl if avgdl > 0 else np.ones(len(docs))
            weight = idf[term] * tf * (k1 + 1.0) / (tf + k1 * norm[row])
            bounds, upto = np.searchsorted(row, np.arange(len(docs) + 1)), np.concatenate(([0], np.cumsum(of_term[term])))
            a = 0
            while a < len(docs):
                e = int(np.searchsorted(upto[bounds], upto[bounds[a]] + MATCHES, side="right")) - 1
                e = min(max(e, a + 1), a + max(1, CELLS // size), len(docs))
                x = slice(bounds[a], bounds[e])
                each = of_term[term[x]]
                inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                at = np.repeat(terms.first[term[x]], each) + inside
                scores = np.bincount(np.repeat(row[x] - a, each) * size + terms.queries[at], np.repeat(weight[x], each) * terms.counts[at], minlength=(e - a) * size).reshape(e - a, size)
                if e - a >= k:
                    least = np.maximum(least, np.partition(scores, e - a - k, axis=0)[e - a - k])
                d, q = np.nonzero((scores > 0) & (scores >= least - MARGIN))
                held.append((q, docs[a + d], scores[d, q]))
                count += len(q)
                if count > HELD:
                    held = pruned(held, least)
                    count = 0
                a = e
        if held:
            q, doc, raw = pruned(held, least)[0]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(doc, pa.int64()), pa.array(raw, pa.float64())], names=["q", "doc_id", "raw"])

    return run


@contextlib.contextmanager
def _small_batches(spark) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ranked_batch(index: Index, terms: DataFrame, k: int, k1: float, b: float) -> DataFrame | None:
    """(query_id, rank, doc_id, score) of the k best of each query, for (query_id, term, qf); at most MOST_RESULTS rows, held by the plan.

    None where that isn't possible: without texts, with other ids than integers, or with too many terms or results.
    """
    if index.documents is None or k < 1 or not isinstance(index.documents.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return None
    rows = terms.select("query_id", "term", "qf").limit(MOST_TERMS + 1).collect()
    ids = list(dict.fromkeys(r["query_id"] for r in rows))
    if not rows or len(rows) > MOST_TERMS or k * len(ids) > MOST_RESULTS:
        return None
    spark, kind = index.postings.sparkSession, index.documents.schema["doc_id"].dataType
    number = {q: i for i, q in enumerate(ids)}
    batch = Terms.of([(number[r["query_id"]], r["term"], r["qf"]) for r in rows], len(ids))
    with _small_batches(spark):
        counts = {r["i"]: r["c"] for r in index.documents.select("tokens", F.col("dl").cast("long")).mapInArrow(_counted(batch), "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()}
        n, total = counts.get(-1, 0), counts.get(-2, 0)
        idf = np.array([idf_value(counts.get(i, 0), n) for i in range(len(batch.vocabulary))])
        docs = index.documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), "tokens", F.col("dl_q").cast("long"))
        found = docs.mapInArrow(_best(batch, idf, total / n if n else 0.0, k1, b, k), "q long, doc_id long, raw double")
        value = found.select("q", F.col("doc_id").cast(kind), F.round(operator_value(F.col("raw")), DIGITS).alias("score"))
        order = Window.partitionBy("q").orderBy("score", "doc_id")
        best = value.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "doc_id", "score").collect()
    schema = T.StructType([T.StructField("query_id", terms.schema["query_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame([(ids[r["q"]], r["rank"], r["doc_id"], r["score"]) for r in best], schema)
