"""Retrieval quality: rankings (query_id, rank, doc_id) against judgments (query_id, doc_id, relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _judged(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    good = qrels.where("relevance > 0").select("query_id", "doc_id", "relevance")
    return ranking.where(F.col("rank") <= k).join(good, ["query_id", "doc_id"], "left")


def precision_at_k(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision): relevant documents among the first k, over k."""
    return _judged(ranking, qrels, k).groupBy("query_id").agg((F.count("relevance") / F.lit(k)).alias("precision"))


def recall_at_k(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall) of each query that has relevant documents."""
    total = qrels.where("relevance > 0").groupBy("query_id").agg(F.countDistinct("doc_id").alias("total"))
    found = _judged(ranking, qrels, k).groupBy("query_id").agg(F.count("relevance").alias("found"))
    return total.join(found, "query_id", "left").select("query_id", (F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"))


def reciprocal_rank(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rr): one over the rank of the first relevant document, 0 if none is among the first k."""
    first = F.min(F.when(F.col("relevance").isNotNull(), F.col("rank")))
    return _judged(ranking, qrels, k).groupBy("query_id").agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def ndcg_at_k(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) with gains 2^relevance - 1 and a base-2 logarithm of rank + 1."""
    gain = lambda r, pos: (F.pow(F.lit(2.0), r) - 1) / F.log2(pos + 1.0)
    dcg = _judged(ranking, qrels, k).groupBy("query_id").agg(F.sum(F.coalesce(gain(F.col("relevance"), F.col("rank")), F.lit(0.0))).alias("dcg"))
    sums = F.expr(f"slice(reverse(array_sort(collect_list(relevance))), 1, {k})")
    ideal = qrels.where("relevance > 0").groupBy("query_id").agg(sums.alias("best")).select(
        "query_id", F.aggregate(F.transform("best", lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x).alias("idcg"))
    return dcg.join(ideal, "query_id").select("query_id", (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def mean(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.avg(column).alias(f"mean_{column}"))
