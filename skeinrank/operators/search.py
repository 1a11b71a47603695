"""Ranked search and scoring as query plans.

``search`` and ``search_batch`` return documents that hold a query term, best first; ``score`` returns a value for every
row.  Ties go to the smaller doc_id.  Values are negated scores, rounded to ``DIGITS`` so that order does
not depend on the order of summation.

Postings are filtered by the query's terms before anything is shuffled; document frequencies come from the
same filtered postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import LITERAL, analyzer
from ..functions.scoring import DIGITS, idf, operator_value, term_weight
from ..types import Bm25Query
from .batch import ranked_batch
from .index import TENANT, Index

#: A caller's query of so many terms is written into the plan: its terms reach the scan of the postings, and what
#: is known of them is broadcast.  Larger ones are joined like a table of queries.
LITERAL_TERMS = 1000


def query_terms(queries: DataFrame, config: str | None, text_col: str = "query_text") -> DataFrame:
    """(query_id, term, qf): a repeated term counts as often as it is there."""
    tokens = analyzer(config)(F.col(text_col)) if config else F.split(F.col(text_col), " ")
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("int").alias("qf"))


def literal_terms(index: Index, texts: Iterable[tuple[int, str]], language: str | None = None) -> tuple[DataFrame, list[str] | None]:
    """Terms of queries that the caller holds, analysed once; and their list if they are few enough to be literals."""
    spark = index.postings.sparkSession
    config = language or index.spec.text_config or "english"
    analyzer(config)
    literal, texts = LITERAL.get(config.rpartition(".")[2]), list(texts)
    if literal is not None and all(t.isascii() for _, t in texts):
        found = [(q, t, n) for q, text in texts for t, n in Counter(literal(text)).items()]
    else:  # own analyzers, and letters whose lower case may differ between runtimes
        rows = spark.createDataFrame(texts, "query_id long, query_text string")
        found = [tuple(r) for r in query_terms(rows, config).collect()]  # the caller's own query texts
    if not found or len(found) > LITERAL_TERMS:
        return spark.createDataFrame(found, "query_id long, term string, qf int"), None if found else []
    structs = [F.struct(F.lit(q).cast("long").alias("query_id"), F.lit(t).alias("term"), F.lit(n).cast("int").alias("qf")) for q, t, n in found]
    return spark.range(1).select(F.inline(F.array(*structs))), sorted({t for _, t, _ in found})


def score_postings(index: Index, terms: DataFrame, names: list[str] | None = None, scope: list[str] | None = None, k1: float | None = None, b: float | None = None,
                   postings: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document with a query term; statistics within ``scope`` columns if given.

    ``names`` are the terms' values if they are few: then they filter the scan, and only scores are shuffled.
    ``postings`` are those to score, if not all; statistics stay the index's.
    """
    k1, b, keys = index.spec.k1 if k1 is None else k1, index.spec.b if b is None else b, scope or []
    side = F.broadcast if names is not None else lambda df: df

    def with_terms(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("term").isin(names)) if names is not None else rows.join(terms.select("term").distinct(), "term", "left_semi")

    matching = with_terms(index.postings) if names is None else index.matching(names)
    rows = matching if postings is None else with_terms(postings)
    df = matching.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    if keys:
        df = df.join(index.stats_by(keys), keys)
    elif index.totals is not None:
        n, total = index.totals
        df = df.withColumns({"n": F.lit(n), "avgdl": F.lit(total / n if n else 0.0)})
    else:  # one row of statistics for all terms
        df = df.withColumn("whole", F.lit(True)).join(F.broadcast(index.corpus_stats.withColumn("whole", F.lit(True))), "whole")
    weighted = df.select(*keys, "term", idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")
    if not keys:
        weighted = side(weighted)
    weight = term_weight(F.col("idf"), F.col("tf"), F.col("dl_q"), F.col("avgdl"), k1, b, F.col("qf"))
    return rows.join(weighted, [*keys, "term"]).join(side(terms), "term").groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def ranked(scored: DataFrame, k: int | None, offset: int = 0) -> DataFrame:
    """(doc_id, score) of one query, best first; all of them where k is None."""
    value = F.round(operator_value(F.col("score")), DIGITS)
    rows = scored.select("doc_id", value.alias("score")).orderBy("score", "doc_id")
    if offset:
        rows = rows.offset(offset)
    return rows if k is None else rows.limit(k)


def search(index: Index, query: str | Bm25Query, k: int | None = 10, offset: int = 0, tenant: int | None = None, partition=None, language: str | None = None,
           k1: float | None = None, b: float | None = None, threshold: float | None = None, live: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of the k best documents that hold a query term.

    ``tenant`` (other than 0) ranks within that tenant by its own statistics; ``partition`` within one partition key;
    ``live`` keeps documents that are still in the given table while statistics stay as indexed.
    """
    q = query if isinstance(query, Bm25Query) else Bm25Query(query)
    tenant = tenant if tenant is not None else q.tenant_id
    scoped, scope = index, []
    if tenant:
        if TENANT not in index.doc_stats.columns:
            raise ValueError("the index has no tenant column")
        scoped, scope = _within(index, TENANT, tenant), [TENANT]
    if partition is not None:
        scoped, scope = _within(scoped, "partition_key", partition), [*scope, "partition_key"]
    scored = score_postings(scoped, *literal_terms(index, [(0, q.text)], language or q.language), scope, k1, b)
    if live is not None:
        scored = scored.join(live.select(F.col(index.spec.id_column).alias("doc_id")).distinct(), "doc_id", "left_semi")
    if threshold is not None:
        scored = scored.where(F.round(operator_value(F.col("score")), DIGITS) < threshold)
    return ranked(scored, k, offset)


def _within(index: Index, column: str, value) -> Index:
    return index.only(lambda rows: rows.where(F.col(column) == value))


def search_batch(index: Index, queries: DataFrame, k: int = 10, language: str | None = None, scope: list[str] | None = None, k1: float | None = None, b: float | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of each query (query_id, query_text), all queries together.

    Where texts are at hand and the batch isn't too large for a task, it is ranked at once, by :mod:`.batch`.
    """
    terms = query_terms(queries, language or index.spec.text_config or "english")
    if not scope and (found := ranked_batch(index, terms, k, index.spec.k1 if k1 is None else k1, index.spec.b if b is None else b)) is not None:
        return found
    scored = score_postings(index, terms, None, scope, k1, b).withColumn("score", F.round(operator_value(F.col("score")), DIGITS))
    order = Window.partitionBy("query_id").orderBy("score", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def score(index: Index, query: str | Bm25Query, docs: DataFrame | None = None, language: str | None = None, k1: float | None = None, b: float | None = None) -> DataFrame:
    """(doc_id, score) of every document row; 0 where nothing matches, null where the indexed column is null.

    Statistics are the whole index's, whatever tenant the query names.
    """
    q = query if isinstance(query, Bm25Query) else Bm25Query(query)
    scored = score_postings(index, *literal_terms(index, [(0, q.text)], language or q.language), None, k1, b).select("doc_id", "score")
    if docs is None:
        return index.doc_stats.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.round(operator_value(F.coalesce("score", F.lit(0.0))), DIGITS).alias("score"))
    rows = docs.select(F.col(index.spec.id_column).alias("doc_id"), F.col(index.spec.column).isNull().alias("absent"))
    value = F.round(operator_value(F.coalesce("score", F.lit(0.0))), DIGITS)
    return rows.join(scored, "doc_id", "left").select("doc_id", F.when(~F.col("absent"), value).alias("score"))


def more_like_this(index: Index, docs: DataFrame, doc_id: int, k: int = 10, include_self: bool = False) -> DataFrame:
    """Search with a document's own text; the document itself is left out unless asked for."""
    row = docs.where(F.col(index.spec.id_column) == doc_id).select(index.spec.column).first()
    if row is None or row[0] is None:
        return index.doc_stats.where("false").select("doc_id", F.lit(0.0).alias("score"))
    found = score_postings(index, *literal_terms(index, [(0, row[0])]))
    return ranked(found if include_self else found.where(F.col("doc_id") != doc_id), k)


def vectors(index: Index) -> DataFrame:
    """(doc_id, vector): each document as a struct of the index name and its term frequencies."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "tf"))))
    return index.postings.groupBy("doc_id").agg(entries.alias("entries")).select("doc_id", F.struct(F.lit(index.spec.name).alias("index"), "entries").alias("vector"))


def vectors_equal(a: str | Column, b: str | Column) -> Column:
    """Equality of two vector structs: same index, same entries in any order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    sort = lambda v: F.array_sort(F.map_entries(v["entries"]))
    return (a["index"] == b["index"]) & (sort(a) == sort(b))
