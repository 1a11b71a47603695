"""Reports about an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from .index import Index


def summarize(index: Index) -> dict:
    """Specification, corpus statistics, distinct terms and postings."""
    stats = index.corpus_stats.first()
    counts = index.postings.agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms")).first()
    spec = index.spec
    return {
        "name": spec.name, "column": spec.column, "text_config": spec.text_config, "k1": spec.k1, "b": spec.b, "tenant_column": spec.tenant_column,
        "total_docs": stats["n"], "total_len": stats["total_len"], "avg_doc_length": stats["avgdl"], "terms": counts["terms"], "postings": counts["postings"],
    }


def summary_text(index: Index) -> str:
    return "\n".join(f"{k}: {v}" for k, v in summarize(index).items())


def dump(index: Index, path: str | None = None, terms: int | None = 20) -> str:
    """Terms in order with their df and postings; the first ``terms`` only, or all of them into Parquet at a path.

    A full dump stays distributed; the text form is for the eye and always short.
    """
    rows = index.postings.groupBy("term").agg(F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
    if path is not None:
        rows.orderBy("term").write.mode("overwrite").parquet(path)
    shown = rows.orderBy("term").limit(terms or 20).collect()
    lines = [f"{r['term']} df={r['df']} [" + ", ".join(f"{p['doc_id']}:{p['tf']}" for p in r["postings"][:10]) + ("..." if r["df"] > 10 else "") + "]" for r in shown]
    return "\n".join([summary_text(index), *lines])
