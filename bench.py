"""Headline timings as one JSON line: index build, a batch of searches, warm single searches.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from skeinrank.operators.index import build, load  # noqa: E402
from skeinrank.operators.search import score, search, search_batch  # noqa: E402
from skeinrank.types import IndexSpec  # noqa: E402


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="skein-bench-")
    times: dict[str, float] = {}

    def timed(name: str, run) -> object:
        began = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        spec = IndexSpec("bench", "text", "simple")
        timed("build_cold", lambda: build(docs.limit(200), spec).save(f"{work}/small"))
        timed("index_build", lambda: build(docs, spec).save(f"{work}/index"))
        index = load(spark, f"{work}/index")
        timed("index_cache", lambda: (index.postings.cache().count(), index.doc_stats.cache().count()))
        index.corpus_stats.collect()
        # 800 queries in eight buckets of 1 to 8 terms, from the documents' own words
        words = docs.select("doc_id", F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.length(w) > 3).alias("w")).where("size(w) >= 8").orderBy("doc_id").limit(800)
        queries = words.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice("w", 1, (F.col("doc_id") % 8 + 1).cast("int")), " ").alias("query_text")).cache()
        n = queries.count()
        timed("search_batch_800", lambda: search_batch(index, queries, 10).count())
        sample = [r["query_text"] for r in queries.orderBy("query_id").limit(8).collect()]
        search(index, sample[0]).collect()
        for text in sample:
            timed(f"search_{len(text.split())}_terms_warm", lambda text=text: search(index, text).collect())
        timed("score_all_rows", lambda: score(index, sample[1], docs).count())
        total = round(sum(v for k, v in times.items() if k not in ("build_cold", "index_cache")), 3)
        print(json.dumps({"metric": "index_build_and_search", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "batch_queries": n,
                          "documents_per_sec": round(docs.count() / times["index_build"], 1), "batch_queries_per_sec": round(n / times["search_batch_800"], 1)}))
    finally:
        shutil.rmtree(work, ignore_errors=True)
        spark.stop()


if __name__ == "__main__":
    main()
