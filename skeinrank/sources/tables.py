"""Reading corpora, queries and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a two-column TSV without header or quoting."""
    return spark.read.schema("doc_id long, text string").option("sep", "\t").option("quote", "").csv(path)


def queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id long, query_text string").option("sep", "\t").option("quote", "").csv(path)


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of the four-column judgment format (the second column is unused)."""
    rows = spark.read.schema("query_id long, unused string, doc_id long, relevance int").option("sep", "\t").csv(path)
    return rows.drop("unused")


def page_text(html: str) -> F.Column:
    """A page's text without scripts, styles, comments and tags, for indexing pages as they are."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def save_queries(queries: DataFrame, path: str) -> None:
    """Queries as structs (text, index, language, tenant_id) in Parquet."""
    queries.write.mode("overwrite").parquet(path)
