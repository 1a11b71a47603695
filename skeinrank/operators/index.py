"""Building the inverted index as ordinary tables.

postings(doc_id, [scopes], term, tf, dl_q)    one row for each document and term
doc_stats(doc_id, [scopes], dl, dl_q)         documents with one term at least
Term and corpus statistics are aggregates of these, over everything or within a scope (tenant, partition).

A document's terms and its length are counted inside its row, from its sorted tokens: neither texts nor (document, term)
pairs are shuffled or held in a hash table, so a task holds one document at a time, however large the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import analyzer
from ..functions.fieldnorm import quantize
from ..functions.scoring import TF_CAP
from ..types import IndexSpec

TENANT, PARTITION = "tenant_id", "partition_key"


def tokens_of(df: DataFrame, column: str, config: str | None) -> Column:
    """Tokens of a text column by analyzer, of an array as they are, of a map by their counts."""
    if column not in df.columns:
        raise ValueError(f'column "{column}" does not exist')
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.filter(F.col(column), lambda x: x.isNotNull())
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.flatten(F.transform(F.map_entries(column), lambda e: F.array_repeat(e["key"], e["value"].cast("int"))))
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        if not config:
            raise ValueError("text_config is required for a text column")
        return analyzer(config)(F.col(column))
    raise ValueError(f'column "{column}" has type {kind.simpleString()}: only text, array<string> and map<string,int> can be indexed')


#: Smaller tables (bytes, as the plan puts it) may be one row group, which only one task reads: their texts are dealt out first.
SPREAD_BYTES = 64_000_000


def _once(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once: filters and further uses of a generated column don't repeat its expression."""
    return rows.select(*(c for c in rows.columns if c != column), F.explode_outer(F.array(value)).alias(column))


def doc_length() -> Column:
    """Tokens of sorted ``tokens``, each term counted TF_CAP times at most: a token is beyond the cap if it equals the one TF_CAP places before."""
    over = F.size(F.filter(F.sequence(F.lit(TF_CAP), F.size("tokens") - 1), lambda i: F.get("tokens", i) == F.get("tokens", i - TF_CAP)))
    return F.when(F.size("tokens") <= TF_CAP, F.size("tokens")).otherwise(F.size("tokens") - over)


def _postings(rows: DataFrame, scopes: list[str]) -> DataFrame:
    """A row for each term of documents with sorted ``tokens``: runs of equal tokens."""
    first = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)))
    runs = _once(rows.where("size(tokens) > 0").select("doc_id", *scopes, "tokens", "dl_q"), "starts", first)
    tf = lambda s, j: F.least(F.coalesce(F.get("starts", j + 1), F.size("tokens")) - s, F.lit(TF_CAP))
    counted = F.transform("starts", lambda s, j: F.struct(F.get("tokens", s).alias("term"), tf(s, j).cast("int").alias("tf")))
    return runs.select("doc_id", *scopes, "dl_q", F.explode_outer(counted).alias("p")).select("doc_id", *scopes, "p.term", "p.tf", "dl_q")


@dataclass(frozen=True)
class Index:
    """Tables of an index; ``spec`` says how they were made, ``totals`` are (documents, tokens) where they are known.

    ``documents`` are doc_id, scopes, sorted tokens, dl and dl_q where texts are at hand; a stored index has none.
    """

    spec: IndexSpec
    postings: DataFrame
    doc_stats: DataFrame
    totals: tuple[int, int] | None = None
    documents: DataFrame | None = None

    @property
    def scopes(self) -> list[str]:
        return [c for c in (TENANT, PARTITION) if c in self.doc_stats.columns]

    @cached_property
    def corpus_stats(self) -> DataFrame:
        """One row: n, total_len, avgdl."""
        return self.stats_by([])

    def stats_by(self, keys: list[str]) -> DataFrame:
        total = F.coalesce(F.sum("dl"), F.lit(0)).cast("long")
        return self.doc_stats.groupBy(*keys).agg(F.count("*").alias("n"), total.alias("total_len")).withColumn(
            "avgdl", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(0.0))

    def term_stats(self, keys: list[str] | None = None, terms: DataFrame | None = None) -> DataFrame:
        """df of each term (within keys); of the given terms only if there are any."""
        rows = self.postings if terms is None else self.postings.join(terms.select("term").distinct(), "term", "left_semi")
        return rows.groupBy(*(keys or []), "term").agg(F.count("*").alias("df"))

    def matching(self, names: list[str]) -> DataFrame:
        """Postings of the given terms; of texts at hand only these terms are counted."""
        if self.documents is None:
            return self.postings.where(F.col("term").isin(names))
        return _postings(_once(self.documents.drop("dl"), "tokens", F.filter("tokens", lambda t: t.isin(names))), self.scopes)

    def only(self, keep: Callable[[DataFrame], DataFrame]) -> Index:
        """The index over those documents whose rows of its tables ``keep`` returns."""
        return replace(self, postings=keep(self.postings), doc_stats=keep(self.doc_stats), totals=None, documents=None if self.documents is None else keep(self.documents))

    def save(self, path: str) -> Index:
        """Postings sorted by term, so that a query's terms prune row groups (ranges may split a frequent term); returns the index as read back."""
        spark = self.postings.sparkSession
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.postings.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        row = Index(self.spec, self.postings, spark.read.parquet(f"{path}/doc_stats")).corpus_stats.first()
        spark.createDataFrame([(json.dumps(asdict(self.spec)), row["n"], row["total_len"])], "spec string, n long, total_len long").coalesce(1).write.mode("overwrite").json(f"{path}/index_meta")
        return load(spark, path)

    def restricted(self, live: DataFrame) -> Index:
        """The index over live documents only (statistics follow)."""
        ids = live.select(F.col(self.spec.id_column).alias("doc_id")).distinct()
        return self.only(lambda rows: rows.join(ids, "doc_id", "left_semi"))


def load(spark: SparkSession, path: str) -> Index:
    meta = spark.read.schema("spec string, n long, total_len long").json(f"{path}/index_meta").first()
    return Index(IndexSpec(**json.loads(meta["spec"])), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats"), (meta["n"], meta["total_len"]))


def analyzed(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """doc_id, scopes and tokens of each document with one term at least (nulls, empty and stop-word-only texts have none)."""
    if spec.id_column not in df.columns:
        raise ValueError(f'column "{spec.id_column}" does not exist')
    scopes = []
    if spec.tenant_column:
        if spec.tenant_column not in df.columns:
            raise ValueError(f'tenant column "{spec.tenant_column}" does not exist')
        scopes.append(F.coalesce(F.col(spec.tenant_column).cast("int"), F.lit(0)).alias(TENANT))
    if spec.partition_column:
        scopes.append(F.col(spec.partition_column).alias(PARTITION))
    tokens = tokens_of(df, spec.column, spec.text_config)
    rows = df.select(F.col(spec.id_column).alias("doc_id"), *scopes, F.col(spec.column))
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES:
        rows = rows.repartition("doc_id")
    return _once(rows, spec.column, tokens).withColumnRenamed(spec.column, "tokens").where("size(tokens) > 0")


def build(df: DataFrame, spec: IndexSpec) -> Index:
    rows = analyzed(df, spec)
    scopes = [c for c in (TENANT, PARTITION) if c in rows.columns]
    documents = _once(_once(rows, "tokens", F.sort_array("tokens")), "dl", doc_length()).withColumn("dl_q", quantize("dl"))
    return Index(spec, _postings(documents, scopes), documents.select("doc_id", *scopes, "dl", "dl_q"), documents=documents)
