"""The registered queries of the retrieval engine and, for each, the same computation as SQL.

Every query indexes the table it needs with the ``simple`` analyzer and runs over all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fieldnorm import quantize_sql
from ..functions.scoring import DIGITS, TF_CAP, idf
from ..functions.stemmer import ENGLISH_STOP
from ..operators import metrics
from ..operators.index import Index, analyzed, build
from ..operators.search import literal_terms, more_like_this, ranked, score, score_postings, search, search_batch
from ..sources.tables import page_text, table
from ..types import IndexSpec
from .sql_surface import register

Query = Callable[[SparkSession, str], DataFrame]
DOCS = IndexSpec("documents_text", "text", "simple")
BY_TENANT = IndexSpec("documents_tenant", "text", "simple", tenant_column="tenant")
BY_LANG = IndexSpec("documents_lang", "text", "simple", partition_column="lang")
TENANT_SQL = "CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) + 1"

ONE, TWO = "that", "that thesea"
EIGHT = "the of and that with erth onan inre"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _tenants(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).withColumn("tenant", F.expr(TENANT_SQL))


def _index(spark: SparkSession, d: str) -> Index:
    return build(_documents(spark, d), DOCS)


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


# ---- SQL of the same computations

def corpus(source: str = "documents", id_: str = "doc_id", text: str = "text", extra: str = "", where: str = "", pattern: str = r"[\p{L}\p{N}]+", stop: str = "") -> str:
    """CTEs toks, tf, dl, st and df of a table; ``extra`` are further columns, the statistics' scope."""
    more = f", {extra}" if extra else ""
    kept = f"WHERE t NOT IN ({stop})" if stop else ""
    return rf"""
toks AS (SELECT * FROM (SELECT {id_} AS doc_id{f', {extra} AS scope' if extra else ''}, unnest(regexp_extract_all(lower({text}), '{pattern}')) AS t FROM {source} {where}) {kept}),
tf AS (SELECT doc_id{', scope' if extra else ''}, t, least(count(*), {TF_CAP}) AS tf FROM toks GROUP BY ALL),
dl0 AS (SELECT doc_id{', scope' if extra else ''}, CAST(sum(tf) AS BIGINT) AS dl FROM tf GROUP BY ALL),
dl AS (SELECT *, {quantize_sql('dl')} AS dl_q FROM dl0),
st AS (SELECT {'scope, ' if extra else ''}count(*) AS n, CAST(sum(dl) AS BIGINT) AS total_len, sum(dl) / count(*) AS avgdl FROM dl{' GROUP BY scope' if extra else ''}),
df AS (SELECT {'scope, ' if extra else ''}t, count(*) AS df FROM tf GROUP BY ALL)""".replace(more + more, more)


def literal_query(text: str) -> str:
    values = ", ".join(f"(0, '{w}')" for w in text.split())
    return f"q AS (SELECT id, t, count(*) AS qf FROM (VALUES {values}) v(id, t) GROUP BY ALL)"


def scored(k1: float = 1.2, b: float = 0.75, scope: bool = False) -> str:
    on = "df.scope = tf.scope AND " if scope else ""
    st = "JOIN st ON st.scope = tf.scope" if scope else "CROSS JOIN st"
    return f"""
sc AS (SELECT q.id, tf.doc_id{', tf.scope' if scope else ''}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1.0) / (tf + {k1} * (1 - {b} + {b} * dl_q / avgdl)) * qf) AS s
  FROM q JOIN tf ON q.t = tf.t JOIN df ON {on}df.t = tf.t JOIN dl ON dl.doc_id = tf.doc_id {st} GROUP BY ALL),
r AS (SELECT id, doc_id{', scope' if scope else ''}, round(CASE WHEN s > 0 THEN -s ELSE 0.0 END, {DIGITS}) AS score FROM sc)"""


def top(text: str, k: int | None = 10, offset: int = 0, where: str = "", join: str = "", source: str | None = None, k1: float = 1.2, b: float = 0.75) -> str:
    return f"WITH {source or corpus()}, {literal_query(text)}, {scored(k1, b)} SELECT doc_id, score FROM r {join} {where} ORDER BY score, doc_id" + (f" LIMIT {k}" if k is not None else "") + (f" OFFSET {offset}" if offset else "")


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


# ---- analysis and statistics

_add("tokenize_counts", lambda s, d: analyzed(_documents(s, d), DOCS).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms")),
     r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents) WHERE len(t) > 0")
_add("doc_lengths", lambda s, d: _index(s, d).doc_stats.select("doc_id", F.col("dl").cast("long").alias("dl")), f"WITH {corpus()} SELECT doc_id, dl FROM dl")
_add("fieldnorm_lengths", lambda s, d: _index(s, d).doc_stats.select("doc_id", F.col("dl_q").cast("long").alias("dl_q")), f"WITH {corpus()} SELECT doc_id, CAST(dl_q AS BIGINT) AS dl_q FROM dl")
_add("postings", lambda s, d: _index(s, d).postings.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl_q").cast("long").alias("dl_q")),
     f"WITH {corpus()} SELECT doc_id, t AS term, CAST(tf AS BIGINT) AS tf, CAST(dl_q AS BIGINT) AS dl_q FROM tf JOIN dl USING (doc_id)")
_add("term_df", lambda s, d: _index(s, d).term_stats(), f"WITH {corpus()} SELECT t AS term, CAST(df AS BIGINT) AS df FROM df")
_add("corpus_stats", lambda s, d: _index(s, d).corpus_stats.select("n", "total_len", F.round("avgdl", DIGITS).alias("avgdl")), f"WITH {corpus()} SELECT n, total_len, round(avgdl, {DIGITS}) AS avgdl FROM st")
_add("tenant_stats", lambda s, d: build(_tenants(s, d), BY_TENANT).stats_by(["tenant_id"]).select("tenant_id", "n", "total_len"),
     f"WITH {corpus(extra=TENANT_SQL)} SELECT scope AS tenant_id, n, total_len FROM st")
_add("tenant_term_df", lambda s, d: build(_tenants(s, d), BY_TENANT).term_stats(["tenant_id"]), f"WITH {corpus(extra=TENANT_SQL)} SELECT scope AS tenant_id, t AS term, CAST(df AS BIGINT) AS df FROM df")


def _idf_table(s: SparkSession, d: str) -> DataFrame:
    index = _index(s, d)
    n = F.broadcast(index.corpus_stats.select("n").withColumn("whole", F.lit(True)))
    rows = index.term_stats().withColumn("whole", F.lit(True)).join(n, "whole")
    return rows.select("term", F.round(idf(F.col("df"), F.col("n")), DIGITS).alias("idf"))


_add("idf_table", _idf_table, f"WITH {corpus()} SELECT t AS term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), {DIGITS}) AS idf FROM df CROSS JOIN st")
_add("idf_sum", lambda s, d: _idf_table(s, d).agg(F.round(F.sum("idf"), 2).alias("idf_sum")), f"WITH {corpus()} SELECT round(sum(round(ln(1 + (n - df + 0.5) / (df + 0.5)), {DIGITS})), 2) AS idf_sum FROM df CROSS JOIN st")

# ---- ranked search

_add("search_single_term", lambda s, d: search(_index(s, d), ONE), top(ONE))
_add("search_two_terms", lambda s, d: search(_index(s, d), TWO), top(TWO))
_add("search_eight_terms", lambda s, d: search(_index(s, d), EIGHT), top(EIGHT))
_add("search_repeated_term_qf", lambda s, d: search(_index(s, d), "that that of"), top("that that of"))
_add("search_no_match", lambda s, d: search(_index(s, d), "zzzzzz"), top("zzzzzz"))
_add("search_custom_k1_b", lambda s, d: search(_index(s, d), TWO, k1=2.0, b=0.3), top(TWO, k1=2.0, b=0.3))
_add("search_b_zero", lambda s, d: search(_index(s, d), TWO, b=0.0), top(TWO, b=0.0))
_add("search_offset", lambda s, d: search(_index(s, d), TWO, k=10, offset=5), top(TWO, offset=5))
_add("search_limit_zero", lambda s, d: search(_index(s, d), TWO, k=0), top(TWO, k=0))
_add("search_default_limit", lambda s, d: search(_index(s, d), ONE, k=1000), top(ONE, k=1000))
_add("search_unlimited", lambda s, d: search(_index(s, d), ONE, k=None), top(ONE, k=None))


def _filtered(lang: str, before: bool) -> Query:
    """Either way statistics are the whole corpus's, so filtering first or last gives the same rows."""

    def run(s: SparkSession, d: str) -> DataFrame:
        index = _index(s, d)
        ids = _documents(s, d).where(F.col("lang") == lang).select("doc_id")
        terms, names = literal_terms(index, [(0, TWO)])
        if before:
            return ranked(score_postings(index, terms, names, postings=index.matching(names).join(ids, "doc_id", "left_semi")), 10)
        return ranked(score_postings(index, terms, names).join(ids, "doc_id", "left_semi"), 10)

    return run


_IN_EN = "WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"
_add("search_prefilter_lang", _filtered("en", True), top(TWO, where=_IN_EN))
_add("search_postfilter_lang", _filtered("en", False), top(TWO, where=_IN_EN))
_add("search_threshold", lambda s, d: search(_index(s, d), TWO, k=None, threshold=-1.0), top(TWO, k=None, where="WHERE score < -1.0"))

# ---- scores of all rows

_ALL = f"WITH {corpus()}, {literal_query(TWO)}, {scored()}, a AS (SELECT d.doc_id, lang, CASE WHEN text IS NOT NULL THEN coalesce(score, 0.0) END AS score FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id)"
_add("score_all_rows", lambda s, d: score(_index(s, d), TWO, _documents(s, d)), f"{_ALL} SELECT doc_id, score FROM a")
_add("score_aggregate", lambda s, d: score(_index(s, d), TWO, _documents(s, d)).agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.min("score").alias("best")),
     f"{_ALL} SELECT count(*) AS n, round(avg(score), 5) AS mean, min(score) AS best FROM a")
_add("score_join_labels", lambda s, d: score(_index(s, d), TWO, _documents(s, d)).join(table(s, d, "labels"), "doc_id").where("quality = 1").select("doc_id", "quality", "score"),
     f"{_ALL} SELECT doc_id, quality, score FROM a JOIN labels USING (doc_id) WHERE quality = 1")
_add("score_by_language", lambda s, d: score(_index(s, d), TWO, _documents(s, d)).join(_documents(s, d).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean")),
     f"{_ALL} SELECT lang, count(*) AS n, round(avg(score), 5) AS mean FROM a GROUP BY lang")
_add("search_semi_join", lambda s, d: table(s, d, "labels").join(search(_index(s, d), TWO, k=50), "doc_id", "left_semi").select("doc_id", "quality", "toxic"),
     f"SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM ({top(TWO, k=50)}))")
_add("search_join_documents", lambda s, d: search(_index(s, d), TWO).join(_documents(s, d).select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", "score"),
     f"SELECT doc_id, lang, source, score FROM ({top(TWO)}) JOIN documents USING (doc_id)")

# ---- scopes

_SCOPED = f"WITH {corpus(extra=TENANT_SQL)}, {literal_query(TWO)}, {scored(scope=True)} SELECT doc_id, score FROM r"
_add("search_tenant", lambda s, d: search(build(_tenants(s, d), BY_TENANT), TWO, tenant=3), f"{_SCOPED} WHERE scope = 3 ORDER BY score, doc_id LIMIT 10")
_add("search_tenant_absent", lambda s, d: search(build(_tenants(s, d), BY_TENANT), TWO, tenant=999), f"{_SCOPED} WHERE scope = 999 ORDER BY score, doc_id LIMIT 10")
_add("search_tenant_zero", lambda s, d: search(build(_tenants(s, d), BY_TENANT), TWO, tenant=0), top(TWO))
_add("search_partition_local", lambda s, d: search(build(_documents(s, d), BY_LANG), TWO, partition="en"),
     f"WITH {corpus(extra='lang')}, {literal_query(TWO)}, {scored(scope=True)} SELECT doc_id, score FROM r WHERE scope = 'en' ORDER BY score, doc_id LIMIT 10")

# ---- many queries

_BENCH_Q = r"q AS (SELECT id, t, count(*) AS qf FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM benchmark) GROUP BY ALL)"


def _ranking(k: int) -> str:
    return f"WITH {corpus()}, {_BENCH_Q}, {scored()}, rk AS (SELECT id AS query_id, row_number() OVER (PARTITION BY id ORDER BY score, doc_id) AS rank, doc_id, score FROM r QUALIFY rank <= {k})"


_add("search_batch_topk", lambda s, d: search_batch(_index(s, d), _benchmark(s, d), 10).withColumn("rank", F.col("rank").cast("long")), f"{_ranking(10)} SELECT query_id, rank, doc_id, score FROM rk")
_add("benchmark_passage_lookup", lambda s, d: search_batch(_index(s, d), _benchmark(s, d), 1).select("query_id", "doc_id", "score"), f"{_ranking(1)} SELECT query_id, doc_id, score FROM rk")


def _pretokenized(s: SparkSession, d: str) -> DataFrame:
    tokens = _documents(s, d).select("doc_id", F.split(F.lower("text"), r"\s+").alias("tokens"))
    tokens = tokens.select("doc_id", F.filter("tokens", lambda t: t != "").alias("tokens"))
    return search(build(tokens, IndexSpec("tokens", "tokens")), TWO, language="simple")


_add("search_pretokenized", _pretokenized, top(TWO, source=corpus(pattern=r"[^\s]+")))
_add("more_like_this", lambda s, d: more_like_this(_index(s, d), _documents(s, d), 1),
     rf"WITH {corpus()}, q AS (SELECT 0 AS id, t, count(*) AS qf FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM documents WHERE doc_id = 1) GROUP BY ALL), {scored()} SELECT doc_id, score FROM r WHERE doc_id <> 1 ORDER BY score, doc_id LIMIT 10")
_STOP = ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOP))
_add("search_stop_words", lambda s, d: search(build(_documents(s, d), IndexSpec("stopped", "text", "english_stop")), TWO + " erth"), top("thesea erth", source=corpus(stop=_STOP)))

# ---- changes

_LIVE = "doc_id % 3 <> 0"
_add("search_after_delete_frozen", lambda s, d: search(_index(s, d), TWO, live=_documents(s, d).where(_LIVE)), top(TWO, where=f"WHERE {_LIVE}"))
_add("search_after_delete_live", lambda s, d: search(_index(s, d).restricted(_documents(s, d).where(_LIVE)), TWO), top(TWO, source=corpus(where=f"WHERE {_LIVE}")))


def _two_segments(s: SparkSession, d: str) -> DataFrame:
    """Two segments indexed apart and searched together equal one bulk index."""
    docs = _documents(s, d)
    a, b = (build(docs.where(x), DOCS) for x in ("doc_id % 2 = 0", "doc_id % 2 = 1"))
    return search(Index(DOCS, a.postings.unionByName(b.postings), a.doc_stats.unionByName(b.doc_stats), documents=a.documents.unionByName(b.documents)), TWO)


_add("search_delta_union", _two_segments, top(TWO))


def _conversations(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return search(build(turns, IndexSpec("turns", "text", "simple")), TWO)


_add("search_conversations", _conversations, top(TWO, source=corpus("conversations", "conv_id * 1000 + turn")))
_PAGE_SQL = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
_add("search_pages", lambda s, d: search(build(table(s, d, "pages").select("page_id", page_text("html").alias("text")), IndexSpec("pages", "text", "simple", id_column="page_id")), TWO),
     top(TWO, source=corpus("pages", "page_id", _PAGE_SQL)))

# ---- retrieval quality: documents that hold a benchmark item's whole text are relevant to it

_REL = "rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _qrels(s: SparkSession, d: str, ranking: DataFrame) -> DataFrame:
    """Found from the ranking's own candidates: whole-item containment is checked on rows that share all of its terms' best ranks.

    They are k for each query at most, so they go to where the documents are.
    """
    near = ranking.select("query_id", "doc_id").join(_benchmark(s, d), "query_id")
    texts = _documents(s, d).select("doc_id", "text").join(F.broadcast(near), "doc_id")
    return texts.where(F.col("text").contains(F.col("query_text"))).select("query_id", "doc_id", F.lit(1).alias("relevance"))


def _quality(kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        ranking = search_batch(_index(s, d), _benchmark(s, d), 10)
        qrels = _qrels(s, d, ranking)
        found = metrics.precision_at_k(ranking, qrels) if kind == "precision" else metrics.reciprocal_rank(ranking, qrels)
        return found.agg(F.round(F.avg("precision" if kind == "precision" else "rr"), DIGITS).alias(f"mean_{kind}"))

    return run


_add("precision_at_k", _quality("precision"),
     f"{_ranking(10)}, {_REL} SELECT round(avg(p), {DIGITS}) AS mean_precision FROM (SELECT rk.query_id, count(rel.doc_id) / 10.0 AS p FROM rk LEFT JOIN rel ON rel.query_id = rk.query_id AND rel.doc_id = rk.doc_id GROUP BY 1)")
_add("mrr_at_k", _quality("rr"),
     f"{_ranking(10)}, {_REL} SELECT round(avg(p), {DIGITS}) AS mean_rr FROM (SELECT rk.query_id, coalesce(1.0 / min(CASE WHEN rel.doc_id IS NOT NULL THEN rank END), 0) AS p FROM rk LEFT JOIN rel ON rel.query_id = rk.query_id AND rel.doc_id = rk.doc_id GROUP BY 1)")

# ---- SQL text


def _sql_function(s: SparkSession, d: str) -> DataFrame:
    register(_index(s, d), "documents")
    return s.sql("SELECT doc_id, score FROM documents_search('that thesea', 10)")


_add("search_sql_function", _sql_function, top(TWO))
