"""Search from SQL text: temporary views of an index's tables and a table function over them."""

from __future__ import annotations

import re

from ..functions.analysis import WORD
from ..functions.scoring import DIGITS, MAX_TERM
from ..operators.index import Index


def register(index: Index, name: str = "bm25") -> None:
    """Views ``{name}_postings`` and ``{name}_doc_stats``, and the function ``{name}_search(q, k)`` RETURNS TABLE (doc_id, score).

    The query text is analysed like the ``simple`` configuration; k1 and b are the index's.  What depends on a query's terms
    alone is broadcast, so postings are filtered where they are and only scores are shuffled.
    """
    if re.fullmatch(r"[A-Za-z_]\w*", name) is None:
        raise ValueError(f"not a name: {name}")
    spark = index.postings.sparkSession
    index.postings.createOrReplaceTempView(f"{name}_postings")
    index.doc_stats.createOrReplaceTempView(f"{name}_doc_stats")
    k1, b = index.spec.k1, index.spec.b
    word = WORD.replace("\\", "\\\\")
    spark.sql(f"""
      CREATE OR REPLACE TEMPORARY FUNCTION {name}_search(q STRING, k INT) RETURNS TABLE (doc_id BIGINT, score DOUBLE) RETURN
      WITH terms AS (SELECT term, count(*) AS qf FROM (SELECT explode(regexp_extract_all(lower({name}_search.q), '({word})', 1)) AS term) WHERE length(term) <= {MAX_TERM} GROUP BY term),
      hits AS (SELECT /*+ BROADCAST(terms) */ p.*, qf FROM {name}_postings p JOIN terms USING (term)),
      dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
      stats AS (SELECT count(*) AS n, coalesce(sum(dl) / count(*), 0) AS avgdl FROM {name}_doc_stats),
      scored AS (
        SELECT /*+ BROADCAST(dfs, stats) */ doc_id, round(-sum(ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * ({k1}D + 1) / (tf + {k1}D * (1 - {b}D + {b}D * dl_q / avgdl)) * qf), {DIGITS}) AS score
        FROM hits JOIN dfs USING (term) JOIN stats GROUP BY doc_id),
      ranked AS (SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS r FROM scored)
      SELECT CAST(doc_id AS BIGINT), score FROM ranked WHERE r <= {name}_search.k
    """)
