"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Texts are normalised to lower-case words joined by single spaces, with a space at either end, so that a run of words
is a plain substring.  Every item is cut into blocks of ``window // 2`` words (5 of a window of 10); any window of the
item holds one whole block.  The automaton of all blocks scans a normalised text once.  Around each block that it finds, words
are compared with the item's, and runs of ``window`` words or more are occurrences.  So the automaton has a state for
each character of the benchmark, not for each character of each window.  Hits are word numbers; :func:`scan` can map them to
character offsets in the original.

Edge cases: a null or empty text (or one without words) has no words and no hits; an item without words
has no window; items of fewer words than ``window`` are one window; repeated items each count, and one without an id counts without a name; each row of the documents
has its own result, with repeated and null doc_ids too; extra columns of either table are ignored by :func:`scan` and do not
clash; an empty table of documents gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of benchmark text that one automaton may cover (about 60 MB of memory each million); larger sets are scanned in
#: as many passes as there are such parts, with the same result.
BLOCK_BYTES = 4_000_000
WINDOW = 10

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes of UTF-8 above 0x7F are word bytes, so bytes and characters agree."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


def words_of(text: str | None) -> list[bytes]:
    return [w for w in normal_words(text) if w]


class Matcher:
    """The automaton of some items and what is needed to compare words around its hits."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        self.window, self.block = window, max(1, window // 2)
        self.numbers: dict[bytes, int] = {}  # a number for each word of the benchmark
        owners: dict[bytes, tuple[list, list]] = {}  # places of a block, and items that are this word sequence as a whole
        flat, item_of = [-1] * window, [None] * window  # words of all items, with gaps that equal no word
        for item_id, text in items:
            words = words_of(text)
            if 0 < len(words) < window:
                owners.setdefault(b" ".join(words), ([], []))[1].append(item_id)
                continue
            for at in range(0, len(words) - self.block + 1, self.block):
                owners.setdefault(b" ".join(words[at : at + self.block]), ([], []))[0].append(len(flat) + at)
            flat += [self.numbers.setdefault(w, len(self.numbers)) for w in words] + [-1] * window
            item_of += [item_id] * (len(words) + window)
        self.flat, self.item_of = np.array(flat, np.int64), np.array(item_of, object)
        self.patterns = [(len(k.split(b" ")), np.array(places, np.int64), whole) for k, (places, whole) in owners.items()]
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton()
            for n, k in enumerate(owners):
                self.automaton.add_word((b" " + k + b" ").decode("latin-1"), n)
            self.automaton.make_automaton()

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [first, last + 1) word ranges that are inside an occurrence, and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set = set()
        if self.automaton is None or not words:
            return found, items
        starts, reach = None, self.window - self.block
        for end, k in self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            if starts is None:  # offset of the space after word i, to map hits back
                starts = np.cumsum([len(w) + 1 for w in words])
            size, places, whole = self.patterns[k]
            last = int(np.searchsorted(starts, end)) + 1
            first = last - size
            if whole:
                items.update(whole)
                found.append((first, last))
            if len(places):
                near = lambda lo, hi: np.array([self.numbers.get(words[i], -2) if 0 <= i < len(words) else -2 for i in range(lo, hi)], np.int64)
                before = self.flat[places[:, None] - 1 - np.arange(reach)] == near(first - reach, first)[::-1]
                after = self.flat[places[:, None] + size + np.arange(reach)] == near(last, last + reach)
                left, right = (np.logical_and.accumulate(x, axis=1).sum(axis=1) for x in (before, after))
                enough = left + size + right >= self.window
                if enough.any():
                    items.update(self.item_of[places[enough]].tolist())
                    found += {(first - x, last + y) for x, y in zip(left[enough].tolist(), right[enough].tolist(), strict=True)}
        return merged_ranges(found), items


def merged_ranges(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Character [start, end) of each word in the original text."""
    out, start = [], -1
    for i, c in enumerate(text):
        b = ord(c)
        inside = b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A
        if inside and start < 0:
            start = i
        elif not inside and start >= 0:
            out.append((start, i))
            start = -1
    if start >= 0:
        out.append((start, len(text)))
    return out


def item_parts(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The query set in parts of about BLOCK_BYTES of text; items with equal texts may be in different ones."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-int(total) // BLOCK_BYTES) or 1
    return [rows] if parts == 1 else [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == b) for b in range(parts)]


_BUILT: dict[str, Matcher] = {}


class Shared:
    """Items of one part, collected (their size is checked) and broadcast; each Python worker builds their automaton once."""

    def __init__(self, part: DataFrame, window: int) -> None:
        items = [(r["item"], r["text"]) for r in part.collect()]
        self.key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
        self.window, self.items = window, part.sparkSession.sparkContext.broadcast(items)

    def matcher(self) -> Matcher:
        if self.key not in _BUILT:
            _BUILT.clear()
            _BUILT[self.key] = Matcher(self.items.value, self.window)
        return _BUILT[self.key]


_LISTS = pa.list_(pa.list_(pa.int64()))
_FOUND = "n_words long, ranges array<array<long>>, items array<long>, spans array<array<long>>"


def _scan_part(rows: DataFrame, shared: Shared, with_spans: bool, only_hits: bool) -> DataFrame:
    """The first column of the rows and what is found in their text, the last one; of rows with hits alone if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.matcher()
        for batch in batches:
            n_words, ranges, found, spans, kept = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                words = words_of(text)
                hit, items = matcher.match(words)
                if only_hits and not hit:
                    continue
                kept.append(i)
                n_words.append(len(words))
                ranges.append([list(x) for x in hit])
                found.append(sorted(items, key=lambda x: (x is None, x)))
                at = word_offsets(text) if with_spans and hit else []
                spans.append([[at[a][0], at[b - 1][1]] for a, b in hit] if at else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(n_words, pa.int64()), pa.array(ranges, _LISTS), pa.array(found, pa.list_(pa.int64())), pa.array(spans, _LISTS)],
                names=[batch.schema.names[0], "n_words", "ranges", "items", "spans"],
            )

    first = rows.schema[0]
    return rows.mapInArrow(run, f"{first.name} {first.dataType.simpleString()}, {_FOUND}")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array([len(words_of(t.as_py())) for t in batch.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "k", "n_words"])


def _text_key(column) -> F.Column:
    return F.sha2(F.coalesce(column.cast("string"), F.lit("")), 256)


def _hits_by_text(texts: DataFrame, parts: list[DataFrame], window: int, with_spans: bool) -> DataFrame:
    """(k, ranges, items, spans) of each distinct text (by SHA-256) with a hit, over all parts of the benchmark."""
    every = None
    for n, part in enumerate(parts):
        found = _scan_part(texts, Shared(part, window), with_spans, True).withColumn("part", F.lit(n))
        every = found if every is None else every.unionByName(found)
    once = every.groupBy("k", "part").agg(*(F.first(c).alias(c) for c in ("ranges", "items", "spans")))  # copies of a text say the same
    merged = once.groupBy("k").agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
    )
    union = lambda c: F.expr(f"""aggregate({c}, cast(array() as array<array<bigint>>), (acc, x) ->
      case when size(acc) > 0 and element_at(acc, -1)[1] >= x[0]
      then concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], x[1]))))
      else concat(acc, array(x)) end)""")  # noqa: E731
    return merged.select("k", union("r").alias("ranges"), "items", union("s").alias("spans"))


def scan(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", with_spans: bool = False,
) -> DataFrame:
    """Per document row: n_words, merged word ranges inside occurrences, item ids, and character spans if asked for.

    One pass over the documents without a shuffle where the benchmark is one part of BLOCK_BYTES (the usual case).  More
    parts are a pass each; their hits, of which there are few, meet by text and then join the rows.  Item ids are longs.
    Spans of hits of different parts that touch in words stay two where characters are between them.
    """
    parts = item_parts(benchmark, item_col, item_text_col)
    doc_id, text = F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    if len(parts) == 1:
        return _scan_part(docs.select(doc_id, text), Shared(parts[0], window), with_spans, False)
    hits = _hits_by_text(docs.select(_text_key(F.col(text_col)).alias("k"), text), parts, window, with_spans)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(doc_id, _text_key(F.col(text_col)).alias("k"), text).mapInArrow(_count_words, f"doc_id {id_type}, k string, n_words long")
    none = F.array().cast("array<array<long>>")
    return rows.join(hits, "k", "left").select("doc_id", "n_words", F.coalesce("ranges", none).alias("ranges"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("spans", none).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows (all columns) whose text holds no window of any benchmark item; map-only for one part of the benchmark."""
    parts = item_parts(benchmark, item_col, item_text_col)
    if len(parts) > 1:
        texts = docs.select(_text_key(F.col(text_col)).alias("k"), F.col(text_col).cast("string").alias("text"))
        hits = _hits_by_text(texts, parts, window, False).select("k")
        return docs.join(hits, _text_key(F.col(text_col)) == F.col("k"), "left_anti")
    schema, where = docs.schema, docs.schema.fieldNames().index(text_col)
    shared = Shared(parts[0], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.matcher()
        for batch in batches:
            yield batch.filter(pa.array([not matcher.match(words_of(t.as_py()))[0] for t in batch.column(where)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan`'s."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(scan(docs, benchmark))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM p),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN p ON dw.win = p.win AND dw.k = p.k),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
