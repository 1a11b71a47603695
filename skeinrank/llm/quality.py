"""Quality rules with adaptive thresholds.

Four measures per document (symbols a word, share of repeated lines, share of words in repeated 3-word
windows, share of upper-case letters) go into mergeable quantile sketches per language and source.  The
sketch is a logarithmic histogram with a bounded relative error: bucket counts only add up, so partial
sketches merge in any order and the same thresholds come out however rows are dealt.  A document is
rejected where a measure passes the upper fence of its group, or fails the base rule; documents that fail it are
left out of the sketches.  The sketch of a source is merged with that of its language, and that with the whole corpus's, each at
the weight of PRIOR documents: few documents lean on the larger group, many speak for themselves, and there is no size where one
turns into the other.

Edge cases: null text, language or source are allowed (null keys form groups of their own); a text
without words has all counts 0 and fails the base rule; equal values tie and share a bucket; repeated
rows are judged alike; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .workspace import Workspace

#: Relative error of the sketch, and the least value that is told from 0.
ACCURACY, LEAST = 0.01, 1e-4
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: The fence of a measure is its group's TAIL quantile plus SPREAD times the distance from the median to it, over
#: the documents that pass the base rule, and at most that of the group's language: a source in which more than
#: 1 - TAIL are junk can't raise its own fence.  So fences hold while less than 1 - TAIL of a language is junk.
TAIL, SPREAD = 0.9, 3.0
#: Most measures are 0 in most clean documents, and a fence may be 0 too: one occurrence (a symbol, a second line, a
#: second window of 3 words, a capital) is never beyond a fence.
MEASURES = {"symbol_ratio": ("n_symbols", 1), "dup_line_ratio": ("n_dup_lines", 1), "repeat_ratio": ("n_repeat_words", 6), "upper_ratio": ("n_upper", 1)}
#: Documents that the sketch of the larger group counts as when it is merged into a group's.
PRIOR = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
_SYMBOL = at.byte_class([(ord(c), ord(c)) for c in "#*$%&|<>"])
_UPPER = at.byte_class([(0x41, 0x5A)])
_LETTER = at.byte_class([(0x41, 0x5A), (0x61, 0x7A)])
_NEWLINE = at.byte_class([(0x0A, 0x0A)])


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _again(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, hash) entry: how often it occurs, and whether it is the first (entries are in text order)."""
    keys = at.mix(hashes ^ at.mix(rows.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return counts[inverse], is_first


def measure(raw: np.ndarray, off: np.ndarray, hasher: at.WordHash) -> list[np.ndarray]:
    """COUNTS for each row of a slice."""
    n = len(off) - 1
    starts, ends, rows = at.word_spans(raw, off, at.SPACE)
    n_words = np.bincount(rows, minlength=n)
    solid = ~at.SPACE[raw]
    word_chars = _per_row(solid & ((raw & 0xC0) != 0x80), off)
    symbols, upper, letters = (_per_row(t[raw], off) for t in (_SYMBOL, _UPPER, _LETTER))

    ls, le, lr = at.word_spans(raw, off, _NEWLINE)
    total = np.concatenate(([0], np.cumsum(solid, dtype=np.int64)))
    worded = total[le] > total[ls]
    ls, le, lr = ls[worded], le[worded], lr[worded]
    _, first = _again(lr, hasher.words(raw, ls, le))
    n_lines, dup_lines = np.bincount(lr, minlength=n), np.bincount(lr[~first], minlength=n)

    covered = np.zeros(len(starts), bool)
    grams = hasher.windows(hasher.words(raw, starts, ends), 3)
    if len(grams):
        own = rows[:-2] == rows[2:]
        at_word = np.flatnonzero(own)
        times, _ = _again(rows[:-2][own], grams[own])
        hit = at_word[times > 1]
        for j in range(3):
            covered[hit + j] = True
    repeat = np.bincount(rows[covered], minlength=n)
    return [n_words, word_chars, symbols, dup_lines, repeat, n_lines, upper, letters]


def _measure_batches(keep: int, where: tuple[int, str | None]):
    """COUNTS behind the first ``keep`` columns; the text is a column, or a field of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = at.WordHash(3)
        for batch in batches:
            column = batch.column(where[0])
            raw, off = at.utf8(at.strings(column if where[1] is None else pc.struct_field(column, where[1])))
            out = [at_ for at_ in zip(*(measure(raw[off[a] : off[b]], off[a : b + 1] - off[a], hasher) for a, b in at.slices(off)), strict=True)]
            cols = [np.concatenate(x).astype(np.int64) for x in out] or [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *map(pa.array, cols)], names=[*batch.schema.names[:keep], *COUNTS])
        at.release()

    return run


def counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source"), text_col: str = "text") -> DataFrame:
    """The key columns and COUNTS of each row; map-only.  ``text_col`` may be a field of a key column that is a struct."""
    outer, _, field = text_col.partition(".")
    picked = docs.select(*(F.col(k) for k in keys), *(() if field else (F.col(text_col).cast("string").alias("__text"),)))
    schema = T.StructType([*picked.schema[: len(keys)], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return picked.mapInArrow(_measure_batches(len(keys), (keys.index(outer), field) if field else (len(keys), None)), schema)


def measures(counted: DataFrame) -> DataFrame:
    """Adds the ratios that thresholds are found for, and base_failed."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.withColumns({
        "symbol_ratio": ratio("n_symbols", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "upper_ratio": ratio("n_upper", "n_letters"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def bucket(value) -> F.Column:
    """The sketch's bucket of a value at or above 0."""
    return F.when(value <= LEAST, F.lit(-1)).otherwise(F.ceil(F.log(value / LEAST) / math.log(GAMMA)).cast("int"))


def bucket_value(b) -> F.Column:
    return F.when(b < 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(GAMMA), b) * (2 / (1 + GAMMA)))


def bucket_end(b) -> F.Column:
    """The largest value of a bucket."""
    return F.when(b < 0, F.lit(LEAST)).otherwise(F.lit(LEAST * (1 + 1e-9)) * F.pow(F.lit(GAMMA), b))


def sketch(measured: DataFrame, keys: tuple[str, ...], names: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """(keys, measure, bucket, n): a mergeable sketch of each group and measure; merge with :func:`merge`."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names)))
    return measured.select(*keys, each.alias("m")).groupBy(*keys, "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The sketch of coarser groups (or of the union of several sketches)."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def histograms(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, measure, h): a sketch in one row, at most a few thousand (bucket, n)."""
    return sketches.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("bucket", F.col("n").cast("double").alias("n")))).alias("h"))


def _total(h: str) -> str:
    return f"aggregate({h}, 0D, (a, x) -> a + x.n)"


def merged_with(own: str, parent: str) -> F.Column:
    """A histogram and its parent's at the weight of PRIOR documents; either may be null."""
    none = "cast(array() as array<struct<bucket: int, n: double>>)"
    share = f"transform(coalesce({parent}, {none}), x -> named_struct('bucket', x.bucket, 'n', x.n * {PRIOR}D / {_total(parent)}))"
    return F.expr(f"array_sort(concat(coalesce({own}, {none}), {share}))")


def fence(h: str) -> F.Column:
    """The upper fence of a histogram: its TAIL quantile plus SPREAD times the distance to it from the median."""
    # the least bucket at which the running count reaches p of all (but for the last digits of a sum)
    q = lambda p: F.expr(f"aggregate({h}, named_struct('s', 0D, 'b', cast(null as int)), (a, x) -> named_struct('s', a.s + x.n, "  # noqa: E731
                         f"'b', coalesce(a.b, case when a.s + x.n >= {p}D * {_total(h)} * (1 - 1e-12D) then x.bucket end)), a -> a.b)")  # fmt: skip
    return bucket_end(q(TAIL)) + SPREAD * (bucket_value(q(TAIL)) - bucket_value(q(0.5)))


def thresholds(measured: DataFrame) -> DataFrame:
    """Fences of each (lang, source): of its own sketch merged with its language's, but no wider than the language's, which is merged with the corpus's."""
    own = sketch(measured.where("not base_failed"), ("lang", "source"))
    by_source = histograms(own, ("lang", "source")).toDF("o_lang", "o_source", "o_measure", "oh")
    by_lang = histograms(merge(own, ("lang",)), ("lang",)).toDF("l_lang", "l_measure", "lh")
    whole = histograms(merge(own, ()), ()).toDF("w_measure", "wh")
    langs = measured.select("lang").distinct().withColumn("measure", F.explode(F.array(*map(F.lit, MEASURES))))
    langs = langs.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")), "left").join(whole, F.col("measure") == F.col("w_measure"), "left")
    langs = langs.select(F.col("lang").alias("p_lang"), F.col("measure").alias("p_measure"), merged_with("lh", "wh").alias("ph")).withColumn("p_fence", fence("ph"))
    groups = measured.select("lang", "source").distinct().withColumn("measure", F.explode(F.array(*map(F.lit, MEASURES))))
    groups = groups.join(langs, F.col("lang").eqNullSafe(F.col("p_lang")) & (F.col("measure") == F.col("p_measure")))
    same = F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source")) & (F.col("measure") == F.col("o_measure"))
    found = groups.join(by_source, same, "left").withColumn("h", merged_with("oh", "ph")).withColumn("fence", F.least(fence("h"), "p_fence"))
    return found.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*(F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{m}_fence") for m in MEASURES))


def judge(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source"), text_col: str = "text", bounded: bool = False) -> DataFrame:
    """Counts, base_failed, kept and the fences of each row, with its keys (lang and source among them).

    The texts are read once: keys and counts (a few dozen bytes a row) are written to the shared folder, sketched,
    and joined with the thresholds.  The threshold table has a row for each (lang, source).  ``bounded``: as Workspace's, for keys that are whole rows.
    """
    ws = Workspace(docs.sparkSession, "quality", bounded)
    measured = measures(ws.save(counts(docs, keys, text_col), "counts"))
    limits = ws.save(thresholds(measured), "thresholds")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    within = reduce(lambda x, y: x & y, ((F.col(m) <= F.col(f"{m}_fence")) | (F.col(c) <= once) for m, (c, once) in MEASURES.items()))
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("t_lang", "t_source")


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns.  Each row is judged by itself, also where it repeats a doc_id or has none."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "lang", "source")
    return judge(whole, ("row", "lang", "source"), f"row.{text_col}", bounded=True).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", *(f"{m}_fence" for m in MEASURES))
