"""BM25 as column expressions and, for tests, as plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TF_CAP = 255
MAX_TERM = 2047
DIGITS = 6


def idf(df: Column, n: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)): above 0 for every df up to N."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float, qf: Column) -> Column:
    """The part of a score that one query term adds; without lengths (avgdl 0) the denominator is tf + k1."""
    norm = F.when(avgdl > 0, 1 - b + b * dl / avgdl).otherwise(1.0)
    return idf_ * tf * (k1 + 1.0) / (tf + k1 * norm) * qf


def operator_value(score: Column) -> Column:
    """The value that sorts best first: the negated score, or 0 (never -0) where nothing matches."""
    return F.when(score > 0, -score).otherwise(0.0)


def idf_value(df: int, n: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def weight_value(tf: int, dl: int, avgdl: float, df: int, n: int, k1: float = 1.2, b: float = 0.75, qf: int = 1) -> float:
    norm = 1 - b + b * dl / avgdl if avgdl > 0 else 1.0
    return idf_value(df, n) * tf * (k1 + 1) / (tf + k1 * norm) * qf
