"""Length quantisation: lengths below 40 are exact, larger ones keep a leading 1 and three bits above 24."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = 40
BASE = 24
MAX_SHIFT = 28


def quantize_int(n: int) -> int:
    """The largest representable length that isn't above n."""
    if n < EXACT:
        return n
    shift = (n - BASE).bit_length() - 4
    return BASE + (((n - BASE) >> shift) << shift)


def quantize_sql(n: str) -> str:
    """The same as SQL text that Spark and other engines read alike: integer thresholds, no logarithm."""
    cases = " ".join(f"WHEN {n} < {BASE + (1 << (s + 4))} THEN {BASE} + (({n} - {BASE}) - ({n} - {BASE}) % {1 << s})" for s in range(1, MAX_SHIFT))
    return f"CASE WHEN {n} < {EXACT} THEN {n} {cases} ELSE {n} END"


def quantize(col: str) -> Column:
    return F.expr(f"cast({quantize_sql(f'cast({col} as bigint)')} as int)")
