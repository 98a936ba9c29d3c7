"""Numeric text handling (F1, F13, F14, F15). All built-in expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: text accepted as a number. Everything else becomes NULL, like a
# coercing parse (the row itself is kept). Spark's own cast alone would also
# accept forms such as ``12d`` or ``0x1p3`` and keep ``NaN``, hence the gate.
NUMERIC_TEXT_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf(inity)?)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_double(c: Column | str) -> Column:
    """text -> DOUBLE, or NULL when the text is not a plain number."""
    c = _col(c)
    return F.when(c.rlike(NUMERIC_TEXT_PATTERN), F.trim(c).try_cast("double"))


def text_to_long(c: Column | str) -> Column:
    """``int(total)`` with NULL (absent or unparsable) read as 0."""
    return F.coalesce(F.trim(_col(c)).try_cast("bigint"), F.lit(0).cast("bigint"))


def ceil_div(n: Column | str, d: int) -> Column:
    """ceiling of n / d for non-negative integers, in integer arithmetic."""
    if d <= 0:
        raise ValueError("divisor must be positive")
    up = _col(n).cast("bigint") + F.lit(d - 1)
    # exact integer division: subtract the remainder first
    return ((up - F.pmod(up, F.lit(d))) / F.lit(d)).cast("bigint")


def ceil_div_int(n: int, d: int) -> int:
    """F13 for driver-side scalars."""
    return -(-n // d)


def array_or_empty(c: Column | str) -> Column:
    """a missing list reads as an empty list (``.get("data", [])``)."""
    return F.coalesce(_col(c), F.array())
