"""Display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit suffixes of the display table.
MW_SUFFIX = " MW"
PERCENT_SUFFIX = "%"

# Shortest decimal text, no grouping separators, no trailing ".0"
# (1000 -> "1000", 0.1 + 0.2 -> "0.30000000000000004"). A double has at most 340
# decimals that matter; the formatter writes the shortest digits that identify it.
_PLAIN_NUMBER = "0." + "#" * 340


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mw_label(c: Column | str) -> Column:
    """plain number text + `` MW``; NULL stays NULL."""
    return F.concat(F.call_function("format_number", _col(c), F.lit(_PLAIN_NUMBER)), F.lit(MW_SUFFIX))


def percent_label(c: Column | str) -> Column:
    """two decimals + ``%`` (exact binary ties round half-even, see README)."""
    return F.concat(F.call_function("format_number", _col(c), F.lit("0.00")), F.lit(PERCENT_SUFFIX))


def record_json(*cols: str) -> Column:
    """F16: one row -> one JSON object with every key, NULLs included."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
