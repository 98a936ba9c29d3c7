"""Date handling (F2-F9, L9): column expressions plus strict driver-side argument parsing."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reactorlake.errors import ValidationError

DATE_FORMAT = "yyyy-MM-dd"
PLAIN_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"

# Fixed values of the comparison chart: at most this many days per range, the
# default page when the range is unusable, the API maximum, the default span.
MAX_RANGE_DAYS = 60
DEFAULT_SERIES_LIMIT = 250
MAX_API_LIMIT = 1000
DEFAULT_SPAN_DAYS = 30

_ISO_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- driver-side scalars (P15) -------------------------------------------------


def parse_date_arg(value: str | _dt.date | None, name: str = "date") -> _dt.date | None:
    """Strict ``YYYY-MM-DD``; anything else is a ValidationError (D6: always)."""
    if value is None or value == "":
        return None
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    if not isinstance(value, str) or not _ISO_DATE.match(value):
        raise ValidationError(f"Invalid {name} format. Use YYYY-MM-DD")
    try:
        return _dt.date.fromisoformat(value)
    except ValueError as exc:
        raise ValidationError(f"Invalid {name} format. Use YYYY-MM-DD") from exc


def range_limit_value(date_from: _dt.date | None, date_to: _dt.date | None) -> int:
    """L9 for scalars: min(days in range inclusive, 60, 1000); 250 when unusable."""
    if date_from is None or date_to is None:
        return DEFAULT_SERIES_LIMIT
    days = (date_to - date_from).days + 1
    if days <= 0:
        return DEFAULT_SERIES_LIMIT
    return min(days, MAX_RANGE_DAYS, MAX_API_LIMIT)


# --- column expressions ---------------------------------------------------------


def parse_date(c: Column | str) -> Column:
    """text -> DATE, NULL when not a valid ``yyyy-MM-dd`` (``2024-1-5`` is NULL).

    Texts of that shape are cast, which gives what the format gives at a fraction of its time; the format decides about all others.
    """
    text = _col(c).cast("string")
    return F.when((F.length(text) == 10) & text.rlike(PLAIN_DATE_PATTERN), text.try_cast("date")).otherwise(F.try_to_date(_col(c), DATE_FORMAT))


def format_date(c: Column | str) -> Column:
    """DATE -> ``yyyy-MM-dd`` text."""
    return _col(c).cast("date").cast("string")


def format_month(c: Column | str) -> Column:
    """DATE -> ``yyyy-MM`` text."""
    text = format_date(c)
    return F.left(text, F.length(text) - 3)


def add_days(c: Column | str, n: int | Column) -> Column:
    """F4."""
    return F.date_add(_col(c), n if isinstance(n, Column) else F.lit(n))


def earlier(a: Column | str, b: Column | str) -> Column:
    """the earlier of two dates."""
    return F.least(_col(a), _col(b))


def inclusive_days(date_from: Column | str, date_to: Column | str) -> Column:
    """days in [from, to], both ends counted."""
    return F.datediff(_col(date_to), _col(date_from)) + F.lit(1)


def clamp_to_after_from_edit(new_from: Column | str, current_to: Column | str) -> Column:
    """``to`` after the user sets ``from``: at least ``from``, at most from+59."""
    nf, ct = _col(new_from), _col(current_to)
    return F.least(F.greatest(F.coalesce(ct, nf), nf), F.date_add(nf, MAX_RANGE_DAYS - 1))


def clamp_from_after_to_edit(new_to: Column | str, current_from: Column | str) -> Column:
    """F8: ``from`` after the user sets ``to``: at most ``to``, at least to-59."""
    nt, cf = _col(new_to), _col(current_from)
    return F.greatest(F.least(F.coalesce(cf, nt), nt), F.date_sub(nt, MAX_RANGE_DAYS - 1))


def default_range_start(as_of: Column | str | None = None) -> Column:
    """start of the default range (30 days before ``as_of``, default today)."""
    base = F.current_date() if as_of is None else _col(as_of)
    return F.date_sub(base, DEFAULT_SPAN_DAYS)


def range_limit(date_from: Column | str, date_to: Column | str) -> Column:
    """L9 as an expression over rows of ranges."""
    days = inclusive_days(date_from, date_to)
    return (
        F.when(_col(date_from).isNull() | _col(date_to).isNull(), F.lit(DEFAULT_SERIES_LIMIT))
        .when(days <= 0, F.lit(DEFAULT_SERIES_LIMIT))
        .otherwise(F.least(days, F.lit(MAX_RANGE_DAYS), F.lit(MAX_API_LIMIT)))
    )
