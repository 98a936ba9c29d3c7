"""Column expressions: every function returns a built-in Spark ``Column``."""

from reactorlake.functions.dates import (
    add_days,
    clamp_from_after_to_edit,
    clamp_to_after_from_edit,
    default_range_start,
    earlier,
    format_date,
    inclusive_days,
    parse_date,
    parse_date_arg,
    range_limit,
    range_limit_value,
)
from reactorlake.functions.labels import mw_label, percent_label, record_json
from reactorlake.functions.numbers import (
    array_or_empty,
    ceil_div,
    ceil_div_int,
    coerce_double,
    text_to_long,
)

__all__ = [
    "add_days",
    "array_or_empty",
    "ceil_div",
    "ceil_div_int",
    "clamp_from_after_to_edit",
    "clamp_to_after_from_edit",
    "coerce_double",
    "default_range_start",
    "earlier",
    "format_date",
    "inclusive_days",
    "mw_label",
    "parse_date",
    "parse_date_arg",
    "percent_label",
    "range_limit",
    "range_limit_value",
    "record_json",
    "text_to_long",
]
