"""Compare series by date (the chart's data, as one Spark job).

The reference asks for the national series and one request per selected
facility, then lines them up client side. Here one scan of the facts serves
all selected facilities, the newest N rows per series come from a window
group limit, and a pivot on the explicit id list lines them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reactorlake.errors import ValidationError
from reactorlake.functions.dates import format_date, parse_date_arg, range_limit_value
from reactorlake.operators import series as SR
from reactorlake.operators.read import filter_date_range
from reactorlake.plans.service import Catalog


def _range(date_from, date_to):
    """Dates of a chart request; an inverted range is rejected like any read."""
    d_from, d_to = parse_date_arg(date_from, "date_from"), parse_date_arg(date_to, "date_to")
    if d_from is not None and d_to is not None and d_from > d_to:
        raise ValidationError("the range ends before it starts: date_from is after date_to")
    return d_from, d_to


def series_ids(catalog: Catalog, ids: list[str], max_series: int | None = None) -> list[tuple[str, str]]:
    """(id, label) of the selected series in dimension order. As many rows as
    ids were picked reach the driver; they fix the pivot's columns."""
    rows = SR.selected_plants(catalog.load("plants"), ids, max_series).orderBy("facility_id").collect()
    return [(r["facility_id"], r["facility_name"]) for r in rows]


def series_labels(catalog: Catalog, ids: list[str], max_series: int | None = None) -> DataFrame:
    """``facility_id, label, series_no`` of the series that ``compare_series`` shows, in its column order."""
    picked = SR.selected_plants(catalog.load("plants"), ids, max_series)
    number = F.row_number().over(Window.orderBy("facility_id"))  # over the picked ids only
    return picked.select("facility_id", F.col("facility_name").alias("label"), number.cast("bigint").alias("series_no"))


def latest_series(catalog: Catalog, ids: list[str], date_from=None, date_to=None, newest: int | None = None, max_series: int | None = None) -> DataFrame:
    """P13 + J6 + W1: the points of every selected facility in the range, labelled
    with the plant name (long form); the ``newest`` ones only if a number is given."""
    d_from, d_to = _range(date_from, date_to)
    picked = SR.selected_plants(catalog.load("plants"), ids, max_series)
    facts = filter_date_range(catalog.load("facility", d_from, d_to), d_from, d_to).where(
        F.col("facility_id").isin(SR.pick_ids(ids, max_series))
    )
    ranked = SR.newest_per_series(facts, newest)
    return ranked.join(F.broadcast(picked), "facility_id").select(
        "facility_id",
        "facility_name",
        format_date("date").alias("date"),
        "outage",
        F.col("series_rank").cast("bigint").alias("series_rank"),
    )


def chart_limit(date_from=None, date_to=None) -> int:
    """The number of points the chart asks for per series."""
    return range_limit_value(*_range(date_from, date_to))


def compare_series(
    catalog: Catalog, ids: list[str], date_from=None, date_to=None, include_us: bool = True, newest: int | None = None, max_series: int | None = None, labelled: bool = False
) -> DataFrame:
    """``date, [us,] <facility ids...>, date_rank`` ascending by date,
    over the whole range unless ``newest`` limits the points per series. ``labelled`` names the
    columns after the plants (an id whose name repeats, or is missing, keeps its id)."""
    d_from, d_to = _range(date_from, date_to)
    named = series_ids(catalog, ids, max_series)
    chosen = [i for i, _ in named]
    facts = filter_date_range(catalog.load("facility", d_from, d_to), d_from, d_to).where(F.col("facility_id").isin(chosen))
    fac_rows = SR.newest_per_series(facts, newest)
    us_rows = SR.newest_rows(filter_date_range(catalog.load("us", d_from, d_to), d_from, d_to), newest) if include_us else None
    columns = ([SR.US_SERIES] if include_us else []) + chosen
    aligned = SR.align(SR.long_series(fac_rows, us_rows), columns)
    texts = [n for _, n in named]
    label = {i: n if labelled and n and texts.count(n) == 1 else i for i, n in named}
    # one row per date of the range: the rank runs over the aligned dates only
    rank = F.row_number().over(Window.orderBy("date")).cast("bigint").alias("date_rank")
    return aligned.select(format_date("date").alias("date"), *[F.col(f"`{c}`").alias(label.get(c, c)) for c in columns], rank).orderBy("date_rank")
