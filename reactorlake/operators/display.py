"""Display projections of the outage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reactorlake.functions.dates import format_date
from reactorlake.functions.labels import mw_label, percent_label

# The columns each table view shows, in order.
US_FIELDS = ["date", "capacity", "outage", "percent_outage"]
FACILITY_FIELDS = ["date", "facility_name", "capacity", "outage", "percent_outage"]


def _labels(df: DataFrame, fields: list[str]) -> DataFrame:
    cols = []
    for f in fields:
        if f == "date":
            cols.append(format_date("date").alias("date"))
        elif f in ("capacity", "outage"):
            cols.append(mw_label(f).alias(f))
        elif f == "percent_outage":
            cols.append(percent_label(f).alias(f))
        else:
            cols.append(F.col(f).cast("string").alias(f))
    return df.select(*cols)


def display_us(df: DataFrame) -> DataFrame:
    """National table view: date, capacity MW, outage MW, percent."""
    return _labels(df, US_FIELDS)


def display_facility(df_with_names: DataFrame) -> DataFrame:
    """Facility table view: date, facility name, capacity MW, outage MW, percent."""
    return _labels(df_with_names, FACILITY_FIELDS)
