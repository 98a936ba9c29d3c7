"""Multi-series comparison.

One scan of the fact table serves every selected facility: filter by range
and id set, keep the newest N rows per facility with a window that Spark plans
as a ``WindowGroupLimit`` (a per-task top-N before the shuffle, so a facility
holding a third of all rows still ships at most N rows per task), union the
national series, and pivot on an explicit id list (no discovery job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the national series' id.
US_SERIES = "us"


def pick_ids(ids: list[str], max_series: int | None = None) -> list[str]:
    """The picked ids without duplicates; at most ``max_series`` if given (the chart shows five)."""
    return list(dict.fromkeys(str(i) for i in ids))[:max_series]


def one_name(plants: DataFrame) -> DataFrame:
    """One name per id even if a stored dimension repeats an id (the greatest text: a stored
    dimension carries no landing order). The one rule for pages, whole tables and series."""
    return plants.groupBy("facility_id").agg(F.max("facility_name").alias("facility_name"))


def selected_plants(plants: DataFrame, ids: list[str], max_series: int | None = None) -> DataFrame:
    """Series come from the dimension's rows, so unknown ids give no series;
    label = name; order = dimension order (by id)."""
    return one_name(plants.where(F.col("facility_id").isin(pick_ids(ids, max_series))))


def newest_per_series(facts: DataFrame, n: int | None, key: str = "facility_id", rank_col: str = "series_rank") -> DataFrame:
    """The newest ``n`` rows of every series (``rank_col`` 1 = newest), all of them without ``n``."""
    w = Window.partitionBy(key).orderBy(F.col("date").desc())
    ranked = facts.withColumn(rank_col, F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col(rank_col) <= F.lit(n))


def newest_rows(df: DataFrame, n: int | None) -> DataFrame:
    """W1 for the single national series: a top-N (``TakeOrderedAndProject``)."""
    return df if n is None else df.orderBy(F.col("date").desc()).limit(n)


def long_series(facility_rows: DataFrame, us_rows: DataFrame | None) -> DataFrame:
    """``date, series, outage`` for every series (U3: the national one optional)."""
    fac = facility_rows.select("date", F.col("facility_id").alias("series"), "outage")
    if us_rows is None:
        return fac
    return fac.unionByName(us_rows.select("date", F.lit(US_SERIES).alias("series"), "outage"))


def align(long_df: DataFrame, series_ids: list[str]) -> DataFrame:
    """One row per date present in any series, one column
    per series id (NULL where a series has no point), ascending by date.

    Where a (date, series) repeats, the last record counts (by ``seq`` if the
    rows carry one; stored tables have unique keys).
    """
    order = F.col("seq") if "seq" in long_df.columns else F.col("outage")
    return long_df.groupBy("date").pivot("series", series_ids).agg(F.max_by("outage", order)).orderBy("date")


def align_all(facts: DataFrame, value: str = "outage", key: str = "facility_id") -> DataFrame:
    """J3 / A9 / F12 for any number of series: each series on a daily spine from its first to its
    last date, ``key, date, value`` (NULL on days without a row), ``gap`` (days since its last row) and ``day_no``.

    The spine is made per series from its range (a row per day, no collected ids, no column per series);
    the window runs inside a series, whose length is its number of days.
    """
    spans = facts.groupBy(key).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    spine = spans.select(key, "first", F.explode(F.sequence("first", "last")).alias("date"))
    rows = spine.join(facts.select(key, "date", F.col(value).alias(value), F.col("date").alias("_seen")), [key, "date"], "left")
    upto = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        key,
        "date",
        value,
        F.date_diff("date", F.max("_seen").over(upto)).cast("bigint").alias("gap"),
        F.date_diff("date", "first").cast("bigint").alias("day_no"),
    )


def maps_by_date(facts: DataFrame, value: str = "outage", key: str = "facility_id") -> DataFrame:
    """The same as one row per date: ``date, series`` (a map key -> value, as large as the day has series)."""
    return facts.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value)))).alias("series"))
