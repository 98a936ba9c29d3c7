"""The read path: filters, total order, paging, name join, counts.

Filters sit directly on the scan so Catalyst pushes them into the parquet
reader. A page of dated rows is located by counts per date, whatever its depth:
only the dates that it overlaps are scanned for rows, and sorting starts there.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reactorlake.errors import ValidationError
from reactorlake.operators.series import one_name
from reactorlake.schemas import Dataset


def filter_date_from(df: DataFrame, date_from: _dt.date | None) -> DataFrame:
    """Inclusive lower bound; a table without ``date`` is returned unchanged."""
    if date_from is None or "date" not in df.columns:
        return df
    return df.where(F.col("date") >= F.lit(date_from))


def filter_date_to(df: DataFrame, date_to: _dt.date | None) -> DataFrame:
    """Inclusive upper bound, same skip rule."""
    if date_to is None or "date" not in df.columns:
        return df
    return df.where(F.col("date") <= F.lit(date_to))


def filter_date_range(df: DataFrame, date_from: _dt.date | None, date_to: _dt.date | None) -> DataFrame:
    """P8 + P9 (+ P12: one bound alone is a one-sided predicate, no sentinel dates)."""
    return filter_date_to(filter_date_from(df, date_from), date_to)


def filter_facility(df: DataFrame, dataset: Dataset, facility_id: str | None) -> DataFrame:
    """P10: ``facility_id`` equality, only for the facility dataset (D3: always an error otherwise)."""
    if facility_id is None or facility_id == "":
        return df
    if dataset.public != "facility":
        raise ValidationError("a facility_id is only allowed for 'facility' reads")
    return df.where(F.col("facility_id") == F.lit(str(facility_id)))


def predicate(column: str, spec: Any) -> Column:
    """P11 for one column: a 2-tuple is an inclusive range, anything else equality."""
    if isinstance(spec, tuple) and len(spec) == 2:
        lo, hi = spec
        return F.col(column).between(F.lit(lo), F.lit(hi))
    return F.col(column) == F.lit(spec)


def filter_map(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """All predicates ANDed; ``None``/empty means no filter."""
    if not filters:
        return df
    unknown = [c for c in filters if c not in df.columns]
    if unknown:
        raise ValidationError(f"Unknown filter column(s): {', '.join(unknown)}")
    return df.where(reduce(lambda a, b: a & b, [predicate(c, v) for c, v in filters.items()]))


def sort_columns(dataset: Dataset) -> list[Column]:
    """Newest first with the key as tie-break, so pages are stable."""
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in dataset.order]


def locate(df: DataFrame, offset: int, limit: int | None) -> tuple[_dt.date, _dt.date | None, int] | None:
    """Where a newest-first page lies: (newest date, oldest date, rows of the newest
    date before the page); None past the end. Reads the date column only;
    the running sum goes over one row per date."""
    w = Window.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_date = df.groupBy("date").count().withColumn("upto", F.sum("count").over(w)).withColumn("before", F.col("upto") - F.col("count"))
    inside = per_date.where((F.col("upto") > offset) & (F.lit(True) if limit is None else F.col("before") < offset + limit))
    row = inside.agg(F.max("date").alias("newest"), F.min("date").alias("oldest"), F.min("before").alias("before")).first()
    return None if row["newest"] is None else (row["newest"], None if limit is None else row["oldest"], offset - row["before"])


def locate_in(days: dict[_dt.date, int], offset: int, limit: int | None) -> tuple[_dt.date, _dt.date | None, int] | None:
    """``locate`` from known rows per date (one number a day): no data is read."""
    spot, before = None, 0
    for day in sorted(days, reverse=True):
        if spot is None and before + days[day] > offset:
            spot = (day, offset - before)
        before += days[day]
        if spot is not None and limit is not None and before >= offset + limit:
            return spot[0], day, spot[1]
    return None if spot is None else (spot[0], None if limit is None else min(days), spot[1])


def page(df: DataFrame, dataset: Dataset, offset: int, limit: int | None, days: dict[_dt.date, int] | None = None) -> DataFrame:
    """L2 / L3: rows ``[offset, offset + limit)`` of the total order; past the end -> empty.

    Dated rows are cut to the dates of the page first (``locate``, or ``locate_in`` where the rows per date are
    known), so each task keeps at most one date's rows more than the page. Tables without a date (the
    dimension) are sorted by key and skipped to the offset.
    """
    order = sort_columns(dataset)
    if dataset.has_date:
        spot = locate(df, offset, limit) if days is None else locate_in(days, offset, limit)
        if spot is None:
            return df.limit(0)
        newest, oldest, offset = spot
        df = filter_date_range(df, oldest, newest)
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def page_after(df: DataFrame, dataset: Dataset, after: dict[str, Any] | None, limit: int) -> DataFrame:
    """Keyset page: the ``limit`` rows that follow the row ``after`` (its key
    values) in the total order. Unlike an offset, the cost does not grow with
    the page depth: the seek is a pushed-down predicate on the sort keys and
    each task keeps only ``limit`` rows. ``after=None`` is the first page."""
    order = list(dataset.order)
    if after:
        missing = [c for c, _ in order if c not in after]
        if missing:
            raise ValidationError(f"keyset needs values for: {', '.join(missing)}")
        # (k1 > v1) OR (k1 = v1 AND k2 > v2) OR ...  with > flipped for descending keys
        terms = []
        for i, (c, asc) in enumerate(order):
            v = F.lit(after[c])
            beyond = F.col(c) > v if asc else F.col(c) < v
            eq = [F.col(p) == F.lit(after[p]) for p, _ in order[:i]]
            terms.append(reduce(lambda a, b: a & b, eq + [beyond]))
        df = df.where(reduce(lambda a, b: a | b, terms))
        # implied by the seek, and a plain bound that prunes months and row groups
        first, asc = order[0]
        df = df.where(F.col(first) >= F.lit(after[first]) if asc else F.col(first) <= F.lit(after[first]))
    return df.orderBy(*sort_columns(dataset)).limit(limit)


def with_page_rank(page_df: DataFrame, dataset: Dataset, rank_col: str = "page_rank") -> DataFrame:
    """Position (0-based) of each row inside one page; the page is at most the
    limit (<= 1,000 rows), so one un-partitioned window over it is bounded."""
    w = Window.orderBy(*sort_columns(dataset))
    return page_df.withColumn(rank_col, (F.row_number().over(w) - F.lit(1)).cast("bigint"))


def join_names(page_df: DataFrame, plants: DataFrame | None) -> DataFrame:
    """Left join of a page with the dimension, after paging.

    ``page_df`` must be a page (the read service passes at most its limit); whole
    tables go through ``join_names_whole``. The page holds at most ``limit`` ids, so the dimension is first cut down by
    a semi join against the page's ids (broadcast, bounded by the page), then
    joined back (bounded by the same ids, one name per id). The whole dimension
    is never broadcast and never shuffled. A missing dimension skips the join.
    """
    if plants is None:
        return page_df
    ids = page_df.select("facility_id").distinct()
    names = one_name(plants.select("facility_id", "facility_name").join(F.broadcast(ids), "facility_id", "left_semi"))
    return page_df.join(F.broadcast(names), "facility_id", "left")


def join_names_whole(facts: DataFrame, plants: DataFrame) -> DataFrame:
    """J1 over a whole fact table, with the same one name per id: no hint, so Spark
    broadcasts the dimension only when its measured size is under
    ``autoBroadcastJoinThreshold`` (AQE re-checks at runtime) and otherwise plans a shuffle join."""
    return facts.join(one_name(plants), "facility_id", "left")


#: Ids of a name filter up to which they are pushed into the scan as a list.
PUSHED_IDS = 1000


def filter_by_name(facts: DataFrame, plants: DataFrame, named: Column) -> DataFrame:
    """Facts of the facilities whose name passes ``named`` (a condition on ``facility_name``).

    The dimension is filtered first. Up to ``PUSHED_IDS`` ids go into the scan as a list (row
    groups without any of them are skipped: facts are stored sorted by facility); more are a semi join, for which
    Spark broadcasts the ids under its threshold or builds a runtime Bloom filter.
    """
    ids = plants.where(named).select("facility_id").distinct()
    few = [r["facility_id"] for r in ids.limit(PUSHED_IDS + 1).collect()]
    if len(few) <= PUSHED_IDS:
        return facts.where(F.col("facility_id").isin(few))
    return facts.join(ids, "facility_id", "left_semi")


def count_rows(df: DataFrame, name: str = "total_count") -> DataFrame:
    """A3 / A4: a 1-row count frame (never a window over the data)."""
    return df.agg(F.count(F.lit(1)).alias(name))


def page_metadata(filtered: DataFrame, offset: int, limit: int, requested: int | None = None, total: int | None = None) -> DataFrame:
    """A3, A4, L4, L5 in one row: ``total_count, offset, limit, returned, next_offset, limit_clamped``.

    ``next_offset`` is offset + limit while that is below the total, else NULL;
    ``limit_clamped`` says that more than the maximum was asked for. One count
    gives all of it: the page itself is not read again. With a known ``total`` nothing is counted.
    """
    nxt = F.lit(offset + limit).cast("bigint")
    zero = F.lit(0).cast("bigint")
    counted = count_rows(filtered) if total is None else filtered.sparkSession.range(1).select(F.lit(total).cast("bigint").alias("total_count"))
    return counted.select(
        F.col("total_count"),
        F.lit(offset).cast("bigint").alias("offset"),
        F.lit(limit).cast("bigint").alias("limit"),
        F.least(F.lit(limit).cast("bigint"), F.greatest(F.col("total_count") - F.lit(offset), zero)).alias("returned"),
        F.when(nxt < F.col("total_count"), nxt).alias("next_offset"),
        F.lit(requested is not None and requested > limit).alias("limit_clamped"),
    )
