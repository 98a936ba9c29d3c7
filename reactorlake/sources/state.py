"""Per-dataset watermarks and the states of landed pages.

Watermarks are one small manifest, switched like a table's. The states of landed
pages are a log (``Warehouse.append_log``): every reading of a file adds one row per page, the
newest reading of a file counts, and the log is written together every few
refreshes. A missing state reads as three NULL watermarks and unknown stored entries are ignored.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reactorlake.schemas import DATASETS, STATE_SCHEMA
from reactorlake.sources.tables import Warehouse, read_manifest, switch_manifest

STATE_DATASETS = [d.storage for d in DATASETS.values()]


def _stored(wh: Warehouse) -> dict[str, dict]:
    return read_manifest(wh.spark, wh.state_dir()) or {}


def load_state_frame(wh: Warehouse) -> DataFrame:
    """One row per known dataset; NULL watermark when absent."""
    stored = _stored(wh)
    rows = []
    for name in STATE_DATASETS:
        entry = stored.get(name, {})
        day, at = entry.get("last_extraction_date"), entry.get("updated_at")
        rows.append((name, _dt.date.fromisoformat(day) if day else None, _dt.datetime.fromisoformat(at) if at else None))
    return wh.spark.createDataFrame(rows, STATE_SCHEMA)


def load_state(wh: Warehouse) -> dict[str, _dt.date | None]:
    """S12 as driver values (three entries, bounded)."""
    stored = _stored(wh)
    days = {name: stored.get(name, {}).get("last_extraction_date") for name in STATE_DATASETS}
    return {name: _dt.date.fromisoformat(day) if day else None for name, day in days.items()}


def save_state(wh: Warehouse, marks: dict[str, _dt.date | None], replace: bool = False) -> None:
    """Move the given datasets' watermarks (as ``advance`` does: never backwards, and an empty
    batch moves none; a full load sets them with ``replace``); other datasets keep their stored values."""
    if not marks:
        return
    stored, old = _stored(wh), load_state(wh)
    for name, new in marks.items():
        day = new if replace or old.get(name) is None else old[name] if new is None else max(old[name], new)
        stored[name] = {"last_extraction_date": day.isoformat() if day else None, "updated_at": _dt.datetime.now(_dt.UTC).replace(tzinfo=None).isoformat()}
    switch_manifest(wh.spark, wh.state_dir(), stored)


def watermark(frame: DataFrame, name: str = "last_extraction_date") -> DataFrame:
    """A1: newest date of a frame (NULL for an empty frame), as a 1-row frame."""
    return frame.agg(F.max("date").alias(name))


def advance(old: Column, batch_max: Column) -> Column:
    """Only a non-empty batch moves the watermark, and never backwards."""
    return F.coalesce(F.greatest(old, batch_max), old, batch_max)


# --- states of landed pages -----------------------------------------------------
# One row per page that a refresh has read: kept (applied), ignored (ruled out by the source's
# stop rules), held behind a missing page, or broken; what the stop rules need of it; and the date bound its
# fetch run was read from. New files of a run are judged together with the stored rows
# of its other pages, so files are parsed once.

PROGRESS_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("broken", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("start", T.DateType()),
        T.StructField("low", T.DateType()),
        T.StructField("high", T.DateType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def _newest_reading(rows: DataFrame) -> DataFrame:
    """The rows of each file's newest reading."""
    newest = rows.groupBy("run", "file").agg(F.max("updated_at").alias("updated_at"))
    return rows.join(newest, ["run", "file", "updated_at"], "left_semi")


def load_progress(wh: Warehouse, dataset: str) -> DataFrame:
    """Every page read so far, with ``applied``: nothing is left to be done for it."""
    rows = _newest_reading(wh.load_log(f"progress/{dataset}", PROGRESS_SCHEMA))
    return rows.withColumn("applied", F.col("state").isin("kept", "ignored"))


def save_progress(wh: Warehouse, dataset: str, pages: DataFrame) -> None:
    """Add a reading: all pages of every file that was read or whose pages changed their state."""
    blank = {c: F.lit(None).cast("date") for c in ("low", "high") if c not in pages.columns}
    wh.append_log(f"progress/{dataset}", pages.withColumns({**blank, "updated_at": F.current_timestamp()}), PROGRESS_SCHEMA, _newest_reading)


def pages_between(wh: Warehouse, dataset: str, start: _dt.date | None, end: _dt.date | None) -> DataFrame:
    """S3: the kept pages whose records reach into the inclusive range, from the recorded first and last dates."""
    cond = F.col("state") == "kept"
    if start is not None:
        cond = cond & (F.col("high") >= F.lit(start))
    if end is not None:
        cond = cond & (F.col("low") <= F.lit(end))
    return load_progress(wh, dataset).where(cond)


def held_files(wh: Warehouse, dataset: str) -> DataFrame:
    """``run, file`` of landed files that wait for a missing page."""
    return load_progress(wh, dataset).where(F.col("state") == "held").select("run", "file").distinct()


def broken_files(wh: Warehouse, dataset: str) -> DataFrame:
    """``run, file, broken`` (why) of landed files that can't be read; every refresh tries them again."""
    return load_progress(wh, dataset).where(F.col("state") == "broken").select("run", "file", "broken").distinct()


# --- what refreshes reject --------------------------------------------------------

REJECTED_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("facility", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("pos", T.IntegerType()),
    ]
)


def _once(rows: DataFrame) -> DataFrame:
    return rows.distinct()


def save_rejected(wh: Warehouse, dataset: str, rows: DataFrame) -> None:
    wh.append_log(f"rejected/{dataset}", rows, REJECTED_SCHEMA, _once)


def load_rejected(wh: Warehouse, dataset: str) -> DataFrame:
    """Records that refreshes rejected (``missing``: a required field; ``late``: before
    the bound of their run) and numbers that they could not convert (``number``; the record is
    stored with NULL). A record read twice is listed once."""
    return _once(wh.load_log(f"rejected/{dataset}", REJECTED_SCHEMA))
