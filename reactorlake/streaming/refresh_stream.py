"""The incremental refresh as a Structured Streaming query.

``readStream.json(landing)`` picks up newly landed page files; each
micro-batch is judged by the same stop rules as a batch refresh, validated, transformed, deduped
on its key and merged into the base tables in landing order inside ``foreachBatch``, then published, then the
watermark moves. File progress lives in the stream's checkpoint; the states of pages live in the
warehouse (``state.load_progress``), where batch refreshes keep theirs, too: pages behind
a missing page are held, and applied by the micro-batch that brings it; broken
files are recorded, and the next batch refresh tries them again. A replayed micro-batch changes nothing, so a
restart after a crash is safe. ``trigger(availableNow=True)`` processes everything landed so far and stops.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reactorlake.plans.refresh import Landing, apply_facility_batch, apply_us_batch, judge
from reactorlake.schemas import CORRUPT, LANDED_SCHEMA, PAGE_SIZE
from reactorlake.sources import state as S
from reactorlake.sources.landing import _root_name, pages_of, stage_pages
from reactorlake.sources.tables import Warehouse, stage_scope

_STATE_NAME = {"facility": "facility_outages", "us": "us_outages"}


def start_refresh_stream(
    spark: SparkSession,
    landing_path: str,
    dataset: str,
    wh: Warehouse,
    checkpoint_location: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    page_size: int = PAGE_SIZE,
    lateness_days: int | None = None,
) -> StreamingQuery:
    """Start the stream for one dataset (``facility`` or ``us``).

    With ``lateness_days`` rows older than the watermark minus so many days when their run is
    first read are not stored but listed as ``late`` (``state.load_rejected``); else every row is.
    """
    if dataset not in _STATE_NAME:
        raise ValueError("dataset must be 'facility' or 'us'")
    landing = Landing(landing_path, landing_path, page_size=page_size)
    reader = spark.readStream.schema(LANDED_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = pages_of(reader.option("recursiveFileLookup", True).json(landing_path), _root_name(spark, landing_path))

    def upsert_batch(batch_pages: DataFrame, epoch_id: int) -> None:
        with stage_scope(batch_pages.sparkSession):
            apply_batch(batch_pages)
        wh.drop_unused()

    def apply_batch(batch_pages: DataFrame) -> None:
        session, storage = batch_pages.sparkSession, _STATE_NAME[dataset]
        staged = stage_pages(batch_pages, f"{dataset}-stream-pages", page_size)
        listed = staged.select("run", "file").distinct()
        mark = None if lateness_days is None else S.load_state(wh)[storage]
        start = None if mark is None else mark - _dt.timedelta(days=lateness_days)
        batch = judge(session, landing, landing_path, dataset, staged, listed, S.load_progress(wh, storage), start)
        if dataset == "facility":
            n_rows, _, batch_max = apply_facility_batch(session, wh, batch.rows, batch.places)
        else:
            n_rows, batch_max = apply_us_batch(session, wh, batch.rows, batch.places)
        if n_rows:
            marks = {storage: batch_max}
            if dataset == "facility" and S.load_state(wh).get("plants") is None:
                marks["plants"] = batch_max  # first load: the dimension takes the facts' mark
            S.save_state(wh, marks)  # after publish (D11)
        S.save_rejected(wh, storage, batch.rejected)
        S.save_progress(wh, storage, batch.pages)

    writer = pages.writeStream.foreachBatch(upsert_batch).option(
        "checkpointLocation", checkpoint_location or f"{wh.root}/_streams/{dataset}"
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_available(spark: SparkSession, landing_path: str, dataset: str, wh: Warehouse, **kw) -> None:
    """Process every landed page now and return when the stream has stopped."""
    q = start_refresh_stream(spark, landing_path, dataset, wh, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
