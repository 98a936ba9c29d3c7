"""Full, incremental and recovery refreshes.

``refresh`` reads landed pages in parallel, validates and transforms them on
the executors, dedupes each batch on its merge key (last landed wins), and
merges it into the three base tables in landing order: facts month by month, the two small tables
whole. Every landed page is recorded as applied, held or broken; new files are judged together with what
is recorded of their run, so nothing that lands late, out of order or behind a gap is
lost, and no applied file is parsed again. Rejected records and failed conversions are stored, too. Snapshots
are published before the watermarks move (D11) and pages are recorded last, so a
crash only repeats work on the next run (merges are idempotent).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.errors import ProcessingError
from reactorlake.operators.clean import OUTPUT_SCHEMA, REQUIRED, any_failed_number, drop_name, failed_numbers, is_valid, missing_fields, parse_once, project_parsed
from reactorlake.operators.upsert import MERGE_KEYS, OLDER, SAME, change_kinds, dimension_from_batch, last_wins, latest, merge_latest, upsert
from reactorlake.schemas import DATASETS, PAGE_SIZE, RAW_RECORD_SCHEMA
from reactorlake.sources import state as S
from reactorlake.sources.landing import BROKEN, KEPT, filter_period, landed_files, ordered_records, page_infos, page_places, page_states, pages_in, place_of, read_pages, records_from_pages, stage_pages, with_seq
from reactorlake.sources.tables import MONTH_COL, Warehouse, empty_frame, materialize, newest_date, stage_scope, with_month

FULL = "full"
INCREMENTAL = "incremental"
RECOVERY = "recovery"

# The run-summary wording. There are two labels; a recovery run
# is not a first run, so it is reported with the incremental label.
MODE_LABEL = {FULL: "FULL (first run)", INCREMENTAL: "INCREMENTAL", RECOVERY: "INCREMENTAL"}


@dataclass(frozen=True)
class Landing:
    """Where the source pages of each dataset land.

    A broken page is recorded and reported (``state.broken_files``), and its run goes on up to its
    place; with ``strict`` the refresh raises instead and applies nothing.
    """

    facility: str
    us: str
    multi_line: bool = False
    page_size: int = PAGE_SIZE
    strict: bool = False


def choose_mode(wh: Warehouse) -> str:
    """Base tables + facility watermark -> incremental; base tables without
    one -> full; no base tables but published snapshots -> recovery; else full."""
    if wh.base_tables_exist():
        st = S.load_state(wh)
        return INCREMENTAL if st.get("facility_outages") else FULL
    if wh.has_any_snapshot_data():
        return RECOVERY
    return FULL


@dataclass(frozen=True)
class Batch:
    """What a refresh reads of one landing: transformed records with their order (``ord``), the pages'
    states, what it rejects, and the places of the pages that ``ord`` counts (``landing.page_places``)."""

    rows: DataFrame
    pages: DataFrame
    rejected: DataFrame
    places: DataFrame


#: File names that Spark's reader is given; of more new files, their whole landing is read and filtered.
LISTED_FILES = 100_000


def _pages_in(spark: SparkSession, path: str, files: DataFrame, multi_line: bool) -> DataFrame | None:
    """The pages of some files (``run, file``); None without files."""
    names = [r["file"] for r in files.select("file").distinct().limit(LISTED_FILES + 1).collect()]
    if not names:
        return None
    if len(names) <= LISTED_FILES:
        return read_pages(spark, path, names, multi_line)
    return read_pages(spark, path, None, multi_line).join(files.select("file").distinct(), "file", "left_semi")


def _read(spark: SparkSession, landing: Landing, path: str, public: str, wh: Warehouse, start: _dt.date | None, only_new: bool) -> Batch | None:
    """The landed records of one dataset; None if there is nothing (new) to read.

    With ``only_new`` only files that were never read, or were broken, are parsed.
    """
    files = landed_files(spark, path)
    if files is None:
        return None
    known = None
    if only_new:
        known = S.load_progress(wh, DATASETS[public].storage)
        todo = materialize(files.join(known.where(F.col("state") != BROKEN), ["run", "file"], "left_anti"), f"{public}-files")
        raw = _pages_in(spark, path, todo, landing.multi_line)
        if raw is None:
            return None
    else:
        todo, raw = files, read_pages(spark, path, None, landing.multi_line)
    # The JSON is parsed once into the shared checkpoint folder: the stop rules and
    # the records read the stage, and lost executors re-read it.
    return judge(spark, landing, path, public, stage_pages(raw, f"{public}-pages", landing.page_size), todo, known, start)


def judge(spark: SparkSession, landing: Landing, path: str, public: str, pages: DataFrame, listed: DataFrame, known: DataFrame | None, start: _dt.date | None) -> Batch:
    """Apply the stop rules to new ``pages`` (staged) together with the ``known`` ones of their runs, and take the
    records of those that are kept and were not before.

    ``listed`` are the files read; one without any page is broken. A run that was read before
    keeps the date bound of its first reading; a new one starts at ``start``.
    """
    infos = materialize(page_infos(pages), f"{public}-infos")  # read several times below
    nothing = listed.join(infos.select("file").distinct(), "file", "left_anti").select("run", "file", F.lit("no page in the file").alias("broken"))
    infos = infos.unionByName(nothing, allowMissingColumns=True).withColumn("was", F.lit(None).cast("string"))
    bound = F.lit(start).cast("date")
    if known is not None:
        runs = infos.select("run").distinct()
        old = known.join(runs, "run", "left_semi")
        unbound = F.count(F.when(F.col("start").isNull(), 1)) > 0
        first = old.groupBy("run").agg(F.when(~unbound, F.min("start")).alias("first")).withColumn("seen", F.lit(True))
        again = old.join(infos.select("run", "file").distinct(), ["run", "file"], "left_anti")
        infos = infos.unionByName(again.select("run", "file", "offset", "broken", "total", "n", "low", "high", F.col("state").alias("was")))
        infos = infos.join(first, "run", "left").withColumn("start", F.when(F.col("seen"), F.col("first")).otherwise(bound)).drop("first", "seen")
    else:
        infos = infos.withColumn("start", bound)
    states = materialize(page_states(infos, landing.page_size), f"{public}-states")
    bad = states.where(F.col("state") == BROKEN)
    if landing.strict and not bad.isEmpty():
        worst = bad.orderBy("file").first()
        raise ProcessingError(f"{worst['file']} can't be read: {worst['broken']}")
    kept = states.where((F.col("state") == KEPT) & ~F.col("was").eqNullSafe(KEPT))
    if known is not None:  # pages read before that only now are kept: their gap is filled
        late = _pages_in(spark, path, kept.where(F.col("was").isNotNull()), landing.multi_line)
        if late is not None:
            pages = stage_pages(pages.unionByName(late), f"{public}-late-pages", landing.page_size)
    pages = pages_in(pages, kept)
    starts = states.select("run", "start").distinct()
    places = materialize(page_places(pages).join(starts, "run", "left"), f"{public}-places")
    # Texts are parsed once, by the stage that the rows and the rejects both read; it
    # names a record's page by number, so neither run nor file go through the merge with every row.
    records = materialize(_checked(ordered_records(pages, places), public), f"{public}-records")
    rows = records.where("stored").select(*[f.name for f in OUTPUT_SCHEMA[public].fields], "ord")
    touched = states.where(~F.col("was").eqNullSafe(F.col("state"))).select("run", "file").distinct()
    return Batch(rows, states.join(touched, ["run", "file"], "left_semi"), rejected(records, places), places.drop("start"))


def landed_between(spark: SparkSession, landing: Landing, public: str, wh: Warehouse, start: _dt.date | None = None, end: _dt.date | None = None) -> DataFrame:
    """S3 over what refreshes have read: the kept raw records of an inclusive date range. Only
    files with a page that reaches into the range are opened (``state.pages_between``)."""
    path = landing.us if public == "us" else landing.facility
    chosen = materialize(S.pages_between(wh, DATASETS[public].storage, start, end), f"{public}-between")
    pages = _pages_in(spark, path, chosen, landing.multi_line)
    if pages is None:
        return empty_frame(spark, RAW_RECORD_SCHEMA)
    return filter_period(records_from_pages(pages_in(pages, chosen)), start, end).select(*RAW_RECORD_SCHEMA.names)


def _checked(records: DataFrame, public: str) -> DataFrame:
    """P1-P5, P2, D12 in one pass over raw records with ``start`` and ``ord``: the columns to store and whether
    they are, and why a record (``period``, ``facility``) is rejected or has numbers that it is stored without."""
    def entry(kind: str, reason: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), reason.alias("reason"), value.cast("string").alias("value"))

    raw, none = parse_once(records), F.lit(None).cast("string")
    early = F.coalesce(F.col("_date") < F.col("start"), F.lit(False))
    raw = raw.withColumns({"_early": early, "_valid": is_valid(REQUIRED[public], F.col("_date")), "_failed": any_failed_number(raw, True)})
    why = (  # a record is late, else incomplete, else may hold numbers that are none
        F.when(F.col("_early"), F.array(entry("late", F.concat(F.lit("before "), F.col("start").cast("string")), none)))
        .when(~F.col("_valid"), F.array(entry("missing", F.array_join(missing_fields(REQUIRED[public], F.col("_date")), ", "), none)))
        .when(F.col("_failed"), F.transform(failed_numbers(records, True), lambda f: entry("number", f["field"], f["text"])))
    )
    odd = F.col("_early") | ~F.col("_valid") | F.col("_failed")
    report = [F.when(odd, F.col(c)).alias(c) for c in ("period", "facility")]
    return raw.select(*project_parsed(public), "ord", (~F.col("_early") & F.col("_valid")).alias("stored"), *report, why.alias("why"))


def rejected(records: DataFrame, places: DataFrame) -> DataFrame:
    """What a refresh does not store, and numbers it stores as NULL, with the reason."""
    odd = place_of(records.where(F.col("why").isNotNull()).select("why", "period", "facility", "ord"), places.select("page", "run", "file", "offset"))
    return odd.withColumn("why", F.explode("why")).select("why.*", "period", "facility", "run", "file", "offset", "pos")


def _latest(rows: DataFrame, storage: str, places: DataFrame | None) -> DataFrame:
    """The last landed row of each merge key, with ``seq``; rows of a landing come with ``ord`` and their pages' places."""
    if places is None:
        return last_wins(rows, MERGE_KEYS[storage], keep_seq=True)
    return with_seq(latest(rows, MERGE_KEYS[storage], "ord"), places)


#: Up to so many pages their places (some hundred bytes each) are sent to every task.
BROADCAST_PLACES = 100_000


def _write_facts(wh: Warehouse, rows: DataFrame, places: DataFrame | None) -> int:
    """The facts made of the last landed row of each key; their number. Rows travel with ``ord``, a number, and get
    ``seq``, which holds names, where they are written, unless that needs a shuffle."""
    if places is None or places.count() > BROADCAST_PLACES:
        return wh.overwrite_base("facility", _latest(rows, "facility_outages", places))
    near = F.broadcast(places)
    return wh.overwrite_base("facility", latest(rows, MERGE_KEYS["facility_outages"], "ord"), lambda df: with_seq(df, near))


def _names(rows: DataFrame, places: DataFrame | None) -> DataFrame:
    """One name per id, the last landed one, with ``seq``."""
    return dimension_from_batch(rows) if places is None else with_seq(dimension_from_batch(rows, "ord"), places)


def _empty(spark: SparkSession, name: str) -> DataFrame:
    return empty_frame(spark, DATASETS[name].schema)


def summary(spark: SparkSession, mode: str, counts: dict[str, int]) -> DataFrame:
    """Mode and rows processed per table (three rows), with the report text."""
    rows = [(MODE_LABEL[mode], name, int(counts.get(name, 0))) for name in ("facility_outages", "us_outages", "plants")]
    df = spark.createDataFrame(rows, "mode string, dataset string, rows_processed bigint")
    return df.withColumn("message", F.concat(F.col("rows_processed").cast("string"), F.lit(" rows processed")))


def full_refresh(spark: SparkSession, landing: Landing, wh: Warehouse) -> dict[str, int]:
    """Overwrite the base tables from every landed record, publish, then state.

    A dataset without any landing is skipped: its base table and watermark stay
    as they are, and only a table that never existed is created empty.
    """
    fac = _read(spark, landing, landing.facility, "facility", wh, None, only_new=False)
    us = _read(spark, landing, landing.us, "us", wh, None, only_new=False)
    tables: dict[str, DataFrame] = {}
    if fac is not None:
        # One name per id, the last landed one (decided before the key dedupe drops ``seq``)
        tables["plants"] = _names(fac.rows, fac.places)
        tables["facility"] = drop_name(fac.rows)
    if us is not None:
        tables["us"] = _latest(us.rows, "us_outages", us.places)
    counts = {d.storage: 0 for d in DATASETS.values()}
    for name in DATASETS:
        storage = DATASETS[name].storage
        if name == "facility" and name in tables:
            counts[storage] = _write_facts(wh, tables[name], fac.places)  # D9
            wh.publish(name)
        elif name in tables:
            counts[storage] = wh.overwrite_base(name, tables[name])
            wh.publish(name)  # S10: an empty table keeps the older snapshot
        elif not wh.base_exists(storage):
            wh.overwrite_base(name, _empty(spark, name))
    marks = {}
    if fac is not None:
        marks["facility_outages"] = marks["plants"] = _newest(wh, "facility_outages")
    if us is not None:
        marks["us_outages"] = _newest(wh, "us_outages")
    S.save_state(wh, marks, replace=True)
    _record(wh, fac, us)
    return counts


def _record(wh: Warehouse, fac: Batch | None, us: Batch | None) -> None:
    for batch, storage in ((fac, "facility_outages"), (us, "us_outages")):
        if batch is not None:
            S.save_rejected(wh, storage, batch.rejected)
            S.save_progress(wh, storage, batch.pages)


def _newest(wh: Warehouse, storage: str) -> _dt.date | None:
    return newest_date(wh.base_parts(storage) or {})


def _months(batch: DataFrame) -> list[str]:
    """Months touched by a batch: bounded by the batch's date span."""
    return [r[0] for r in with_month(batch.select("date").distinct()).select(MONTH_COL).distinct().collect()]


def _count_and_newest(df: DataFrame) -> tuple[int, _dt.date | None]:
    return df.agg(F.count(F.lit(1)), F.max("date")).first()


def apply_facility_batch(spark: SparkSession, wh: Warehouse, fac: DataFrame, places: DataFrame | None = None) -> tuple[int, int, _dt.date | None]:
    """Merge one transformed facility batch (with ``seq``, or ``ord`` and places) into the facts and
    the dimension in landing order, then publish. An absent table is created from the batch (M1);
    only months in which the batch changes something are rewritten, into new folders. An
    empty batch changes nothing and returns zero rows. Rows count after the
    last-wins dedupe, as in a full load."""
    touched = _months(fac)
    if not touched:
        return 0, 0, None
    plants = materialize(_names(fac, places), "plants-batch")
    if not wh.base_exists("facility_outages"):
        n_rows, batch_max = _write_facts(wh, drop_name(fac), places), _newest(wh, "facility_outages")
    else:
        facts = _latest(drop_name(fac), "facility_outages", places)
        current = wh.load_base("facility", months=touched, with_seq=True)  # only the touched months are read
        kinds = materialize(change_kinds(current, facts, MERGE_KEYS["facility_outages"]), "facts-kinds")
        n_rows, batch_max = _count_and_newest(kinds)
        news = kinds.where(~F.col("kind").isin(SAME, OLDER)).drop("kind")
        months = _months(news)
        if months:  # a replayed or older batch rewrites nothing
            current = wh.load_base("facility", months=months, with_seq=True)
            # what is left of the batch is newer than the stored row of its key: a plain upsert
            wh.replace_months("facility", upsert(current, news, MERGE_KEYS["facility_outages"]), months)
    if not wh.base_exists("plants"):
        wh.overwrite_base("plants", plants)
    else:
        wh.overwrite_base("plants", merge_latest(wh.load_base("plants", with_seq=True), plants, MERGE_KEYS["plants"]))
    wh.publish("facility")
    wh.publish("plants")
    return n_rows, plants.count(), batch_max


def apply_us_batch(spark: SparkSession, wh: Warehouse, us: DataFrame, places: DataFrame | None = None) -> tuple[int, _dt.date | None]:
    """Merge one transformed national batch in landing order; the small table is rewritten whole.
    An empty batch changes nothing and returns zero rows."""
    us = materialize(_latest(us, "us_outages", places), "us-upsert")
    n_rows, batch_max = _count_and_newest(us)
    if n_rows == 0:
        return 0, None
    if wh.base_exists("us_outages"):
        wh.overwrite_base("us", merge_latest(wh.load_base("us", with_seq=True), us, MERGE_KEYS["us_outages"]))
    else:
        wh.overwrite_base("us", us)
    wh.publish("us")
    return n_rows, batch_max


def incremental_refresh(
    spark: SparkSession, landing: Landing, wh: Warehouse, lookback_days: int = 0
) -> dict[str, int]:
    """R2 (+R5): read what has landed since, from each watermark on (inclusive, minus
    ``lookback_days``), merge each non-empty batch, publish, advance watermarks,
    and record the pages last, so a crash repeats work and loses nothing."""
    st = S.load_state(wh)

    def start(name: str) -> _dt.date | None:
        w = st.get(name)
        return None if w is None else w - _dt.timedelta(days=lookback_days)

    fac = _read(spark, landing, landing.facility, "facility", wh, start("facility_outages"), only_new=True)
    us = _read(spark, landing, landing.us, "us", wh, start("us_outages"), only_new=True)
    counts = {"facility_outages": 0, "us_outages": 0, "plants": 0}
    marks: dict[str, _dt.date | None] = {}
    if fac is not None:
        counts["facility_outages"], counts["plants"], newest = apply_facility_batch(spark, wh, fac.rows, fac.places)
        if counts["facility_outages"]:
            marks["facility_outages"] = newest
    if us is not None:
        counts["us_outages"], newest = apply_us_batch(spark, wh, us.rows, us.places)
        if counts["us_outages"]:
            marks["us_outages"] = newest
    S.save_state(wh, marks)  # D11: state after publish; plants' watermark untouched (A2)
    _record(wh, fac, us)
    return counts


def recover(wh: Warehouse) -> dict[str, int]:
    """Base tables made of the published snapshots; no extraction follows."""
    counts = {}
    for name in ("plants", "facility", "us"):
        storage = DATASETS[name].storage
        if wh.snapshot_exists(storage):
            counts[storage] = wh.restore(name)
        else:  # never published: nothing to recover
            counts[storage] = wh.overwrite_base(name, _empty(wh.spark, name))
    return counts


def refresh(
    spark: SparkSession, landing: Landing, wh: Warehouse, mode: str = "auto", lookback_days: int = 0
) -> DataFrame:
    """Run one refresh and return its summary (A6). Intermediate stages (parsed
    pages, batches) live in a scope folder removed when the run ends."""
    chosen = choose_mode(wh) if mode == "auto" else mode
    with stage_scope(spark):
        if chosen == INCREMENTAL:
            counts = incremental_refresh(spark, landing, wh, lookback_days)
        elif chosen == RECOVERY:
            counts = recover(wh)
        else:
            counts = full_refresh(spark, landing, wh)
    wh.drop_unused()
    return summary(spark, chosen, counts)
