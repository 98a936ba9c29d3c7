"""Registered queries: one per operator group of the inventory.

Each query takes ``(spark, sf_dir)``, derives the outage tables from the test
tables (``reactorlake.sources.adapter``) and returns a DataFrame whose columns
match its DuckDB twin in ``reactorlake.plans.oracle``. Every query runs over
whole tables; limits appear only where paging or top-N is the feature.
Dates leave as ``yyyy-MM-dd`` text, like the reference's responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.functions import dates as D
from reactorlake.functions.dates import format_date
from reactorlake.functions.numbers import coerce_double
from reactorlake.operators import clean as C
from reactorlake.operators import display as V
from reactorlake.operators import read as R
from reactorlake.operators import series as SR
from reactorlake.operators.numbering import number_pages
from reactorlake.operators.upsert import MERGE_KEYS, change_kinds, dimension_from_batch, last_wins, upsert
from reactorlake.plans import compare as CMP
from reactorlake.plans import refresh as RF
from reactorlake.plans import service as SV
from reactorlake.schemas import DATASETS, PAGE_SIZE
from reactorlake.sources import adapter as A
from reactorlake.sources import landing as L
from reactorlake.sources import state as S
from reactorlake.sources.tables import Warehouse, shared_root

# Fixed query parameters (shared with the SQL twins).
DATE_FROM = "1996-03-01"
DATE_TO = "1996-12-31"
LATE_FROM = "1997-06-01"
EARLY_TO = "1995-06-30"
CHART_FROM = "1996-03-01"
CHART_TO = "1996-04-29"
SERIES_TO = "2000-12-31"
FACILITY = "7"
MAP_FACILITY = "3"
MAP_FROM = "1998-01-01"
MAP_TO = "1998-12-31"
# the chart shows five series
CHART_SERIES = 5
SERIES_PICK = ["7", "3", "10", "99999", "1", "5", "2"]
PAGE_OFFSET, PAGE_LIMIT = 100, 50
META_OFFSET, META_LIMIT = 40, 20
# beyond 100,000 rows at sf0.1; inside the table at sf0.01 already
DEEP_SHARE, DEEP_LIMIT = 0.75, 5000
PLANTS_OFFSET, PLANTS_LIMIT = 10, 25
NUMBER_PAGE = 1000
OVERVIEW_LIMIT = 10
KEYSET_DATE, KEYSET_FACILITY, KEYSET_LIMIT = "1996-06-15", "5", 50
LOOKBACK_DAYS = 30
SPLIT_DATE = "1996-07-01"
GAP_PAGE = 2000
# a look-back beyond any table
ALL_DAYS = 36500


def _frames(spark: SparkSession, sf: str) -> SV.FrameCatalog:
    return SV.FrameCatalog(
        {
            "facility_outages": A.facility_outages(spark, sf),
            "us_outages": A.us_outages(spark, sf),
            "plants": A.plants(spark, sf),
        }
    )


def _text_dates(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: format_date(c) for c in cols})


FACT_COLS = ["date", "facility_id", "capacity", "outage", "percent_outage"]
US_COLS = ["date", "capacity", "outage", "percent_outage"]

# --- scans and filters --------------------------------------------------------


def scan_facility(spark, sf):
    return _text_dates(A.facility_outages(spark, sf).select(*FACT_COLS), "date")


def scan_us(spark, sf):
    return _text_dates(A.us_outages(spark, sf).select(*US_COLS), "date")


def scan_plants(spark, sf):
    return A.plants(spark, sf)


def filter_date_from(spark, sf):
    df = R.filter_date_from(A.facility_outages(spark, sf), D.parse_date_arg(LATE_FROM))
    return _text_dates(df, "date")


def filter_date_to(spark, sf):
    df = R.filter_date_to(A.facility_outages(spark, sf), D.parse_date_arg(EARLY_TO))
    return _text_dates(df, "date")


def filter_date_range(spark, sf):
    df = R.filter_date_range(A.us_outages(spark, sf), D.parse_date_arg(DATE_FROM), D.parse_date_arg(DATE_TO))
    return _text_dates(df, "date")


def filter_facility(spark, sf):
    df = R.filter_facility(A.facility_outages(spark, sf), DATASETS["facility"], FACILITY)
    return _text_dates(df, "date")


def filter_map(spark, sf):
    filters = {
        "date": (D.parse_date_arg(MAP_FROM), D.parse_date_arg(MAP_TO)),
        "facility_id": MAP_FACILITY,
    }
    return _text_dates(R.filter_map(A.facility_outages(spark, sf), filters), "date")


# --- paging -------------------------------------------------------------------


def page_facility(spark, sf):
    return SV.get_dataset(_frames(spark, sf), "facility", DATE_FROM, DATE_TO, None, PAGE_OFFSET, PAGE_LIMIT).data


def page_us(spark, sf):
    return SV.get_dataset(_frames(spark, sf), "us").data


def page_plants(spark, sf):
    # date bounds are ignored for the dimension
    return SV.get_dataset(_frames(spark, sf), "plants", DATE_FROM, DATE_TO, None, PLANTS_OFFSET, PLANTS_LIMIT).data


def page_deep(spark, sf):
    """A page at three quarters of the whole table, with a maximum above the default one."""
    offset = int(A.facility_outages(spark, sf).count() * DEEP_SHARE)
    return SV.get_dataset(_frames(spark, sf), "facility", None, None, None, offset, DEEP_LIMIT, max_limit=DEEP_LIMIT).data


def page_clamped(spark, sf):
    """L4: 5,000 rows asked for, 1,000 given, and the metadata says so."""
    return SV.get_dataset(_frames(spark, sf), "facility", None, None, None, 0, DEEP_LIMIT).meta


def page_rest(spark, sf):
    """L3: every row from an offset on, without a limit."""
    ds = DATASETS["us"]
    return _text_dates(R.page(A.us_outages(spark, sf), ds, META_OFFSET, None), "date")


def page_arguments(spark, sf):
    """P15 as a column: what each dataset's read with each id of the dimension is refused for.
    Some ranges end before they start, some dates are no dates."""
    ids = A.plants(spark, sf).select("facility_id", F.explode(F.array(*[F.lit(n) for n in (*DATASETS, "other")])).alias("dataset"))
    turn = F.pmod(F.col("facility_id").cast("int"), F.lit(4))
    asked = ids.withColumns(
        {
            "asked_id": F.when(turn == 3, F.lit("")).otherwise(F.col("facility_id")),
            "date_from": F.when(turn == 1, F.lit("1996-3-1")).otherwise(F.lit(DATE_FROM)),
            "date_to": F.when(turn == 2, F.lit(EARLY_TO)).otherwise(F.lit(DATE_TO)),
        }
    )
    return asked.select("facility_id", "dataset", SV.argument_fault("dataset", "date_from", "date_to", "asked_id").alias("fault"))


def page_without_names(spark, sf):
    """No dimension stored, so a facility page has no names and is served all the same."""
    frames = _frames(spark, sf)
    del frames.frames["plants"]
    return SV.get_dataset(frames, "facility", DATE_FROM, DATE_TO, None, PAGE_OFFSET, PAGE_LIMIT).data


def page_metadata(spark, sf):
    res = SV.get_dataset(_frames(spark, sf), "facility", DATE_FROM, None, FACILITY, META_OFFSET, META_LIMIT)
    return res.meta


def page_keyset(spark, sf):
    """The 50 rows after a given (date, facility) in newest-first order."""
    ds = DATASETS["facility"]
    after = {"date": D.parse_date_arg(KEYSET_DATE), "facility_id": KEYSET_FACILITY}
    pg = R.page_after(A.facility_outages(spark, sf), ds, after, KEYSET_LIMIT)
    return _text_dates(R.with_page_rank(pg, ds), "date")


def page_plan(spark, sf):
    return L.page_plan(spark, A.raw_facility_records(spark, sf).count(), PAGE_SIZE)


def page_numbers(spark, sf):
    ds = DATASETS["facility"]
    rows = A.facility_outages(spark, sf).select("date", "facility_id")
    numbered = number_pages(rows, R.sort_columns(ds), NUMBER_PAGE)
    return _text_dates(numbered, "date")


def page_walk(spark, sf):
    """L6 at the service level: every page of a filtered read, numbered once, names
    joined from a dimension that holds every id twice."""
    frames = _frames(spark, sf)
    plants = frames.frames["plants"]
    frames.frames["plants"] = plants.unionByName(plants.withColumn("facility_name", F.concat(F.lit("A "), "facility_name")))
    return SV.all_pages(frames, "facility", DATE_FROM, DATE_TO, None, PAGE_LIMIT)


def page_records(spark, sf):
    """F16 over rows with NULLs: capacities are missing on some days."""
    frames = _frames(spark, sf)
    fac = frames.frames["facility_outages"]
    frames.frames["facility_outages"] = fac.withColumn("capacity", F.when(F.dayofmonth("date") % 2 == 0, F.col("capacity")))
    return SV.page_records(SV.get_dataset(frames, "facility", None, None, FACILITY, 0, 25))


def page_walk_pinned(spark, sf):
    """All pages of the version that a reader has pinned, walked after three refreshes have replaced it."""
    root = shared_root(spark)
    landing, wh = _late_run(spark, sf, root)
    RF.refresh(spark, landing, wh)
    token = wh.pin()
    for run in (10, 11, 12):
        later = A.increment(A.facility_outages(spark, sf)).withColumn("outage", F.col("outage") + run)
        L.write_pages(A.raw_records_from(later, A.plants(spark, sf)), f"{landing.facility}/run-{run}")
        RF.refresh(spark, landing, wh, lookback_days=ALL_DAYS)
    return SV.all_pages(wh.at(token), "facility", DATE_FROM, None, None, PAGE_LIMIT).drop("facility_name")


def stored_page_deep(spark, sf):
    """L2 over a stored table: the page is found by the manifest's rows per date, only its months are opened."""
    wh = Warehouse(spark, f"{shared_root(spark)}/warehouse")
    wh.save_snapshot("facility", A.facility_outages(spark, sf))
    offset = int(wh.row_count("facility") * DEEP_SHARE)
    return SV.get_dataset(wh, "facility", None, None, None, offset, DEEP_LIMIT, max_limit=DEEP_LIMIT).data


def stored_counts(spark, sf):
    """A3-A5 of stored tables: the metadata of whole, bounded and empty reads, from the manifests."""
    wh = Warehouse(spark, f"{shared_root(spark)}/warehouse")
    for name, frame in _frames(spark, sf).frames.items():
        wh.save_snapshot(name, frame)
    out = None
    for name, start, end in (("facility", None, None), ("facility", DATE_FROM, DATE_TO), ("facility", "2030-01-01", None), ("us", None, EARLY_TO), ("plants", None, None)):
        meta = SV.get_dataset(wh, name, start, end, None, META_OFFSET, META_LIMIT).meta
        row = meta.select(F.lit(name).alias("dataset"), F.lit(start).cast("string").alias("date_from"), F.lit(end).cast("string").alias("date_to"), "*")
        row = row.withColumn("next_offset", F.coalesce("next_offset", F.lit(-1).cast("bigint")))
        out = row if out is None else out.unionByName(row)
    return out


# --- joins ---------------------------------------------------------------------


def filter_by_name(spark, sf):
    """P11 on the dimension: facts of the facilities whose name holds a digit five."""
    facts = R.filter_by_name(A.facility_outages(spark, sf), A.plants(spark, sf), F.contains("facility_name", F.lit("5")))
    return _text_dates(facts, "date")


def facility_with_names(spark, sf):
    return _text_dates(R.join_names_whole(A.facility_outages(spark, sf), A.plants(spark, sf)), "date")


def _reduced_plants(spark, sf):
    """The dimension without suppliers in debt: their facts have no name."""
    return A.plants_with_balance(spark, sf).where(F.col("balance") >= 0).select("facility_id", "facility_name")


def facility_unknown_names(spark, sf):
    return _text_dates(R.join_names_whole(A.facility_outages(spark, sf), _reduced_plants(spark, sf)), "date")


def name_lookup(spark, sf):
    ids = A.facility_outages(spark, sf).select("facility_id").distinct()
    return R.join_names_whole(ids, _reduced_plants(spark, sf))


def overview_all(spark, sf):
    results = SV.overview(_frames(spark, sf), DATE_FROM, DATE_TO, None, 0, OVERVIEW_LIMIT)
    return SV.overview_frame(results)


# --- series --------------------------------------------------------------------


def series_latest_n(spark, sf):
    # no lower bound: the chart's limit falls back to 250 (L9), for its five series
    return CMP.latest_series(_frames(spark, sf), SERIES_PICK, None, SERIES_TO, newest=CMP.chart_limit(None, SERIES_TO), max_series=CHART_SERIES)


def series_full_range(spark, sf):
    """The whole history of the picked series: no limit unless one is asked for."""
    return CMP.latest_series(_frames(spark, sf), SERIES_PICK)


def series_many(spark, sf):
    """All picked ids, not only the five of the chart, aligned over a range of years."""
    return CMP.compare_series(_frames(spark, sf), SERIES_PICK, None, SERIES_TO, include_us=True)


def series_labels(spark, sf):
    return CMP.series_labels(_frames(spark, sf), SERIES_PICK)


def series_aligned(spark, sf):
    return CMP.compare_series(_frames(spark, sf), SERIES_PICK, CHART_FROM, CHART_TO, include_us=True, newest=CMP.chart_limit(CHART_FROM, CHART_TO), max_series=CHART_SERIES)


def series_without_us(spark, sf):
    return CMP.compare_series(_frames(spark, sf), SERIES_PICK, CHART_FROM, CHART_TO, include_us=False, newest=CMP.chart_limit(CHART_FROM, CHART_TO), max_series=CHART_SERIES)


def series_all_long(spark, sf):
    """J3 / A9 over every facility: daily spines, with the gaps."""
    return _text_dates(SR.align_all(A.facility_outages(spark, sf)), "date")


def series_by_date(spark, sf):
    """Every facility's outage of a date in one map, as JSON in key order."""
    maps = SR.maps_by_date(A.facility_outages(spark, sf), "percent_outage")
    text = F.transform(F.array_sort(F.map_entries("series")), lambda e: F.concat(e["key"], F.lit(":"), F.format_number(e["value"], 2)))
    return _text_dates(maps.select("date", F.cardinality("series").cast("bigint").alias("n_series"), F.array_join(text, ";").alias("series")), "date")


def clamp_range(spark, sf):
    """F4-F9 and L9 over one range per facility and year (first to last day)."""
    fac = A.facility_outages(spark, sf)
    spans = fac.groupBy("facility_id", F.year("date").alias("year")).agg(
        F.min("date").alias("a"), F.max("date").alias("b")
    )
    # some ranges end before they start, some have no end
    turn = F.pmod(F.col("year") + F.col("facility_id").cast("int"), F.lit(3))
    spans = spans.select("facility_id", "year", F.when(turn == 1, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn == 1, F.col("a")).when(turn == 0, F.col("b")).alias("b"))
    out = spans.select(
        "facility_id",
        F.col("year").cast("bigint").alias("year"),
        format_date("a").alias("range_from"),
        format_date("b").alias("range_to"),
        format_date(D.clamp_to_after_from_edit("a", "b")).alias("to_after_from_edit"),
        format_date(D.clamp_from_after_to_edit("b", "a")).alias("from_after_to_edit"),
        F.coalesce(D.inclusive_days("a", "b"), F.lit(0)).cast("bigint").alias("day_count"),
        D.range_limit("a", "b").cast("bigint").alias("series_limit"),
        D.range_limit("b", "a").cast("bigint").alias("reversed_limit"),
        format_date(D.default_range_start("b")).alias("default_from"),
        format_date(D.earlier(D.add_days("a", 45), "b")).alias("earlier_end"),
    )
    return out


# --- display ---------------------------------------------------------------------


def display_us(spark, sf):
    return V.display_us(A.us_outages(spark, sf))


def display_facility(spark, sf):
    joined = R.join_names_whole(A.facility_outages(spark, sf), A.plants(spark, sf))
    return V.display_facility(joined)


# --- validation and transform ------------------------------------------------------


def validate_required(spark, sf):
    raw = A.raw_facility_records(spark, sf)
    return C.validate_records(raw, C.REQUIRED["facility"]).select("period", "facility", "facilityName")


def validate_report(spark, sf):
    raw = A.raw_facility_records(spark, sf)
    return C.quarantine(raw, C.REQUIRED["facility"]).select("period", "facility", "missing_fields")


def validate_counts(spark, sf):
    fac = C.validation_counts(A.raw_facility_records(spark, sf), C.REQUIRED["facility"]).withColumn(
        "dataset", F.lit("facility")
    )
    us = C.validation_counts(A.raw_us_records(spark, sf), C.REQUIRED["us"]).withColumn("dataset", F.lit("us"))
    return fac.unionByName(us)


def coerce_numeric(spark, sf):
    raw = A.raw_facility_records(spark, sf)
    return raw.select(
        "period",
        "facility",
        coerce_double("capacity").alias("capacity"),
        coerce_double("outage").alias("outage"),
        coerce_double("percentOutage").alias("percent_outage"),
    )


def transform_facility(spark, sf):
    return _text_dates(C.transform_records(A.raw_facility_records(spark, sf), "facility"), "date")


def transform_us(spark, sf):
    return _text_dates(C.transform_records(A.raw_us_records(spark, sf), "us"), "date")


def distinct_plants(spark, sf):
    return C.distinct_plants(C.transform_records(A.raw_facility_records(spark, sf), "facility"))


# --- watermarks and increments -----------------------------------------------------


def watermark(spark, sf):
    fac = S.watermark(A.facility_outages(spark, sf)).withColumn("dataset", F.lit("facility_outages"))
    us = S.watermark(A.us_outages(spark, sf)).withColumn("dataset", F.lit("us_outages"))
    plants = fac.withColumn("dataset", F.lit("plants"))  # a full load gives plants the facility mark
    out = fac.unionByName(us).unionByName(plants)
    return _text_dates(out, "last_extraction_date")


def watermark_advance(spark, sf):
    """A2: a stale stored mark (30 days behind) moved by the increment; an empty
    batch leaves the other mark alone."""
    rows = []
    for name, frame in (("facility_outages", A.facility_outages(spark, sf)), ("us_outages", A.us_outages(spark, sf))):
        inc = A.increment(frame)
        if name == "us_outages":
            inc = inc.where(F.lit(False))  # an empty batch
        old = F.date_sub(frame.select(F.max("date")).scalar(), LOOKBACK_DAYS)
        batch = S.watermark(inc, "batch_max")
        rows.append(
            batch.select(
                F.lit(name).alias("dataset"),
                format_date(old).alias("stored"),
                format_date("batch_max").alias("batch_max"),
                format_date(S.advance(old, F.col("batch_max"))).alias("advanced"),
            )
        )
    return rows[0].unionByName(rows[1])


def incremental_rows(spark, sf):
    fac = A.facility_outages(spark, sf)
    start = F.date_sub(fac.select(F.max("date")).scalar(), LOOKBACK_DAYS)
    raw = A.raw_facility_records(spark, sf)
    return L.filter_period(raw, start).select("period", "facility", "facilityName")


def upsert_facility(spark, sf):
    base = A.facility_outages(spark, sf)
    out = upsert(base, A.increment(base), MERGE_KEYS["facility_outages"])
    return _text_dates(out, "date")


def upsert_us(spark, sf):
    base = A.us_outages(spark, sf)
    return _text_dates(upsert(base, A.increment(base), MERGE_KEYS["us_outages"]), "date")


def upsert_plants(spark, sf):
    """Stale names for suppliers not in debt, replaced or completed by the names
    of the landed facility records."""
    base = _reduced_plants(spark, sf).withColumn("facility_name", F.concat("facility_name", F.lit(" (old)")))
    batch = C.transform_records(A.raw_facility_records(spark, sf).withColumn("seq", F.lit(0)), "facility")
    return upsert(base, dimension_from_batch(batch), MERGE_KEYS["plants"])


def upsert_changes(spark, sf):
    """M1's change feed: doubled, moved and unchanged rows, with what each does to its key."""
    base = A.facility_outages(spark, sf)
    inc = A.increment(base)
    same = base.where(F.col("date") <= DATE_FROM).withColumn("outage", F.when(F.dayofmonth("date") == 1, F.lit(None)).otherwise(F.col("outage")))
    return _text_dates(change_kinds(base, inc.unionByName(same), MERGE_KEYS["facility_outages"]).select("date", "facility_id", "kind", "outage"), "date")


def upsert_last_wins(spark, sf):
    base = A.facility_outages(spark, sf)
    inc = A.increment(base)
    first = inc.withColumn("seq", F.lit(1))
    second = inc.withColumn("outage", F.col("outage") + F.lit(1.0)).withColumn("seq", F.lit(2))
    batch = last_wins(first.unionByName(second), MERGE_KEYS["facility_outages"])
    return _text_dates(upsert(base, batch, MERGE_KEYS["facility_outages"]), "date")


def upsert_twice(spark, sf):
    base = A.facility_outages(spark, sf)
    inc = A.increment(base)
    once = upsert(base, inc, MERGE_KEYS["facility_outages"])
    return _text_dates(upsert(once, inc, MERGE_KEYS["facility_outages"]), "date")


# --- landing, refresh, snapshots, stream (write to the shared folder) ----------------


def _land(spark, sf, root: str) -> RF.Landing:
    """Land the source-shaped records as pages (the source's own order is unspecified)."""
    L.write_pages(A.raw_facility_records(spark, sf), f"{root}/landing/facility/batch-0001")
    L.write_pages(A.raw_us_records(spark, sf), f"{root}/landing/us/batch-0001")
    return RF.Landing(f"{root}/landing/facility", f"{root}/landing/us")


def _land_increment(spark, sf, root: str) -> None:
    raw = A.raw_records_from(A.increment(A.facility_outages(spark, sf)), A.plants(spark, sf))
    L.write_pages(raw, f"{root}/landing/facility/batch-0002")


def landed_pages(spark, sf):
    root = shared_root(spark)
    landing = _land(spark, sf, root)
    return L.landed_records(spark, landing.facility).select("period", "facility", "facilityName")


def refresh_summary(spark, sf):
    root = shared_root(spark)
    landing = _land(spark, sf, root)
    return RF.refresh(spark, landing, Warehouse(spark, f"{root}/warehouse"))


def refresh_then_increment(spark, sf):
    root = shared_root(spark)
    landing = _land(spark, sf, root)
    wh = Warehouse(spark, f"{root}/warehouse")
    RF.refresh(spark, landing, wh)  # full
    _land_increment(spark, sf, root)
    RF.refresh(spark, landing, wh, lookback_days=LOOKBACK_DAYS)  # incremental
    return _text_dates(wh.load_snapshot("facility"), "date")


def _root(spark) -> str:
    return shared_root(spark)


def _wide(fac: DataFrame, names: DataFrame, folder: str, times: float, first_offset: int, total: int) -> None:
    raw = A.raw_records_from(fac.withColumn("outage", F.col("outage") * times), names)
    L.land(L.page_texts(raw, None, PAGE_SIZE, first_offset, total), folder)


def incremental_flat_landing(spark, sf):
    """Pages directly in the landing folder: what lands after the full load is read too."""
    root = _root(spark)
    raw = A.raw_facility_records(spark, sf)
    landing = RF.Landing(f"{root}/landing", f"{root}/none")
    wh = Warehouse(spark, f"{root}/warehouse")
    L.write_pages(raw.where(F.col("period") < SPLIT_DATE), landing.facility)
    RF.refresh(spark, landing, wh)
    L.write_pages(raw.where(F.col("period") >= SPLIT_DATE), landing.facility, mode="append")
    RF.refresh(spark, landing, wh)
    return _text_dates(wh.load_snapshot("facility"), "date")


def _late_run(spark, sf, wh_root: str) -> tuple[RF.Landing, Warehouse]:
    """``run-9`` fully loaded, then ``run-10``: corrections before the watermark, which
    must not be applied, corrections of the watermark day and new days, which must."""
    landing = RF.Landing(f"{wh_root}/landing/facility", f"{wh_root}/landing/us")
    L.write_pages(A.raw_facility_records(spark, sf), f"{landing.facility}/run-9")
    L.write_pages(A.raw_us_records(spark, sf), f"{landing.us}/run-9")
    return landing, Warehouse(spark, f"{wh_root}/warehouse")


def _land_run_10(spark, sf, landing: RF.Landing) -> None:
    L.write_pages(A.raw_records_from(A.increment(A.facility_outages(spark, sf)), A.plants(spark, sf)), f"{landing.facility}/run-10")


def incremental_late_run(spark, sf):
    landing, wh = _late_run(spark, sf, _root(spark))
    RF.refresh(spark, landing, wh)
    _land_run_10(spark, sf, landing)
    RF.refresh(spark, landing, wh)
    return _text_dates(wh.load_snapshot("facility"), "date")


def refresh_modes(spark, sf):
    """Mode, rows and watermark of every table after a full, an incremental and a recovery run."""
    landing, wh = _late_run(spark, sf, _root(spark))
    out = None
    for step in (1, 2, 3):
        if step == 2:
            _land_run_10(spark, sf, landing)
        if step == 3:
            wh.drop_base_tables()
        done = RF.refresh(spark, landing, wh).select("mode", "dataset", "rows_processed")
        marks = spark.createDataFrame(list(S.load_state(wh).items()), "dataset string, last_extraction_date date")
        rows = done.join(marks, "dataset").withColumn("step", F.lit(step).cast("bigint"))
        out = rows if out is None else out.unionByName(rows)
    return _text_dates(out, "last_extraction_date")


def incremental_gap_filled(spark, sf):
    """A run whose second page lands after the first refresh: nothing behind the gap is lost."""
    root = _root(spark)
    landing = RF.Landing(f"{root}/landing", f"{root}/none", page_size=GAP_PAGE)
    wh = Warehouse(spark, f"{root}/warehouse")
    pages = L.stage_pages(L.page_texts(A.raw_facility_records(spark, sf), None, GAP_PAGE), "gap-pages", GAP_PAGE)
    L.land(pages.where(F.col("offset") != GAP_PAGE), f"{landing.facility}/run-1")
    RF.refresh(spark, landing, wh)
    L.land(pages.where(F.col("offset") == GAP_PAGE), f"{landing.facility}/run-1", "append")
    RF.refresh(spark, landing, wh)
    return _text_dates(wh.load_snapshot("facility"), "date")


def incremental_reread_run(spark, sf):
    """A page of ``run-1`` lands after ``run-2`` has corrected its days: the corrections stay."""
    root = _root(spark)
    landing = RF.Landing(f"{root}/landing", f"{root}/none", page_size=GAP_PAGE)
    wh = Warehouse(spark, f"{root}/warehouse")
    pages = L.stage_pages(L.page_texts(A.raw_facility_records(spark, sf), None, GAP_PAGE), "reread-pages", GAP_PAGE)
    L.land(pages.where(F.col("offset") != GAP_PAGE), f"{landing.facility}/run-1")
    RF.refresh(spark, landing, wh)
    fixes = A.raw_records_from(A.increment(A.facility_outages(spark, sf)), A.plants(spark, sf))
    L.write_pages(fixes, f"{landing.facility}/run-2", page_size=GAP_PAGE)
    RF.refresh(spark, landing, wh, lookback_days=ALL_DAYS)
    L.land(pages.where(F.col("offset") == GAP_PAGE), f"{landing.facility}/run-1", "append")
    RF.refresh(spark, landing, wh)
    return _text_dates(wh.load_snapshot("facility"), "date")


def incremental_flat_correction(spark, sf):
    """Pages directly in the landing folder, corrected by pages that land later with lower offsets."""
    root = _root(spark)
    landing = RF.Landing(f"{root}/landing", f"{root}/none")
    wh = Warehouse(spark, f"{root}/warehouse")
    L.write_pages(A.raw_facility_records(spark, sf), landing.facility)
    RF.refresh(spark, landing, wh)
    L.write_pages(A.raw_records_from(A.increment(A.facility_outages(spark, sf)), A.plants(spark, sf)), landing.facility, mode="append")
    RF.refresh(spark, landing, wh, lookback_days=ALL_DAYS)
    return _text_dates(wh.load_snapshot("facility"), "date")


def landed_broken_pages(spark, sf):
    """What a refresh records of a run whose second page of three is cut off and whose third has no response."""
    root = _root(spark)
    landing = RF.Landing(f"{root}/landing", f"{root}/none", page_size=GAP_PAGE)
    pages = L.stage_pages(L.page_texts(A.raw_facility_records(spark, sf), None, GAP_PAGE), "broken-pages", GAP_PAGE)
    L.land(pages, f"{landing.facility}/run-1")
    turn, text = F.pmod(F.floor(F.col("offset") / GAP_PAGE), F.lit(3)), F.col("value")
    error = F.to_json(F.struct("offset", F.lit("busy").alias("error")))
    cut = F.when(turn == 1, F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))).when(turn == 2, error).otherwise(text)
    L.land(pages.select(cut.alias("value")), f"{landing.facility}/run-2")
    wh = Warehouse(spark, f"{root}/warehouse")
    RF.refresh(spark, landing, wh)
    read = S.load_progress(wh, "facility_outages")
    return read.groupBy("run", "state", F.substring_index("broken", ":", 1).alias("reason")).agg(F.count("*").alias("pages"), F.count("offset").alias("placed"))


def refresh_quality_report(spark, sf):
    """What a full and a late incremental refresh stored as rejected or not convertible, by reason."""
    landing, wh = _late_run(spark, sf, _root(spark))
    RF.refresh(spark, landing, wh)
    _land_run_10(spark, sf, landing)
    RF.refresh(spark, landing, wh)
    rows = S.load_rejected(wh, "facility_outages").withColumn("dataset", F.lit("facility_outages"))
    rows = rows.unionByName(S.load_rejected(wh, "us_outages").withColumn("dataset", F.lit("us_outages")))
    return rows.groupBy("dataset", "run", "kind", "reason").agg(F.count("*").alias("records"), F.countDistinct("period").alias("days"))


def held_pages(spark, sf):
    """How many pages a refresh reports as held behind the missing second page."""
    pages = L.page_envelopes(A.raw_facility_records(spark, sf), None, GAP_PAGE).where(F.col("offset") != GAP_PAGE)
    root = f"{_root(spark)}/landing"
    pages.write.json(f"{root}/run-1")
    return L.page_states(L.stage_pages(L.read_pages(spark, root), "held-pages", GAP_PAGE), GAP_PAGE).groupBy("state").agg(F.count("*").alias("pages"))


def last_wins_by_page(spark, sf):
    """A key on two pages of a run: the later page wins, whatever its file is called."""
    root = _root(spark)
    landing = RF.Landing(f"{root}/landing", f"{root}/none")
    fac, names = A.facility_outages(spark, sf), A.plants(spark, sf)
    pages = -(-fac.count() // PAGE_SIZE)
    _wide(fac, names, f"{landing.facility}/run-1/z", 1.0, 0, 2 * pages * PAGE_SIZE)
    _wide(fac, names, f"{landing.facility}/run-1/a", 2.0, pages * PAGE_SIZE, 2 * pages * PAGE_SIZE)
    wh = Warehouse(spark, f"{root}/warehouse")
    RF.refresh(spark, landing, wh)
    return _text_dates(wh.load_snapshot("facility").select("date", "facility_id", "outage"), "date")


def full_refresh_absent_landing(spark, sf):
    """A full run without any landing keeps the tables."""
    root = _root(spark)
    landing = _land(spark, sf, root)
    wh = Warehouse(spark, f"{root}/warehouse")
    RF.refresh(spark, landing, wh)
    RF.refresh(spark, RF.Landing(f"{root}/none", f"{root}/none"), wh, mode="full")
    return _text_dates(wh.load_base("facility"), "date")


def landed_range(spark, sf):
    """S3: both bounds of a source range."""
    root = f"{_root(spark)}/landing"
    L.write_pages(A.raw_facility_records(spark, sf), f"{root}/run-1")
    return L.landed_records(spark, root, D.parse_date_arg(DATE_FROM), D.parse_date_arg(DATE_TO)).select("period", "facility", "facilityName")


def landed_range_indexed(spark, sf):
    """S3 after a refresh: only the files with pages of the range are opened (pages land in date order here)."""
    root = _root(spark)
    landing = RF.Landing(f"{root}/landing", f"{root}/none", page_size=GAP_PAGE)
    raw = A.raw_facility_records(spark, sf)
    texts = L.page_texts(raw, [F.col("period"), F.col("facility")], GAP_PAGE)
    texts.repartitionByRange(16, "offset").select("value").write.text(f"{landing.facility}/run-1")  # few large files: not compressed, so that they can be split
    wh = Warehouse(spark, f"{root}/warehouse")
    RF.refresh(spark, landing, wh)
    found = RF.landed_between(spark, landing, "facility", wh, D.parse_date_arg(DATE_FROM), D.parse_date_arg(DATE_TO))
    return found.select("period", "facility", "facilityName")


def quarantine_bad_dates(spark, sf):
    """Records with a shortened date, a missing capacity, a missing name, or several of these."""
    raw = A.raw_facility_records(spark, sf)
    day = F.dayofyear(F.to_date("period"))
    bad = raw.withColumns(
        {
            "period": F.when(day % 71 == 0, F.substring("period", 1, 7)).otherwise(F.col("period")),
            "capacity": F.when(day % 24 == 0, F.lit(None)).otherwise(F.col("capacity")),
        }
    )
    return C.quarantine(bad, C.REQUIRED["facility"]).select("period", "facility", "missing_fields")


def recover_base(spark, sf):
    """The base comes back from the published snapshot, which here differs from the landing."""
    root = shared_root(spark)
    landing = _land(spark, sf, root)
    wh = Warehouse(spark, f"{root}/warehouse")
    RF.refresh(spark, landing, wh)
    wh.save_snapshot("facility", wh.load_base("facility").withColumn("outage", F.col("outage") + 1.0))
    wh.drop_base_tables()
    RF.refresh(spark, landing, wh)  # base gone, snapshots present -> recovery
    return _text_dates(wh.load_base("facility"), "date")


def refreshed_us(spark, sf):
    root = shared_root(spark)
    landing = _land(spark, sf, root)
    wh = Warehouse(spark, f"{root}/warehouse")
    RF.refresh(spark, landing, wh)
    return _text_dates(wh.load_snapshot("us"), "date")


def refreshed_plants(spark, sf):
    root = shared_root(spark)
    landing = _land(spark, sf, root)
    wh = Warehouse(spark, f"{root}/warehouse")
    RF.refresh(spark, landing, wh)
    return wh.load_snapshot("plants")


def stored_facility(spark, sf):
    """S11 over the month-partitioned table, read with a facility filter (row groups skipped)."""
    wh = Warehouse(spark, f"{shared_root(spark)}/warehouse")
    wh.save_snapshot("facility", A.facility_outages(spark, sf))
    return SV.get_dataset(wh, "facility", DATE_FROM, DATE_TO, FACILITY, 0, 100).data.drop("facility_name")


def stream_us(spark, sf):
    """R3 for the national series."""
    from reactorlake.streaming.refresh_stream import run_available

    root = shared_root(spark)
    L.write_pages(A.raw_us_records(spark, sf), f"{root}/landing/us/batch-0001")
    wh = Warehouse(spark, f"{root}/warehouse")
    run_available(spark, f"{root}/landing/us", "us", wh)
    return _text_dates(wh.load_snapshot("us"), "date")


def stream_refresh(spark, sf):
    from reactorlake.streaming.refresh_stream import run_available

    root = shared_root(spark)
    L.write_pages(A.raw_facility_records(spark, sf), f"{root}/landing/facility/batch-0001")
    wh = Warehouse(spark, f"{root}/warehouse")
    run_available(spark, f"{root}/landing/facility", "facility", wh)
    return _text_dates(wh.load_snapshot("facility"), "date")


def stream_gap_filled(spark, sf):
    """The stop rules of the stream: a run whose second page arrives in a later micro-batch."""
    from reactorlake.streaming.refresh_stream import run_available

    root = shared_root(spark)
    pages = L.stage_pages(L.page_texts(A.raw_facility_records(spark, sf), None, GAP_PAGE), "stream-gap-pages", GAP_PAGE)
    wh = Warehouse(spark, f"{root}/warehouse")
    L.land(pages.where(F.col("offset") != GAP_PAGE), f"{root}/landing/run-1")
    run_available(spark, f"{root}/landing", "facility", wh, page_size=GAP_PAGE)
    L.land(pages.where(F.col("offset") == GAP_PAGE), f"{root}/landing/run-1", "append")
    run_available(spark, f"{root}/landing", "facility", wh, page_size=GAP_PAGE)
    return _text_dates(wh.load_snapshot("facility"), "date")


def stream_late_rows(spark, sf):
    """A stream that takes rows up to 30 days behind its watermark, and where older ones go."""
    from reactorlake.streaming.refresh_stream import run_available

    root = shared_root(spark)
    landing = f"{root}/landing"
    wh = Warehouse(spark, f"{root}/warehouse")
    fac, names = A.facility_outages(spark, sf), A.plants(spark, sf)
    L.write_pages(A.raw_records_from(fac.where(F.year("date") % 2 == 0), names), f"{landing}/run-1")
    run_available(spark, landing, "facility", wh, lateness_days=LOOKBACK_DAYS)
    L.write_pages(A.raw_records_from(fac, names), f"{landing}/run-2")
    run_available(spark, landing, "facility", wh, lateness_days=LOOKBACK_DAYS)
    stored = wh.load_snapshot("facility").agg(F.lit("stored").alias("kind"), F.count("*").alias("records"), F.max("date").alias("newest"))
    late = S.load_rejected(wh, "facility_outages").where(F.col("kind") == "late")
    return _text_dates(stored.unionByName(late.groupBy("kind").agg(F.count("*").alias("records"), F.max(F.to_date("period")).alias("newest"))), "newest")


def snapshot_roundtrip(spark, sf):
    wh = Warehouse(spark, f"{shared_root(spark)}/warehouse")
    wh.save_snapshot("us", A.us_outages(spark, sf))
    return _text_dates(wh.load_snapshot("us"), "date")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_facility": scan_facility,
    "scan_us": scan_us,
    "scan_plants": scan_plants,
    "filter_date_from": filter_date_from,
    "filter_date_to": filter_date_to,
    "filter_date_range": filter_date_range,
    "filter_facility": filter_facility,
    "filter_map": filter_map,
    "page_facility": page_facility,
    "page_us": page_us,
    "page_plants": page_plants,
    "page_deep": page_deep,
    "page_metadata": page_metadata,
    "page_keyset": page_keyset,
    "page_plan": page_plan,
    "page_numbers": page_numbers,
    "page_walk": page_walk,
    "page_records": page_records,
    "facility_with_names": facility_with_names,
    "facility_unknown_names": facility_unknown_names,
    "name_lookup": name_lookup,
    "overview_all": overview_all,
    "series_latest_n": series_latest_n,
    "series_aligned": series_aligned,
    "series_without_us": series_without_us,
    "clamp_range": clamp_range,
    "display_us": display_us,
    "display_facility": display_facility,
    "validate_required": validate_required,
    "validate_report": validate_report,
    "validate_counts": validate_counts,
    "coerce_numeric": coerce_numeric,
    "transform_facility": transform_facility,
    "transform_us": transform_us,
    "distinct_plants": distinct_plants,
    "watermark": watermark,
    "watermark_advance": watermark_advance,
    "incremental_rows": incremental_rows,
    "upsert_facility": upsert_facility,
    "upsert_us": upsert_us,
    "upsert_plants": upsert_plants,
    "upsert_last_wins": upsert_last_wins,
    "upsert_twice": upsert_twice,
    "landed_pages": landed_pages,
    "refresh_summary": refresh_summary,
    "refresh_then_increment": refresh_then_increment,
    "recover_base": recover_base,
    "stream_refresh": stream_refresh,
    "snapshot_roundtrip": snapshot_roundtrip,
    "page_clamped": page_clamped,
    "page_rest": page_rest,
    "page_arguments": page_arguments,
    "page_without_names": page_without_names,
    "series_full_range": series_full_range,
    "series_many": series_many,
    "series_labels": series_labels,
    "incremental_flat_landing": incremental_flat_landing,
    "incremental_late_run": incremental_late_run,
    "refresh_modes": refresh_modes,
    "incremental_gap_filled": incremental_gap_filled,
    "held_pages": held_pages,
    "last_wins_by_page": last_wins_by_page,
    "full_refresh_absent_landing": full_refresh_absent_landing,
    "landed_range": landed_range,
    "quarantine_bad_dates": quarantine_bad_dates,
    "refreshed_us": refreshed_us,
    "refreshed_plants": refreshed_plants,
    "stored_facility": stored_facility,
    "stream_us": stream_us,
    "incremental_reread_run": incremental_reread_run,
    "incremental_flat_correction": incremental_flat_correction,
    "landed_broken_pages": landed_broken_pages,
    "refresh_quality_report": refresh_quality_report,
    "stream_gap_filled": stream_gap_filled,
    "stream_late_rows": stream_late_rows,
    "page_walk_pinned": page_walk_pinned,
    "stored_page_deep": stored_page_deep,
    "stored_counts": stored_counts,
    "filter_by_name": filter_by_name,
    "series_all_long": series_all_long,
    "series_by_date": series_by_date,
    "upsert_changes": upsert_changes,
    "landed_range_indexed": landed_range_indexed,
}
