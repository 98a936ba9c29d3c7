"""The paged read service."""

from __future__ import annotations

import datetime as dt

import pytest

from reactorlake.errors import DataNotFoundError, ValidationError
from reactorlake.operators import read as R
from reactorlake.plans.service import FrameCatalog, get_dataset, overview, overview_frame, page_records
from reactorlake.schemas import DATASETS


def _catalog(facility_df, us_df, plants_df):
    return FrameCatalog(
        {"facility_outages": facility_df.drop("facility_name"), "us_outages": us_df, "plants": plants_df}
    )


@pytest.mark.parametrize(
    "kwargs",
    [
        {"dataset": "invalid_dataset"},
        {"dataset": "facility", "offset": -1},
        {"dataset": "facility", "limit": 0},
        {"dataset": "us", "facility_id": "F001"},
        {"dataset": "facility", "date_from": "invalid-date"},
        {"dataset": "facility", "date_to": "bad-date"},
        {"dataset": "facility", "date_from": "bad-date", "date_to": "2024-01-01"},
        {"dataset": "facility", "date_from": "2024-12-31", "date_to": "2024-01-01"},
        {"dataset": "facility", "date_from": "2024-1-5"},
    ],
)
def test_bad_arguments(facility_df, us_df, plants_df, kwargs):
    with pytest.raises(ValidationError):
        get_dataset(_catalog(facility_df, us_df, plants_df), **kwargs)


def test_limit_clamp(facility_df, us_df, plants_df):
    res = get_dataset(_catalog(facility_df, us_df, plants_df), "facility", limit=5000)
    assert res.meta.first()["limit"] == 1000


def test_paging_twenty_rows(spark):
    rows = [(dt.date(2024, 1, i + 1), 100.0, float(i), 1.0) for i in range(20)]
    us = spark.createDataFrame(rows, "date date, capacity double, outage double, percent_outage double")
    cat = FrameCatalog({"us_outages": us})
    res = get_dataset(cat, "us", offset=5, limit=5)
    meta = res.meta.first()
    assert (meta["total_count"], meta["returned"], meta["next_offset"]) == (20, 5, 10)
    dates = [r["date"] for r in res.data.collect()]
    assert dates == ["2024-01-15", "2024-01-14", "2024-01-13", "2024-01-12", "2024-01-11"]
    past = get_dataset(cat, "us", offset=25, limit=5)
    assert past.data.count() == 0 and past.meta.first()["next_offset"] is None


def test_facility_filter(spark, plants_df):
    rows = [
        (dt.date(2024, 1, 1), "F001", 1.0, 1.0, 1.0),
        (dt.date(2024, 1, 2), "F002", 1.0, 1.0, 1.0),
        (dt.date(2024, 1, 3), "F001", 1.0, 1.0, 1.0),
    ]
    fac = spark.createDataFrame(rows, "date date, facility_id string, capacity double, outage double, percent_outage double")
    res = get_dataset(FrameCatalog({"facility_outages": fac, "plants": plants_df}), "facility", facility_id="F001")
    assert res.meta.first()["total_count"] == 2
    assert {r["facility_id"] for r in res.data.collect()} == {"F001"}


def test_name_join_and_missing_dimension(facility_df, us_df, plants_df):
    res = get_dataset(_catalog(facility_df, us_df, plants_df), "facility")
    rows = res.data.collect()
    assert "facility_name" in res.data.columns
    assert {r["facility_id"]: r["facility_name"] for r in rows}["F002"] == "Plant B"
    no_dim = FrameCatalog({"facility_outages": facility_df.drop("facility_name")})
    res2 = get_dataset(no_dim, "facility")
    assert "facility_name" not in res2.data.columns and res2.data.count() == 5


def test_unknown_dimension_id_gives_null_name(spark, plants_df):
    fac = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "F999", 1.0, 1.0, 1.0)],
        "date date, facility_id string, capacity double, outage double, percent_outage double",
    )
    res = get_dataset(FrameCatalog({"facility_outages": fac, "plants": plants_df}), "facility")
    assert res.data.first()["facility_name"] is None


def test_duplicate_dimension_ids_do_not_grow_the_page(spark, facility_df, plants_df):
    dup = plants_df.unionByName(spark.createDataFrame([("F001", "Plant A2")], plants_df.schema))
    res = get_dataset(FrameCatalog({"facility_outages": facility_df.drop("facility_name"), "plants": dup}), "facility", limit=3)
    assert res.data.count() == 3 and res.meta.first()["returned"] == 3


def test_plants_paging_ignores_dates(facility_df, us_df, plants_df):
    cat = _catalog(facility_df, us_df, plants_df)
    res = get_dataset(cat, "plants", limit=2)
    assert res.meta.first()["total_count"] == 3 and res.data.count() == 2
    res = get_dataset(cat, "plants", date_from="2024-01-01", date_to="2024-01-02")
    assert res.data.count() == 3
    assert [r["facility_id"] for r in res.data.collect()] == ["F001", "F002", "F003"]


def test_missing_dataset(facility_df):
    with pytest.raises(DataNotFoundError):
        get_dataset(FrameCatalog({}), "us")


def test_newest_first_with_stable_ties(spark):
    rows = [(dt.date(2024, 1, 1), f"F{i:03d}", 1.0, 1.0, 1.0) for i in (3, 1, 2)]
    fac = spark.createDataFrame(rows, "date date, facility_id string, capacity double, outage double, percent_outage double")
    res = get_dataset(FrameCatalog({"facility_outages": fac}), "facility")
    assert [r["facility_id"] for r in res.data.collect()] == ["F001", "F002", "F003"]


def test_a_deep_page_scans_only_its_dates(spark):
    """One plan for every depth: counts per date find the dates, and only they are sorted."""
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 40), f"F{i // 40}", 1.0, float(i), 1.0) for i in range(280)]
    fac = spark.createDataFrame(rows, "date date, facility_id string, capacity double, outage double, percent_outage double")
    full = [(r["date"], r["facility_id"]) for r in fac.orderBy(fac.date.desc(), "facility_id").collect()]
    for offset, limit in ((0, 5), (100, 30), (273, 7), (279, 1)):
        got = [(r["date"], r["facility_id"]) for r in R.page(fac, DATASETS["facility"], offset, limit).collect()]
        assert got == full[offset : offset + limit]
    assert R.locate(fac, 100, 30) == (dt.date(2024, 1, 26), dt.date(2024, 1, 22), 2)
    assert R.page(fac, DATASETS["facility"], 280, 5).count() == 0


def test_reads_write_nothing(spark, scratch, facility_df, us_df, plants_df):
    from reactorlake.sources.tables import path_exists, shared_root

    before = path_exists(spark, shared_root(spark, "_stage"))
    cat = _catalog(facility_df, us_df, plants_df)
    res = get_dataset(cat, "facility", limit=5000)
    assert res.data.count() == 5 and res.meta.first()["limit_clamped"]
    assert path_exists(spark, shared_root(spark, "_stage")) == before


def test_repeated_dimension_ids_never_grow_a_result(facility_df, us_df, plants_df):
    from reactorlake.plans.service import all_pages

    cat = _catalog(facility_df, us_df, plants_df.unionByName(plants_df))
    assert all_pages(cat, "facility", limit=2).count() == 5
    assert get_dataset(cat, "facility").data.count() == 5


def test_pages_concatenate_to_the_full_sort(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 13), f"F{i % 5}", 1.0, float(i), 1.0) for i in range(65)]
    fac = spark.createDataFrame(rows, "date date, facility_id string, capacity double, outage double, percent_outage double")
    cat = FrameCatalog({"facility_outages": fac})
    got, offset, total = [], 0, None
    while True:
        res = get_dataset(cat, "facility", offset=offset, limit=10)
        meta = res.meta.first()
        total = meta["total_count"]
        got += [(r["date"], r["facility_id"]) for r in res.data.collect()]
        if meta["next_offset"] is None:
            break
        offset = meta["next_offset"]
    full = [(r["date"].isoformat(), r["facility_id"]) for r in fac.orderBy(fac.date.desc(), "facility_id").collect()]
    assert got == full and len(got) == total


def test_generic_predicate_map(facility_df):
    df = R.filter_map(facility_df, {"date": (dt.date(2024, 1, 2), dt.date(2024, 1, 4)), "facility_id": "F002"})
    assert df.count() == 2
    with pytest.raises(ValidationError):
        R.filter_map(facility_df, {"nope": 1})


def test_overview_and_records(facility_df, us_df, plants_df):
    cat = _catalog(facility_df, us_df, plants_df)
    results = overview(cat, "2024-01-02", "2024-01-03")
    assert set(results) == {"facility", "us", "plants"}
    frame = overview_frame(results)
    counts = {r["dataset"]: r["total_count"] for r in frame.select("dataset", "total_count").distinct().collect()}
    assert counts == {"facility": 2, "us": 2, "plants": 3}
    only = overview(cat, facility_id="F001")
    assert set(only) == {"facility"}
    rec = page_records(get_dataset(cat, "facility", limit=1)).first()["record"]
    assert rec.startswith('{"facility_id":"F003","date":"2024-01-05"')


def test_sort_columns_are_a_total_order():
    for ds in DATASETS.values():
        assert set(ds.keys) <= {c for c, _ in ds.order}


def test_keyset_pages_walk_the_same_order(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 9), f"F{i % 4}", 1.0, float(i), 1.0) for i in range(36)]
    fac = spark.createDataFrame(rows, "date date, facility_id string, capacity double, outage double, percent_outage double")
    ds = DATASETS["facility"]
    got, after = [], None
    while True:
        page = R.page_after(fac, ds, after, 7).collect()
        if not page:
            break
        got += [(r["date"], r["facility_id"]) for r in page]
        after = {"date": page[-1]["date"], "facility_id": page[-1]["facility_id"]}
    full = [(r["date"], r["facility_id"]) for r in fac.orderBy(fac.date.desc(), "facility_id").collect()]
    assert got == full


def test_date_bounds_prune_month_folders(spark, scratch, facility_df):
    from reactorlake.sources.tables import Warehouse

    wh = Warehouse(spark, f"{scratch}/wh")
    wh.save_snapshot("facility", facility_df.drop("facility_name"))
    df = wh.load("facility", dt.date(2024, 1, 2), None)
    assert len(df.inputFiles()) >= 1 and all("ym=2024-01" in f for f in df.inputFiles())
    assert df.count() == 5  # month-level pruning only; the exact date filter is the caller's
    late = wh.load("facility", dt.date(2024, 2, 1), None)
    assert late.inputFiles() == [] and late.count() == 0  # no other month is opened


def test_offset_without_limit_returns_the_rest(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), f"F{i % 3}", 1.0, float(i), 1.0) for i in range(12)]
    fac = spark.createDataFrame(rows, "date date, facility_id string, capacity double, outage double, percent_outage double")
    rest = R.page(fac, DATASETS["facility"], 9, None).collect()
    assert [r["outage"] for r in rest] == [2.0, 1.0, 0.0]


def test_materialize_and_stage_scope(spark):
    from reactorlake.sources.tables import materialize, path_exists, stage_scope

    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "a", (1, "x"))], "d date, s string, seq struct<o:int,f:string>"
    )
    with stage_scope(spark) as root:
        staged = materialize(df, "t")
        assert staged.schema == df.schema
        assert [tuple(r) for r in staged.collect()] == [tuple(r) for r in df.collect()]
        assert path_exists(spark, root)
    assert not path_exists(spark, root)


def test_all_pages_equals_walking_offsets(facility_df, us_df, plants_df):
    from reactorlake.plans.service import all_pages

    cat = _catalog(facility_df, us_df, plants_df)
    numbered = all_pages(cat, "facility", limit=2)
    by_page = {}
    for r in numbered.collect():
        by_page.setdefault(r["page_no"], []).append((r["page_pos"], r["date"], r["facility_id"], r["facility_name"]))
    walked, offset = [], 0
    while True:
        res = get_dataset(cat, "facility", offset=offset, limit=2)
        walked.append([(r["page_rank"], r["date"], r["facility_id"], r["facility_name"]) for r in res.data.collect()])
        nxt = res.meta.first()["next_offset"]
        if nxt is None:
            break
        offset = nxt
    assert [sorted(by_page[k]) for k in sorted(by_page)] == walked


def test_unreadable_files_are_a_processing_error(spark, scratch, facility_df):
    from reactorlake.errors import ProcessingError
    from reactorlake.sources.tables import Warehouse

    wh = Warehouse(spark, f"{scratch}/wh")
    wh.save_snapshot("facility", facility_df.drop("facility_name"))
    for path in wh.load("facility").inputFiles():
        local = path.removeprefix("file://")
        with open(local, "wb") as fh:
            fh.write(b"no parquet")
    with pytest.raises(ProcessingError):
        get_dataset(wh, "facility")
    with pytest.raises(DataNotFoundError):
        get_dataset(wh, "us")


def test_argument_faults_agree_with_the_checked_read(spark):
    from reactorlake.errors import ValidationError
    from reactorlake.plans import service as SV

    values = [None, "", "2024-01-05", "2024-02-30", "2024-1-5", "2024-03-01"]
    rows = [(d, a, b, f) for d in ("facility", "us", "plants", "x") for a in values for b in values for f in (None, "", "7")]
    df = spark.createDataFrame(rows, "dataset string, a string, b string, f string")
    for r in df.withColumn("fault", SV.argument_fault("dataset", "a", "b", "f")).collect():
        try:
            SV.check_args(r["dataset"], r["a"], r["b"], r["f"])
            assert r["fault"] is None, r
        except ValidationError as exc:
            assert r["fault"] is not None, r
            assert {"dataset": "Invalid dataset", "date_from": "date_from format", "date_to": "date_to format", "range": "before it starts", "facility_id": "only allowed"}[r["fault"]] in str(exc)


def _stored(spark, scratch, rows):
    from reactorlake.sources.tables import Warehouse

    wh = Warehouse(spark, f"{scratch}/wh")
    fac = spark.createDataFrame(rows, "date date, facility_id string, capacity double, outage double, percent_outage double")
    wh.save_snapshot("facility", fac)
    return wh, fac


def test_stored_pages_and_counts_come_from_the_manifest(spark, scratch):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 70), f"F{i // 70}", 1.0, float(i), 1.0) for i in range(280)]
    wh, fac = _stored(spark, scratch, rows)
    full = [(r["date"].isoformat(), r["facility_id"]) for r in fac.orderBy(fac.date.desc(), "facility_id").collect()]
    days = wh.rows_per_date("facility")
    assert sum(days.values()) == wh.row_count("facility") == 280
    for offset, limit in ((0, 5), (100, 30), (3, 1), (273, 7), (279, 1), (280, 5), (1000, 5)):
        assert R.locate_in(days, offset, limit) == R.locate(fac, offset, limit)
        res = get_dataset(wh, "facility", offset=offset, limit=limit)
        assert [(r["date"], r["facility_id"]) for r in res.data.collect()] == full[offset : offset + limit]
        meta = res.meta.first()
        assert (meta["total_count"], meta["returned"]) == (280, len(full[offset : offset + limit]))
        assert "parquet" not in res.meta._jdf.queryExecution().executedPlan().toString().lower()
    assert R.locate_in(days, 9, None) == R.locate(fac, 9, None)
    part = get_dataset(wh, "facility", "2024-02-01", "2024-02-10", limit=7)
    assert part.meta.first()["total_count"] == 40 and part.data.count() == 7


def test_pinned_reads_outlive_later_versions(spark, scratch):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "F", 1.0, float(i), 1.0) for i in range(5)]
    wh, fac = _stored(spark, scratch, rows)
    token, short = wh.pin(), wh.pin(dt.timedelta(seconds=-1))
    frame = wh.at(token).load("facility")
    for i in range(4):
        wh.save_snapshot("facility", fac.withColumn("outage", fac.outage + i + 1))
        wh.drop_unused()
    assert sorted(r["outage"] for r in wh.at(token).load("facility").collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert frame.count() == 5 and wh.load("facility").agg({"outage": "min"}).first()[0] == 4.0
    with pytest.raises(DataNotFoundError):
        wh.at(short)
    wh.release(token)
    wh.drop_unused()
    with pytest.raises(DataNotFoundError):
        wh.at(token)


def test_name_filter_pushes_few_ids_and_joins_many(spark, facility_df, plants_df, monkeypatch):
    from pyspark.sql import functions as F

    facts, named = facility_df.drop("facility_name"), F.col("facility_name").isin("Plant A", "Plant C")
    want = sorted((r["date"], r["facility_id"]) for r in facts.collect() if r["facility_id"] in ("F001", "F003"))
    assert sorted((r["date"], r["facility_id"]) for r in R.filter_by_name(facts, plants_df, named).collect()) == want
    monkeypatch.setattr(R, "PUSHED_IDS", 1)
    assert sorted((r["date"], r["facility_id"]) for r in R.filter_by_name(facts, plants_df, named).collect()) == want
    assert R.filter_by_name(facts, plants_df, F.lit(False)).count() == 0
