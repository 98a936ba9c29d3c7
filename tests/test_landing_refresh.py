"""Landed pages, refreshes, recovery and publish."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from reactorlake.plans import refresh as RF
from reactorlake.sources import landing as L
from reactorlake.sources import state as S
from reactorlake.sources.tables import Warehouse
from tests.conftest import raw_record, write_page


def _local(path: str) -> str:
    return path[len("file:") :] if path.startswith("file:") else path


def _fac(day, fid, name, outage="100"):
    return raw_record(f"2024-01-{day:02d}", fid, name, "1000", outage, "10")


def _us(day, outage="5000"):
    return raw_record(f"2024-01-{day:02d}", None, None, "100000", outage, "5")


def test_page_stop_rules(spark, scratch):
    root = _local(scratch)
    # batch 1 (page size 2): pages at offsets 0, 4, 6 (offset 2 missing) -> only page 0 is read
    write_page(f"{root}/fac/b1/p0.json", 0, [_fac(1, "F1", "A")], 7)
    write_page(f"{root}/fac/b1/p2.json", 4, [_fac(3, "F1", "A")], 7)
    write_page(f"{root}/fac/b1/p3.json", 6, [_fac(4, "F1", "A")], 7)
    # batch 2: page 0 and an empty page 1, then page 2 -> page 0 only
    write_page(f"{root}/fac/b2/p0.json", 0, [_fac(5, "F1", "A"), _fac(6, "F1", "A")], 6)
    write_page(f"{root}/fac/b2/p1.json", 2, [], 6)
    write_page(f"{root}/fac/b2/p2.json", 4, [_fac(7, "F1", "A")], 6)
    # batch 3: page past total is ignored
    write_page(f"{root}/fac/b3/p0.json", 0, [_fac(8, "F1", "A"), _fac(9, "F1", "A")], 2)
    write_page(f"{root}/fac/b3/p1.json", 2, [_fac(10, "F1", "A")], 2)
    recs = L.landed_records(spark, f"{scratch}/fac", page_size=2)
    days = sorted(r["period"][-2:] for r in recs.collect())
    assert days == ["01", "05", "06", "08", "09"]


def test_page_plan(spark):
    plans = [L.page_plan(spark, n, 5000).collect() for n in (12001, 0, 5000)]
    assert [len(p) for p in plans] == [3, 1, 1]
    assert sorted((r["offset"], r["length"]) for r in plans[0])[-1] == (10000, 2001)


def test_records_carry_text_totals_and_missing_lists(spark, scratch):
    root = _local(scratch)
    write_page(f"{root}/us/b1/p0.json", 0, [_us(1), _us(2)], None)  # total absent -> 0 -> first page only
    recs = L.landed_records(spark, f"{scratch}/us")
    assert recs.count() == 2


def test_full_then_incremental_refresh(spark, scratch):
    root = _local(scratch)
    write_page(f"{root}/land/fac/b1/p0.json", 0, [_fac(1, "F1", "A"), _fac(2, "F1", "A"), _fac(2, "F2", "B")], 3)
    write_page(f"{root}/land/us/b1/p0.json", 0, [_us(1), _us(2)], 2)
    landing = RF.Landing(f"{scratch}/land/fac", f"{scratch}/land/us")
    wh = Warehouse(spark, f"{scratch}/wh")
    assert RF.choose_mode(wh) == RF.FULL
    summary = {r["dataset"]: (r["mode"], r["rows_processed"]) for r in RF.refresh(spark, landing, wh).collect()}
    assert summary["facility_outages"] == ("FULL (first run)", 3)
    msgs = {r["dataset"]: r["message"] for r in RF.summary(spark, RF.FULL, {"facility_outages": 5}).collect()}
    assert msgs == {"facility_outages": "5 rows processed", "us_outages": "0 rows processed", "plants": "0 rows processed"}
    assert summary["plants"][1] == 2 and summary["us_outages"][1] == 2
    assert S.load_state(wh)["facility_outages"] == dt.date(2024, 1, 2)
    assert RF.choose_mode(wh) == RF.INCREMENTAL

    # new landing batch: a correction for day 2 and a new day 3; day 1 is older than the watermark
    write_page(
        f"{root}/land/fac/b2/p0.json", 0, [_fac(1, "F1", "A", "999"), _fac(2, "F1", "A2", "300"), _fac(3, "F3", "C")], 3
    )
    summary = {r["dataset"]: (r["mode"], r["rows_processed"]) for r in RF.refresh(spark, landing, wh).collect()}
    assert summary["facility_outages"][0] == "INCREMENTAL"
    facts = {(r["date"].day, r["facility_id"]): r["outage"] for r in wh.load_snapshot("facility").collect()}
    assert facts == {(1, "F1"): 100.0, (2, "F1"): 300.0, (2, "F2"): 100.0, (3, "F3"): 100.0}
    names = {r["facility_id"]: r["facility_name"] for r in wh.load_snapshot("plants").collect()}
    assert names == {"F1": "A2", "F2": "B", "F3": "C"}
    st = S.load_state(wh)
    assert st["facility_outages"] == dt.date(2024, 1, 3) and st["us_outages"] == dt.date(2024, 1, 2)

    # running again changes nothing (idempotent replay)
    before = sorted(tuple(r) for r in wh.load_snapshot("facility").collect())
    RF.refresh(spark, landing, wh)
    assert sorted(tuple(r) for r in wh.load_snapshot("facility").collect()) == before


def test_incremental_without_new_rows_is_a_noop(spark, scratch):
    root = _local(scratch)
    write_page(f"{root}/land/fac/b1/p0.json", 0, [_fac(5, "F1", "A")], 1)
    write_page(f"{root}/land/us/b1/p0.json", 0, [_us(5)], 1)
    landing = RF.Landing(f"{scratch}/land/fac", f"{scratch}/land/us")
    wh = Warehouse(spark, f"{scratch}/wh")
    RF.refresh(spark, landing, wh)
    wh2_state = S.load_state(wh)
    empty_landing = RF.Landing(f"{scratch}/none/fac", f"{scratch}/none/us")
    summary = RF.refresh(spark, empty_landing, wh).collect()
    assert {r["rows_processed"] for r in summary} == {0}
    assert S.load_state(wh) == wh2_state


def test_untouched_months_survive_a_partition_upsert(spark, scratch):
    root = _local(scratch)
    feb = raw_record("2024-02-10", "F1", "A", "1000", "1", "0.1")
    write_page(f"{root}/land/fac/b1/p0.json", 0, [_fac(1, "F1", "A"), feb], 2)
    landing = RF.Landing(f"{scratch}/land/fac", f"{scratch}/land/us")
    wh = Warehouse(spark, f"{scratch}/wh")
    RF.refresh(spark, landing, wh)
    write_page(f"{root}/land/fac/b2/p0.json", 0, [raw_record("2024-02-10", "F1", "A", "1000", "7", "0.7")], 1)
    RF.refresh(spark, landing, wh)
    facts = {r["date"]: r["outage"] for r in wh.load_base("facility").collect()}
    assert facts == {dt.date(2024, 1, 1): 100.0, dt.date(2024, 2, 10): 7.0}
    published = {r["date"]: r["outage"] for r in wh.load_snapshot("facility").collect()}
    assert published == facts  # only February was republished; January stayed
    # old manifests and the writes that none of the newest two uses are removed
    from reactorlake.sources.tables import _numbers

    for i in range(3):
        write_page(f"{root}/land/fac/b{i + 3}/p0.json", 0, [raw_record("2024-02-10", "F1", "A", "1000", str(i), "0.7")], 1)
        RF.refresh(spark, landing, wh)
    assert len(_numbers(spark, wh.base_dir("facility_outages"))) <= 2
    assert len(os.listdir(_local(f"{scratch}/wh/data/facility_outages"))) <= 4


def test_publish_skips_empty_tables(spark, scratch, us_df):
    wh = Warehouse(spark, f"{scratch}/wh")
    wh.overwrite_base("us", us_df)
    assert wh.publish("us") is True
    wh.overwrite_base("us", us_df.where(F.lit(False)))
    assert wh.publish("us") is False
    assert wh.load_snapshot("us").count() == 5  # the older snapshot stays


def test_recovery_rebuilds_base_tables(spark, scratch):
    root = _local(scratch)
    write_page(f"{root}/land/fac/b1/p0.json", 0, [_fac(1, "F1", "A"), _fac(2, "F2", "B")], 2)
    write_page(f"{root}/land/us/b1/p0.json", 0, [_us(1)], 1)
    landing = RF.Landing(f"{scratch}/land/fac", f"{scratch}/land/us")
    wh = Warehouse(spark, f"{scratch}/wh")
    RF.refresh(spark, landing, wh)
    wh.drop_base_tables()
    assert RF.choose_mode(wh) == RF.RECOVERY
    summary = {r["dataset"]: (r["mode"], r["rows_processed"]) for r in RF.refresh(spark, landing, wh).collect()}
    assert summary["facility_outages"] == ("INCREMENTAL", 2)  # the summary has two labels
    assert wh.base_tables_exist()
    assert RF.choose_mode(wh) == RF.INCREMENTAL


def test_full_refresh_when_state_is_missing(spark, scratch, facility_df, us_df, plants_df):
    wh = Warehouse(spark, f"{scratch}/wh")
    wh.overwrite_base("facility", facility_df.drop("facility_name"))
    wh.overwrite_base("us", us_df)
    wh.overwrite_base("plants", plants_df)
    assert RF.choose_mode(wh) == RF.FULL


def test_stream_refresh_is_replay_safe(spark, scratch):
    from reactorlake.streaming.refresh_stream import run_available

    root = _local(scratch)
    write_page(f"{root}/land/fac/b1/p0.json", 0, [_fac(1, "F1", "A"), _fac(2, "F1", "A")], 2)
    wh = Warehouse(spark, f"{scratch}/wh")
    run_available(spark, f"{scratch}/land/fac", "facility", wh)
    assert wh.load_snapshot("facility").count() == 2
    write_page(f"{root}/land/fac/b2/p0.json", 0, [_fac(2, "F1", "A", "5"), _fac(3, "F2", "B")], 2)
    run_available(spark, f"{scratch}/land/fac", "facility", wh)
    facts = {(r["date"].day, r["facility_id"]): r["outage"] for r in wh.load_snapshot("facility").collect()}
    assert facts == {(1, "F1"): 100.0, (2, "F1"): 5.0, (3, "F2"): 100.0}
    # a fresh checkpoint replays every file: the upsert leaves the table unchanged
    run_available(spark, f"{scratch}/land/fac", "facility", wh, checkpoint_location=f"{scratch}/ck2")
    again = {(r["date"].day, r["facility_id"]): r["outage"] for r in wh.load_snapshot("facility").collect()}
    assert again == facts
    assert S.load_state(wh)["facility_outages"] == dt.date(2024, 1, 3)


def test_incremental_over_split_batches_equals_full_over_union(spark, scratch):
    """Landing a history in two runs (full, then incremental with a look-back that
    covers the overlap) gives the same tables as one full load of the union."""
    root = _local(scratch)
    first = [_fac(d, f"F{d % 3}", f"N{d % 3}", str(d)) for d in range(1, 15)]
    second = [_fac(d, f"F{d % 3}", f"N{d % 3}", str(100 + d)) for d in range(10, 25)]
    write_page(f"{root}/split/fac/b1/p0.json", 0, first, len(first))
    write_page(f"{root}/split/fac/b2/p0.json", 0, second, len(second))
    write_page(f"{root}/union/fac/b1/p0.json", 0, first, len(first))
    write_page(f"{root}/union/fac/b2/p0.json", 0, second, len(second))

    # split: the first run sees only batch 1 (batch 2 lands afterwards)
    wh_split = Warehouse(spark, f"{scratch}/wh_split")
    only_first = RF.Landing(f"{scratch}/split/fac/b1", f"{scratch}/none/us")
    RF.refresh(spark, only_first, wh_split)
    both = RF.Landing(f"{scratch}/split/fac", f"{scratch}/none/us")
    RF.refresh(spark, both, wh_split, lookback_days=30)

    wh_union = Warehouse(spark, f"{scratch}/wh_union")
    RF.refresh(spark, RF.Landing(f"{scratch}/union/fac", f"{scratch}/none/us"), wh_union)

    for name in ("facility", "plants"):
        a = sorted(tuple(r) for r in wh_split.load_snapshot(name).collect())
        b = sorted(tuple(r) for r in wh_union.load_snapshot(name).collect())
        assert a == b
    assert S.load_state(wh_split)["facility_outages"] == S.load_state(wh_union)["facility_outages"]


def test_incremental_parses_only_new_fetch_runs(spark, scratch):
    """Records of an already applied fetch run are not parsed again, even when
    they are newer than the watermark; only runs that landed since are read."""
    root = _local(scratch)
    write_page(f"{root}/land/fac/b1/p0.json", 0, [_fac(1, "F1", "A"), _fac(2, "F1", "A")], 2)
    landing = RF.Landing(f"{scratch}/land/fac", f"{scratch}/land/us")
    wh = Warehouse(spark, f"{scratch}/wh")
    RF.refresh(spark, landing, wh)
    assert [(r["run"], r["applied"]) for r in S.load_progress(wh, "facility_outages").collect()] == [("b1", True)]
    again = {r["dataset"]: r["rows_processed"] for r in RF.refresh(spark, landing, wh).collect()}
    assert again["facility_outages"] == 0  # day 2 is >= the watermark but was applied already
    write_page(f"{root}/land/fac/b2/p0.json", 0, [_fac(2, "F1", "A", "7"), _fac(3, "F1", "A")], 2)
    later = {r["dataset"]: r["rows_processed"] for r in RF.refresh(spark, landing, wh).collect()}
    assert later["facility_outages"] == 2
    facts = {r["date"].day: r["outage"] for r in wh.load_snapshot("facility").collect()}
    assert facts == {1: 100.0, 2: 7.0, 3: 100.0}


def test_stream_refresh_of_the_national_series(spark, scratch):
    from reactorlake.streaming.refresh_stream import run_available

    root = _local(scratch)
    write_page(f"{root}/land/us/b1/p0.json", 0, [_us(1), _us(2, ""), _us(3)], 3)  # day 2 lacks outage
    wh = Warehouse(spark, f"{scratch}/wh")
    run_available(spark, f"{scratch}/land/us", "us", wh)
    rows = {r["date"].day: r["outage"] for r in wh.load_snapshot("us").collect()}
    assert rows == {1: 5000.0, 3: 5000.0}
    assert S.load_state(wh)["us_outages"] == dt.date(2024, 1, 3)


def _days(wh):
    return sorted(r["date"].day for r in wh.load_snapshot("facility").collect())


def test_nothing_landed_is_lost(spark, scratch):
    """Flat files, runs that sort before applied ones, late pages of an applied run, nested folders."""
    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/land/fac", f"{scratch}/none", page_size=1)
    wh = Warehouse(spark, f"{scratch}/wh")
    write_page(f"{root}/land/fac/flat-1.json", 0, [_fac(1, "F1", "A")], 2)
    write_page(f"{root}/land/fac/run-9/deep/er/p0.json", 0, [_fac(2, "F1", "A")], 2)
    RF.refresh(spark, landing, wh)
    assert _days(wh) == [1, 2]
    write_page(f"{root}/land/fac/flat-2.json", 1, [_fac(3, "F1", "A")], 2)
    write_page(f"{root}/land/fac/run-9/other/p1.json", 1, [_fac(4, "F1", "A")], 2)
    write_page(f"{root}/land/fac/run-10/p0.json", 0, [_fac(5, "F1", "A")], 1)
    write_page(f"{root}/land/fac/a-run/p0.json", 0, [_fac(6, "F1", "A")], 1)
    RF.refresh(spark, landing, wh)
    assert _days(wh) == [1, 2, 3, 4, 5, 6]
    assert {r["rows_processed"] for r in RF.refresh(spark, landing, wh).collect()} == {0}


def test_pages_behind_a_gap_are_held_and_applied_later(spark, scratch):
    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/land/fac", f"{scratch}/none", page_size=1)
    wh = Warehouse(spark, f"{scratch}/wh")
    # newest first, as the source serves them: the held days are older than the watermark
    write_page(f"{root}/land/fac/r1/p0.json", 0, [_fac(9, "F1", "A")], 3)
    write_page(f"{root}/land/fac/r1/p2.json", 2, [_fac(7, "F1", "A")], 3)
    RF.refresh(spark, landing, wh)
    assert _days(wh) == [9]
    assert [r["file"].rsplit("/", 1)[1] for r in S.held_files(wh, "facility_outages").collect()] == ["p2.json"]
    write_page(f"{root}/land/fac/r1/p1.json", 1, [_fac(8, "F1", "A")], 3)
    RF.refresh(spark, landing, wh)
    assert _days(wh) == [7, 8, 9] and S.held_files(wh, "facility_outages").isEmpty()


def test_page_offset_decides_before_the_file_name(spark, scratch):
    root = _local(scratch)
    write_page(f"{root}/fac/r/p-1.json", 0, [_fac(1, "F1", "A", "1")], 2)
    write_page(f"{root}/fac/r/p-0.json", 1, [_fac(1, "F1", "A", "2")], 2)
    wh = Warehouse(spark, f"{scratch}/wh")
    RF.refresh(spark, RF.Landing(f"{scratch}/fac", f"{scratch}/none", page_size=1), wh)
    assert [r["outage"] for r in wh.load_snapshot("facility").collect()] == [2.0]


def test_a_full_run_without_landing_keeps_the_tables(spark, scratch):
    root = _local(scratch)
    write_page(f"{root}/fac/r/p0.json", 0, [_fac(1, "F1", "A")], 1)
    wh = Warehouse(spark, f"{scratch}/wh")
    RF.refresh(spark, RF.Landing(f"{scratch}/fac", f"{scratch}/none"), wh)
    RF.refresh(spark, RF.Landing(f"{scratch}/gone", f"{scratch}/none"), wh, mode="full")
    assert wh.load_base("facility").count() == 1 and wh.load_base("plants").count() == 1
    assert S.load_state(wh)["facility_outages"] == dt.date(2024, 1, 1)


def test_a_crash_before_the_switch_leaves_the_old_table(spark, scratch, monkeypatch):
    from reactorlake.sources import tables

    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/fac", f"{scratch}/none")
    wh = Warehouse(spark, f"{scratch}/wh")
    write_page(f"{root}/fac/r1/p0.json", 0, [_fac(1, "F1", "A")], 1)
    RF.refresh(spark, landing, wh)
    write_page(f"{root}/fac/r2/p0.json", 0, [_fac(1, "F1", "A", "7"), _fac(2, "F1", "A")], 2)

    def crash(*_):
        raise RuntimeError("between write and switch")

    with monkeypatch.context() as m:
        m.setattr(tables, "switch_manifest", crash)
        try:
            RF.refresh(spark, landing, wh)
        except RuntimeError:
            pass
    assert [(r["date"].day, r["outage"]) for r in wh.load_base("facility").collect()] == [(1, 100.0)]
    RF.refresh(spark, landing, wh)
    assert sorted((r["date"].day, r["outage"]) for r in wh.load_snapshot("facility").collect()) == [(1, 7.0), (2, 100.0)]


def test_a_run_read_again_does_not_undo_newer_runs(spark, scratch):
    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/fac", f"{scratch}/us", page_size=2)
    wh = Warehouse(spark, f"{scratch}/wh")
    write_page(f"{root}/fac/run-1/p0.json", 0, [_fac(1, "F1", "Old"), _fac(2, "F1", "Old", "10")], 3)
    write_page(f"{root}/us/run-1/p0.json", 0, [_us(1), _us(2, "10")], 3)
    RF.refresh(spark, landing, wh)
    write_page(f"{root}/fac/run-2/p0.json", 0, [_fac(2, "F1", "New", "20")], 1)
    write_page(f"{root}/us/run-2/p0.json", 0, [_us(2, "20"), _us(3, "30")], 2)
    RF.refresh(spark, landing, wh)
    write_page(f"{root}/fac/run-1/p1.json", 2, [_fac(3, "F1", "Old", "11"), _fac(2, "F1", "Old", "12")], 4)
    write_page(f"{root}/us/run-1/p1.json", 2, [_us(3, "11"), _us(4, "11")], 4)
    RF.refresh(spark, landing, wh)
    assert {r["date"].day: r["outage"] for r in wh.load_snapshot("facility").collect()} == {1: 100.0, 2: 20.0, 3: 11.0}
    assert {r["date"].day: r["outage"] for r in wh.load_snapshot("us").collect()} == {1: 5000.0, 2: 20.0, 3: 30.0, 4: 11.0}
    assert [tuple(r) for r in wh.load_snapshot("plants").collect()] == [("F1", "New")]
    assert wh.load_snapshot("facility").columns == ["date", "facility_id", "capacity", "outage", "percent_outage"]
    # the same after recovery from the published files: the order is stored with them
    wh.drop_base_tables()
    RF.refresh(spark, landing, wh)
    write_page(f"{root}/fac/run-1/p2.json", 4, [_fac(2, "F1", "Old", "13")], 5)
    RF.refresh(spark, landing, wh)
    assert {r["date"].day: r["outage"] for r in wh.load_snapshot("facility").collect()}[2] == 20.0


def test_flat_files_are_ordered_by_the_time_they_land(spark, scratch):
    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/fac", f"{scratch}/none", page_size=1)
    wh = Warehouse(spark, f"{scratch}/wh")
    write_page(f"{root}/fac/z0.json", 0, [_fac(1, "F1", "A", "1")], 3)
    write_page(f"{root}/fac/a1.json", 1, [_fac(2, "F1", "A", "1")], 3)
    write_page(f"{root}/fac/a2.json", 2, [_fac(3, "F1", "A", "1")], 3)
    for i, name in enumerate(("z0", "a1", "a2")):
        os.utime(f"{root}/fac/{name}.json", (1_700_000_000 + i,) * 2)
    RF.refresh(spark, landing, wh)
    write_page(f"{root}/fac/b0.json", 0, [_fac(3, "F1", "A", "2")], 3)  # a lower offset, but later
    RF.refresh(spark, landing, wh)
    assert {r["date"].day: r["outage"] for r in wh.load_snapshot("facility").collect()} == {1: 1.0, 2: 1.0, 3: 2.0}


def test_applied_files_are_not_parsed_again(spark, scratch, monkeypatch):
    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/fac", f"{scratch}/none", page_size=1)
    wh = Warehouse(spark, f"{scratch}/wh")
    write_page(f"{root}/fac/p0.json", 0, [_fac(1, "F1", "A")], 4)
    write_page(f"{root}/fac/p2.json", 2, [_fac(3, "F1", "A")], 4)
    RF.refresh(spark, landing, wh)
    read = []

    def spy(session, path, files=None, multi_line=False, real=RF.read_pages):
        read.append(sorted(os.path.basename(f) for f in files or ["all"]))
        return real(session, path, files, multi_line)

    monkeypatch.setattr(RF, "read_pages", spy)
    write_page(f"{root}/fac/p1.json", 1, [_fac(2, "F1", "A")], 4)
    RF.refresh(spark, landing, wh)
    assert read == [["p1.json"], ["p2.json"]] and _days(wh) == [1, 2, 3]  # the new page, then the held one
    monkeypatch.setattr(RF, "LISTED_FILES", 0)  # more new files than names are given for: the landing is read and filtered
    write_page(f"{root}/fac/p3.json", 3, [_fac(4, "F1", "A")], 4)
    RF.refresh(spark, landing, wh)
    assert read[2:] == [["all"]] and _days(wh) == [1, 2, 3, 4]


def test_broken_pages_are_reported_and_tried_again(spark, scratch):
    import pytest

    from reactorlake.errors import ProcessingError

    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/fac", f"{scratch}/none", page_size=1)
    wh = Warehouse(spark, f"{scratch}/wh")
    for i in range(4):
        write_page(f"{root}/fac/r1/p{i}.json", i, [_fac(i + 1, "F1", "A")], 4)
    whole = open(f"{root}/fac/r1/p1.json").read()
    open(f"{root}/fac/r1/p1.json", "w").write(whole[: len(whole) // 2])
    open(f"{root}/fac/r1/empty.json", "w").write(" \n")  # Spark's listing shows no file of length 0
    os.makedirs(f"{root}/fac/r2")
    open(f"{root}/fac/r2/p0.json", "w").write('{"offset": 0, "error": "busy"}')
    with pytest.raises(ProcessingError):
        RF.refresh(spark, RF.Landing(landing.facility, landing.us, page_size=1, strict=True), wh)
    assert not wh.base_exists("facility_outages")
    RF.refresh(spark, landing, wh)
    assert _days(wh) == [1]
    why = {r["file"].rsplit("/", 2)[1] + "/" + r["file"].rsplit("/", 1)[1]: r["broken"] for r in S.broken_files(wh, "facility_outages").collect()}
    assert set(why) == {"r1/p1.json", "r1/empty.json", "r2/p0.json"} and why["r1/p1.json"].startswith("not a page") and why["r2/p0.json"] == "no response"
    assert sorted(r["file"].rsplit("/", 1)[1] for r in S.held_files(wh, "facility_outages").collect()) == ["p2.json", "p3.json"]
    RF.refresh(spark, landing, wh)  # nothing has changed
    assert _days(wh) == [1] and S.broken_files(wh, "facility_outages").count() == 3
    open(f"{root}/fac/r1/p1.json", "w").write(whole)
    write_page(f"{root}/fac/r2/p0.json", 0, [_fac(9, "F1", "A")], 1)
    RF.refresh(spark, landing, wh)
    assert _days(wh) == [1, 2, 3, 4, 9]
    assert [r["file"].rsplit("/", 1)[1] for r in S.broken_files(wh, "facility_outages").collect()] == ["empty.json"] and S.held_files(wh, "facility_outages").isEmpty()


def test_the_stream_keeps_the_stop_rules_and_shares_its_states(spark, scratch):
    from reactorlake.streaming.refresh_stream import run_available

    root = _local(scratch)
    wh = Warehouse(spark, f"{scratch}/wh")
    write_page(f"{root}/fac/r1/p0.json", 0, [_fac(1, "F1", "A")], 3)
    write_page(f"{root}/fac/r1/p2.json", 2, [_fac(3, "F1", "A", "7")], 3)
    open(f"{root}/fac/r1/x.json", "w").write('{"offset": 1, "resp')
    run_available(spark, f"{scratch}/fac", "facility", wh, page_size=1)
    assert _days(wh) == [1] and S.broken_files(wh, "facility_outages").count() == 1
    write_page(f"{root}/fac/r1/p1.json", 1, [_fac(2, "F1", "A")], 3)
    run_available(spark, f"{scratch}/fac", "facility", wh, page_size=1)
    assert _days(wh) == [1, 2, 3] and S.held_files(wh, "facility_outages").isEmpty()
    # a batch refresh afterwards finds nothing new but the broken file
    wh.overwrite_base("us", RF._empty(spark, "us"))
    landing = RF.Landing(f"{scratch}/fac", f"{scratch}/none", page_size=1)
    assert {r["rows_processed"] for r in RF.refresh(spark, landing, wh).collect()} == {0}


def test_rejected_records_and_failed_numbers_are_stored_once(spark, scratch):
    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/fac", f"{scratch}/none")
    wh = Warehouse(spark, f"{scratch}/wh")
    bad = raw_record("2024-01-03", "F1", "A", "n/a", "12d", "10")
    write_page(f"{root}/fac/r1/p0.json", 0, [_fac(5, "F1", "A"), _fac(2, "", "A"), bad, raw_record("2024-01", "F1", "A", "1", "1", "1")], 4)
    RF.refresh(spark, landing, wh)
    RF.refresh(spark, landing, wh, mode="full")
    write_page(f"{root}/fac/r2/p0.json", 0, [_fac(1, "F1", "A"), _fac(6, "F1", "A")], 2)
    RF.refresh(spark, landing, wh)
    got = sorted((r["kind"], r["reason"], r["period"], r["value"]) for r in S.load_rejected(wh, "facility_outages").collect())
    assert got == [
        ("late", "before 2024-01-05", "2024-01-01", None),
        ("missing", "facility", "2024-01-02", None),
        ("missing", "period (not a date)", "2024-01", None),
        ("number", "capacity", "2024-01-03", "n/a"),
        ("number", "outage", "2024-01-03", "12d"),
    ]
    assert _days(wh) == [3, 5, 6]


def test_many_refreshes_leave_few_files(spark, scratch):
    root = _local(scratch)
    wh = Warehouse(spark, f"{scratch}/wh")
    pages = spark.createDataFrame([("r", f"f{i}", i, 100, 1, None, "kept", None) for i in range(30)], "run string, file string, offset long, total long, n int, broken string, state string, start date")
    for i in range(30):
        S.save_progress(wh, "facility_outages", pages.where(F.col("offset") == i))
        S.save_state(wh, {"facility_outages": dt.date(2024, 1, 1) + dt.timedelta(days=i)})
    wh.drop_unused()
    count = sum(len([f for f in files if not f.startswith((".", "_"))]) for _, _, files in os.walk(f"{root}/wh"))
    assert count < 40 and len(wh.log_parts("progress/facility_outages")) < 8
    assert S.load_progress(wh, "facility_outages").count() == 30 and S.load_state(wh)["facility_outages"] == dt.date(2024, 1, 30)


def test_a_range_opens_only_files_that_reach_into_it(spark, scratch, monkeypatch):
    root = _local(scratch)
    landing = RF.Landing(f"{scratch}/fac", f"{scratch}/none", page_size=2)
    wh = Warehouse(spark, f"{scratch}/wh")
    for i in range(4):
        write_page(f"{root}/fac/r1/p{i}.json", 2 * i, [_fac(2 * i + 1, "F1", "A"), _fac(2 * i + 2, "F1", "A")], 8)
    write_page(f"{root}/fac/r1/p5.json", 10, [_fac(4, "F1", "past the total")], 8)
    RF.refresh(spark, landing, wh)
    read = []

    def spy(session, path, files=None, multi_line=False, real=RF.read_pages):
        read.append(sorted(os.path.basename(f) for f in files or ["all"]))
        return real(session, path, files, multi_line)

    monkeypatch.setattr(RF, "read_pages", spy)
    day = lambda n: dt.date(2024, 1, n)
    between = lambda a, b: sorted(int(r["period"][-2:]) for r in RF.landed_between(spark, landing, "facility", wh, a, b).collect())
    assert between(day(4), day(5)) == [4, 5] and read == [["p1.json", "p2.json"]]
    assert between(day(8), None) == [8] and between(None, day(1)) == [1] and read[1:] == [["p3.json"], ["p0.json"]]
    assert between(day(20), None) == [] and len(read) == 3
