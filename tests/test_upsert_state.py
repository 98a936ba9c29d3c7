"""Upsert algebra and watermarks."""

from __future__ import annotations

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reactorlake.operators.upsert import last_wins, upsert
from reactorlake.sources import state as S
from reactorlake.sources.tables import Warehouse

KEYS = ["date", "facility_id"]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_updates_all_columns_and_inserts(spark, facility_df):
    base = facility_df.drop("facility_name")
    batch = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "F001", 1.0, 2.0, 3.0), (dt.date(2024, 1, 9), "F009", 4.0, 5.0, 6.0)], base.schema
    )
    out = {(r["date"], r["facility_id"]): r for r in upsert(base, batch, KEYS).collect()}
    assert len(out) == 6
    assert out[(dt.date(2024, 1, 1), "F001")]["outage"] == 2.0
    assert out[(dt.date(2024, 1, 9), "F009")]["capacity"] == 4.0
    assert out[(dt.date(2024, 1, 2), "F001")]["outage"] == 150.0


def test_upsert_is_idempotent(spark, facility_df):
    base = facility_df.drop("facility_name")
    batch = base.where(F.col("facility_id") == "F002").withColumn("outage", F.col("outage") + 1)
    once = upsert(base, batch, KEYS)
    assert _rows(upsert(once, batch, KEYS)) == _rows(once)


def test_last_wins_by_seq(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "F1", 1.0, 1), (dt.date(2024, 1, 1), "F1", 2.0, 3), (dt.date(2024, 1, 1), "F1", 9.0, 2)],
        "date date, facility_id string, outage double, seq int",
    )
    out = last_wins(df, KEYS).collect()
    assert len(out) == 1 and out[0]["outage"] == 2.0 and "seq" not in out[0].asDict()


keys_st = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3), st.integers(0, 100)), max_size=25)


@settings(max_examples=8, deadline=None)
@given(a=keys_st, b=keys_st)
def test_disjoint_batches_commute(spark, a, b):
    """Upserts of batches with disjoint keys commute; each batch is deduped first."""
    schema = "date date, facility_id string, outage double"

    def frame(rows, shift):
        return spark.createDataFrame(
            [(dt.date(2024, 1, 1) + dt.timedelta(days=d), f"F{f + shift}", float(v)) for d, f, v in rows], schema
        )

    base = spark.createDataFrame([], schema)
    ba = last_wins(frame(a, 0), KEYS)
    bb = last_wins(frame(b, 10), KEYS)  # disjoint facility ids
    ab = upsert(upsert(base, ba, KEYS), bb, KEYS)
    ba_ = upsert(upsert(base, bb, KEYS), ba, KEYS)
    assert _rows(ab) == _rows(ba_)


def test_state_absent_then_saved(spark, scratch):
    wh = Warehouse(spark, f"{scratch}/wh")
    assert S.load_state(wh) == {"facility_outages": None, "us_outages": None, "plants": None}
    d = dt.date(2024, 1, 1)
    S.save_state(wh, {"facility_outages": d, "us_outages": d, "plants": d})
    assert S.load_state(wh) == {"facility_outages": d, "us_outages": d, "plants": d}
    S.save_state(wh, {"us_outages": dt.date(2024, 2, 1)})
    got = S.load_state(wh)
    assert got["us_outages"] == dt.date(2024, 2, 1) and got["facility_outages"] == d
    assert S.load_state_frame(wh).where(F.col("updated_at").isNull()).count() == 0


def test_unknown_state_rows_are_ignored(spark, scratch):
    wh = Warehouse(spark, f"{scratch}/wh")
    target = f"{wh.state_dir()}/version-000001"
    spark.createDataFrame(
        [("mystery", dt.date(2020, 1, 1), dt.datetime(2020, 1, 1))], S.STATE_SCHEMA
    ).write.parquet(target)
    assert S.load_state(wh) == {"facility_outages": None, "us_outages": None, "plants": None}


def test_watermark_and_advance(spark, facility_df):
    assert S.watermark(facility_df).first()[0] == dt.date(2024, 1, 5)
    assert S.watermark(facility_df.where(F.lit(False))).first()[0] is None
    df = spark.createDataFrame([(dt.date(2024, 1, 5), None), (dt.date(2024, 1, 5), dt.date(2024, 1, 3))], "o date, n date")
    vals = [r[0] for r in df.select(S.advance(F.col("o"), F.col("n"))).collect()]
    assert vals == [dt.date(2024, 1, 5), dt.date(2024, 1, 5)]  # never backwards, empty batch keeps it


def test_change_kinds_compare_null_safely_and_in_order(spark):
    from reactorlake.operators.upsert import change_kinds, merge_latest

    schema = "k string, v double, seq struct<run:string,pos:int>"
    old = spark.createDataFrame([("a", 1.0, ("r2", 0)), ("b", None, ("r2", 0)), ("c", 3.0, ("r2", 0)), ("d", 4.0, ("r2", 0)), ("e", 5.0, None)], schema)
    new = spark.createDataFrame([("a", 1.0, ("r3", 0)), ("b", None, ("r2", 0)), ("c", 9.0, ("r1", 9)), ("d", None, ("r2", 1)), ("e", 6.0, ("r1", 0)), ("f", 1.0, ("r1", 0))], schema)
    kinds = {r["k"]: r["kind"] for r in change_kinds(old, new, ["k"]).collect()}
    assert kinds == {"a": "renewed", "b": "same", "c": "older", "d": "changed", "e": "changed", "f": "inserted"}
    merged = {r["k"]: (r["v"], r["seq"] and r["seq"]["run"]) for r in merge_latest(old, new, ["k"]).collect()}
    assert merged == {"a": (1.0, "r3"), "b": (None, "r2"), "c": (3.0, "r2"), "d": (None, "r2"), "e": (6.0, "r1"), "f": (1.0, "r1")}
    plain = {r["k"]: r["kind"] for r in change_kinds(old.drop("seq"), new.drop("seq"), ["k"]).collect()}
    assert plain == {"a": "same", "b": "same", "c": "changed", "d": "changed", "e": "changed", "f": "inserted"}


def test_a_replayed_batch_rewrites_no_month(spark, scratch):
    from reactorlake.plans import refresh as RF
    from reactorlake.sources.tables import Warehouse

    wh = Warehouse(spark, f"{scratch}/wh")
    schema = "date date, facility_id string, facility_name string, capacity double, outage double, percent_outage double, seq struct<run:string,at:bigint,offset:bigint,file:string,pos:int>"
    day = lambda m, v, run: (dt.date(2024, m, 1), "F", "N", 1.0, v, 1.0, (run, 0, 0, "f", 0))
    RF.apply_facility_batch(spark, wh, spark.createDataFrame([day(1, 1.0, "r2"), day(2, 2.0, "r2")], schema))
    before = wh.base_parts("facility_outages")
    RF.apply_facility_batch(spark, wh, spark.createDataFrame([day(1, 1.0, "r2"), day(2, 9.0, "r1")], schema))
    assert wh.base_parts("facility_outages") == before
    RF.apply_facility_batch(spark, wh, spark.createDataFrame([day(1, 1.0, "r2"), day(2, 9.0, "r3")], schema))
    after = wh.base_parts("facility_outages")
    assert after["2024-01"] == before["2024-01"] and after["2024-02"] != before["2024-02"]
    assert {r["outage"] for r in wh.load_snapshot("facility").collect()} == {1.0, 9.0}
