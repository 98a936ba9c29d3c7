"""L6 numbering, W1/J3/A9/J6 series, F4-F11 and L9 functions, entry contract."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from reactorlake.functions import dates as D
from reactorlake.functions.labels import mw_label, percent_label
from reactorlake.operators import series as SR
from reactorlake.operators.numbering import number_pages, number_rows
from reactorlake.plans.compare import compare_series, latest_series
from reactorlake.plans.service import FrameCatalog


def test_numbering_equals_a_global_row_number(spark):
    df = spark.range(0, 3000).select(
        (F.col("id") % 37).alias("d"), F.concat(F.lit("k"), (F.col("id") * 7919 % 3001).cast("string")).alias("k")
    )
    order = [F.col("d").desc(), F.col("k").asc()]
    ours = {(r["d"], r["k"]): r["row_idx"] for r in number_rows(df, order).collect()}
    ref = df.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1)
    assert ours == {(r["d"], r["k"]): r["i"] for r in ref.collect()}
    pages = number_pages(df, order, 100).where(F.col("row_idx") == 250).first()
    assert (pages["page_no"], pages["page_pos"]) == (2, 50)


def test_numbering_splits_a_hot_leading_key(spark):
    # one key holds most rows: the range partitioning still spreads it (keys are unique)
    df = spark.range(0, 4000).select(
        F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.col("id") % 5).alias("d"), F.col("id").alias("k")
    )
    out = number_rows(df, [F.col("d").asc(), F.col("k").asc()], partitions=8)
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3000
    assert sorted(r["row_idx"] for r in out.collect()) == list(range(4000))


def _cat(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    fac = spark.createDataFrame(
        [(d, fid, 1.0, float(i + (100 if fid == "F2" else 0)), 1.0) for i, d in enumerate(days) for fid in ("F1", "F2") if not (fid == "F2" and i % 2)],
        "date date, facility_id string, capacity double, outage double, percent_outage double",
    )
    us = spark.createDataFrame([(d, 9.0, float(1000 + i), 1.0) for i, d in enumerate(days[:8])], "date date, capacity double, outage double, percent_outage double")
    plants = spark.createDataFrame([("F1", "One"), ("F2", "Two"), ("F3", "Three")], "facility_id string, facility_name string")
    return FrameCatalog({"facility_outages": fac, "us_outages": us, "plants": plants})


def test_compare_series_aligns_and_fills(spark):
    out = compare_series(_cat(spark), ["F2", "F1", "F9"], "2024-01-01", "2024-01-10")
    assert out.columns == ["date", "us", "F1", "F2", "date_rank"]
    labelled = compare_series(_cat(spark), ["F2", "F1"], labelled=True)
    assert labelled.columns == ["date", "us", "One", "Two", "date_rank"]
    rows = out.collect()
    assert [r["date"] for r in rows] == sorted(r["date"] for r in rows) and len(rows) == 10
    by = {r["date"]: r for r in rows}
    assert by["2024-01-02"]["F2"] is None and by["2024-01-03"]["F2"] == 102.0
    assert by["2024-01-10"]["us"] is None and by["2024-01-10"]["F1"] == 9.0
    no_us = compare_series(_cat(spark), ["F1"], "2024-01-01", "2024-01-10", include_us=False)
    assert no_us.columns == ["date", "F1", "date_rank"]


def test_latest_series_limits_each_series(spark):
    out = latest_series(_cat(spark), ["F1", "F2"], "2024-01-05", "2024-01-07")  # 3 days -> N = 3
    got = {(r["facility_id"], r["date"]) for r in out.collect()}
    assert got == {("F1", "2024-01-05"), ("F1", "2024-01-06"), ("F1", "2024-01-07"), ("F2", "2024-01-05"), ("F2", "2024-01-07")}
    assert {r["facility_name"] for r in out.collect()} == {"One", "Two"}
    ranked = SR.newest_per_series(_cat(spark).load("facility"), 2).collect()
    assert len(ranked) == 4 and max(r["series_rank"] for r in ranked) == 2


def test_pick_ids():
    assert SR.pick_ids(["a", "b", "a", "c", "d", "e", "f"]) == ["a", "b", "c", "d", "e", "f"]
    assert SR.pick_ids(["a", "b", "a", "c", "d", "e", "f"], 5) == ["a", "b", "c", "d", "e"]


def test_range_functions(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 5, 1)), (dt.date(2024, 3, 1), dt.date(2024, 2, 1)), (dt.date(2024, 3, 1), None)], "a date, b date")
    rows = df.select(
        D.clamp_to_after_from_edit("a", "b").alias("to"),
        D.clamp_from_after_to_edit("a", "b").alias("frm"),
        D.range_limit("a", "b").alias("n"),
        D.inclusive_days("a", "b").alias("days"),
    ).collect()
    assert rows[0]["to"] == dt.date(2024, 2, 29) and rows[0]["n"] == 60 and rows[0]["days"] == 122
    assert rows[1]["to"] == dt.date(2024, 3, 1) and rows[1]["n"] == 250
    assert rows[1]["frm"] == dt.date(2024, 2, 1)  # an earlier from stays (within 60 days)
    assert rows[2]["to"] == dt.date(2024, 3, 1) and rows[2]["n"] == 250
    assert rows[0]["frm"] == dt.date(2024, 1, 1)
    assert D.range_limit_value(dt.date(2024, 1, 1), dt.date(2024, 1, 10)) == 10
    assert D.range_limit_value(None, dt.date(2024, 1, 10)) == 250
    assert D.range_limit_value(dt.date(2024, 1, 10), dt.date(2024, 1, 1)) == 250


def test_labels(spark):
    df = spark.createDataFrame([(1000.0, 10.0), (10000000.05, 2.5), (0.5, 13.333)], "x double, p double")
    rows = df.select(mw_label("x").alias("m"), percent_label("p").alias("q")).collect()
    assert spark.range(1).select(mw_label(F.lit(0.1) + F.lit(0.2)).alias("m")).first()["m"] == "0.30000000000000004 MW"
    assert [r["m"] for r in rows] == ["1000 MW", "10000000.05 MW", "0.5 MW"]
    assert [r["q"] for r in rows] == ["10.00%", "2.50%", "13.33%"]


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and "facility_name" in df.columns
    from reactorlake.plans import registry

    assert set(registry.QUERIES) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())


def test_inverted_chart_range_is_rejected(spark):
    import pytest

    from reactorlake.errors import ValidationError

    with pytest.raises(ValidationError):
        compare_series(_cat(spark), ["F1"], "2024-01-10", "2024-01-01")


def test_last_wins_with_a_hot_key(spark):
    """One key repeated in a third of the rows: still one row per key, the newest wins."""
    from reactorlake.operators.upsert import last_wins

    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("string").alias("k"),
        F.col("id").cast("double").alias("v"),
        F.col("id").alias("seq"),
    )
    out = {r["k"]: r["v"] for r in last_wins(df, ["k"]).collect()}
    assert len(out) == 2001 and out["0"] == 2997.0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 50)), min_size=1, max_size=60, unique=True))
def test_numbering_property(spark, rows):
    df = spark.createDataFrame(rows, "d int, k int")
    order = [F.col("d").desc(), F.col("k").asc()]
    ours = {(r["d"], r["k"]): r["row_idx"] for r in number_rows(df, order, partitions=3).collect()}
    expected = {key: i for i, key in enumerate(sorted(rows, key=lambda t: (-t[0], t[1])))}
    assert ours == expected


def test_every_series_on_its_own_daily_spine(spark):
    import datetime as dt

    from reactorlake.operators.series import align_all, maps_by_date

    d = lambda i: dt.date(2024, 1, i)
    facts = spark.createDataFrame([(d(1), "a", 1.0), (d(4), "a", None), (d(5), "a", 5.0), (d(3), "b", 3.0)], "date date, facility_id string, outage double")
    got = sorted(tuple(r) for r in align_all(facts).collect())
    assert got == [("a", d(1), 1.0, 0, 0), ("a", d(2), None, 1, 1), ("a", d(3), None, 2, 2), ("a", d(4), None, 0, 3), ("a", d(5), 5.0, 0, 4), ("b", d(3), 3.0, 0, 0)]
    assert {r["date"]: r["series"] for r in maps_by_date(facts).collect()}[d(4)] == {"a": None}
    assert align_all(facts.where("false")).count() == 0
