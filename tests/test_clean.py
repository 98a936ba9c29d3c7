"""Validation, coercion and transform of raw records."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reactorlake.operators import clean as C
from reactorlake.schemas import RAW_RECORD_SCHEMA
from tests.conftest import raw_record

REQ = ["period", "facility", "capacity"]


def _records(spark, rows):
    return spark.createDataFrame(rows, RAW_RECORD_SCHEMA)


@pytest.mark.parametrize(
    "rec, keep",
    [
        (raw_record("2024-01-01", "F1", "A", "1", "2", "3"), True),  # all present
        (raw_record("2024-01-01", None, "A", "1", "2", "3"), False),  # absent
        (raw_record("2024-01-01", "", "A", "1", "2", "3"), False),  # empty text
        (raw_record(None, "F1", "A", "1", "2", "3"), False),  # None
        (raw_record("2024-01-01", "F1", "A", "0", "2", "3"), True),  # 0 passes
        (raw_record("2024-01-01", " ", "A", "1", "2", "3"), True),  # a blank passes
    ],
)
def test_required_field_filter(spark, rec, keep):
    out = C.validate_records(_records(spark, [rec]), REQ)
    assert out.count() == (1 if keep else 0)


def test_no_requirements_keeps_everything(spark):
    df = _records(spark, [raw_record(None, None, None, None, None, None)])
    assert C.validate_records(df, []).count() == 1


def test_missing_field_report(spark):
    df = _records(
        spark,
        [
            raw_record("2024-01-01", "", "A", None, "2", "3"),
            raw_record("2024-01-02", "F1", "A", "1", "2", "3"),
        ],
    )
    out = C.quarantine(df, REQ).collect()
    assert len(out) == 1
    assert out[0]["missing_fields"] == "facility, capacity"


def test_validation_counts(spark):
    df = _records(
        spark,
        [raw_record("2024-01-01", "F1", "A", "1", "2", "3"), raw_record("2024-01-01", None, "A", "1", "2", "3")],
    )
    row = C.validation_counts(df, REQ).first()
    assert (row["total_records"], row["valid_records"]) == (2, 1)


@pytest.mark.parametrize(
    "text, value",
    [
        ("12", 12.0),
        (" 12 ", 12.0),
        ("1e3", 1000.0),
        ("-2.5", -2.5),
        (".5", 0.5),
        ("5.", 5.0),
        ("+7", 7.0),
        ("inf", float("inf")),
        ("-Infinity", float("-inf")),
        ("n/a", None),
        ("", None),
        ("12d", None),
        ("0x1p3", None),
        ("NaN", None),
        ("1,000", None),
        (None, None),
    ],
)
def test_coercing_numeric_cast(spark, text, value):
    from reactorlake.functions.numbers import coerce_double

    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(coerce_double("s").alias("v")).first()["v"] == value


def test_transform_facility_keeps_rows_with_bad_numbers(spark):
    df = _records(
        spark,
        [
            raw_record("2024-01-01", "F001", "Plant A", "1000", "100", "10"),
            raw_record("2024-01-02", "F001", "Plant A", "n/a", "150", "15"),
            raw_record("2024-01-03", "F002", "", "1500", "200", "13.3"),
        ],
    )
    out = C.transform_records(df, "facility").orderBy("date").collect()
    assert [r["date"] for r in out] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert out[1]["capacity"] is None and out[1]["outage"] == 150.0
    assert C.transform_records(df, "facility").columns == [
        "date",
        "facility_id",
        "facility_name",
        "capacity",
        "outage",
        "percent_outage",
    ]


def test_transform_us_projection_and_empty_batch(spark):
    df = _records(spark, [raw_record("2024-01-01", None, None, "100000", "5000", "5")])
    out = C.transform_records(df, "us")
    assert out.columns == ["date", "capacity", "outage", "percent_outage"]
    assert out.count() == 1
    empty = C.transform_records(_records(spark, []), "us")
    assert empty.count() == 0 and empty.columns == out.columns  # typed empty frame (D8)


def test_distinct_plants(spark, facility_df):
    out = C.distinct_plants(facility_df).orderBy("facility_id")
    rows = out.collect()
    assert len(rows) == 3
    assert out.columns == ["facility_id", "facility_name"]
    ids = [r["facility_id"] for r in rows]
    assert ids == sorted(ids) and len(set(ids)) == 3


def test_bad_period_text_is_dropped(spark):
    df = _records(spark, [raw_record("2024-13-01", "F1", "A", "1", "2", "3"), raw_record("2024-1-5", "F1", "A", "1", "2", "3")])
    assert C.transform_records(df, "facility").count() == 0
    assert C.validate_records(df, C.REQUIRED["facility"]).count() == 0
    assert [r["missing_fields"] for r in C.quarantine(df, C.REQUIRED["facility"]).collect()] == [C.BAD_DATE] * 2
    counts = C.validation_counts(df, C.REQUIRED["facility"]).first()
    assert (counts["total_records"], counts["valid_records"]) == (2, 0)
    assert df.select(F.lit(1)).count() == 2


def test_text_totals_and_ceiling_pages(spark):
    from reactorlake.functions.numbers import ceil_div, ceil_div_int, text_to_long

    df = spark.createDataFrame([("12001",), (" 7 ",), ("abc",), (None,), ("0",)], "t string")
    rows = df.select(text_to_long("t").alias("n"), ceil_div(text_to_long("t"), 5000).alias("pages")).collect()
    assert [r["n"] for r in rows] == [12001, 7, 0, 0, 0]
    assert [r["pages"] for r in rows] == [3, 1, 0, 0, 0]
    assert [ceil_div_int(n, 5000) for n in (0, 1, 5000, 5001)] == [0, 1, 1, 2]


def test_missing_record_list_reads_as_empty(spark):
    from reactorlake.functions.numbers import array_or_empty

    df = spark.createDataFrame([(None,), (["a"],)], "xs array<string>")
    assert [r[0] for r in df.select(F.size(array_or_empty("xs"))).collect()] == [0, 1]


def test_labels_keep_nulls(spark):
    from reactorlake.functions.labels import mw_label, percent_label

    df = spark.createDataFrame([(None, None)], "x double, p double")
    row = df.select(mw_label("x").alias("m"), percent_label("p").alias("q")).first()
    assert row["m"] is None and row["q"] is None
