"""Shared Spark session and small sample frames."""

from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[*]")
        .appName("reactorlake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # Tests set their own checkpoint folder only when the session has none.
    if not session.conf.get("spark.checkpoint.dir", None) and session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reactorlake-test-ck-"))
    yield session


@pytest.fixture()
def scratch(spark):
    from reactorlake.sources.tables import shared_root

    return shared_root(spark)


D = dt.date


@pytest.fixture()
def facility_df(spark):
    """Two reactors a day for five days; the second one has a name of its own per week."""
    rows = [
        (D(2024, 1, 1), "F001", "Plant A", 820.5, 12.25, 1.49),
        (D(2024, 1, 2), "F001", "Plant A", 820.5, 150.0, 18.28),
        (D(2024, 1, 3), "F002", "Plant B", 1310.0, 0.0, 0.0),
        (D(2024, 1, 4), "F002", "Plant B", 1310.0, 655.0, 50.0),
        (D(2024, 1, 5), "F003", "Plant C", 95.75, 95.75, 100.0),
    ]
    return spark.createDataFrame(
        rows,
        "date date, facility_id string, facility_name string, capacity double, outage double, percent_outage double",
    )


@pytest.fixture()
def us_df(spark):
    rows = [(D(2024, 1, day), 90_000.0 + 10 * day, 300.0 * day, 300.0 * day / (900 + day / 10)) for day in range(1, 6)]
    return spark.createDataFrame(rows, "date date, capacity double, outage double, percent_outage double")


@pytest.fixture()
def plants_df(spark):
    return spark.createDataFrame([(f"F00{i}", f"Plant {n}") for i, n in enumerate("ABC", 1)], "facility_id string, facility_name string")


def raw_record(period, facility, name, capacity, outage, percent):
    return {
        "period": period,
        "facility": facility,
        "facilityName": name,
        "capacity": capacity,
        "outage": outage,
        "percentOutage": percent,
    }


def write_page(path: str, offset, records, total):
    """Land one page envelope as a JSON file (what a fetch run writes)."""
    import json

    os.makedirs(os.path.dirname(path), exist_ok=True)
    doc = {"response": {"total": None if total is None else str(total), "data": records}}
    if offset is not None:
        doc["offset"] = offset
    with open(path, "w") as fh:
        json.dump(doc, fh)
