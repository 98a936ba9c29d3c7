"""Explicit schemas, keys and orderings of every table (no per-batch type inference)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from reactorlake.errors import ValidationError

# ---------------------------------------------------------------------------
# Stored tables
# ---------------------------------------------------------------------------

FACILITY_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("facility_id", T.StringType()),
        T.StructField("capacity", T.DoubleType()),
        T.StructField("outage", T.DoubleType()),
        T.StructField("percent_outage", T.DoubleType()),
    ]
)

US_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("capacity", T.DoubleType()),
        T.StructField("outage", T.DoubleType()),
        T.StructField("percent_outage", T.DoubleType()),
    ]
)

PLANTS_SCHEMA = T.StructType(
    [
        T.StructField("facility_id", T.StringType()),
        T.StructField("facility_name", T.StringType()),
    ]
)

# Facility batch before the name is cut out into the dimension (P5).
FACILITY_BATCH_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("facility_id", T.StringType()),
        T.StructField("facility_name", T.StringType()),
        T.StructField("capacity", T.DoubleType()),
        T.StructField("outage", T.DoubleType()),
        T.StructField("percent_outage", T.DoubleType()),
    ]
)

STATE_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("last_extraction_date", T.DateType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# Landing order of a stored row: which landed record it comes from. Base tables
# keep it beside the public columns, so that older records never replace newer ones.
SEQ_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

# ---------------------------------------------------------------------------
# Raw source records (every field read as text, then coerced)
# ---------------------------------------------------------------------------

RAW_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("period", T.StringType()),
        T.StructField("facility", T.StringType()),
        T.StructField("facilityName", T.StringType()),
        T.StructField("capacity", T.StringType()),
        T.StructField("outage", T.StringType()),
        T.StructField("percentOutage", T.StringType()),
    ]
)

# One landed page: what the source returns for one offset. ``offset`` is
# optional; when a page file lacks it, the file path orders the pages.
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("offset", T.LongType()),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField("total", T.StringType()),
                    T.StructField("data", T.ArrayType(RAW_RECORD_SCHEMA)),
                ]
            ),
        ),
    ]
)

# What Spark's reader puts a page into that it can't parse.
CORRUPT = "_corrupt_record"
LANDED_SCHEMA = T.StructType([*PAGE_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])

# Fixed values that must equal the source's field lists and names.
PAGE_SIZE = 5000
REQUIRED_FIELDS_FACILITY = [
    "period",
    "facility",
    "facilityName",
    "capacity",
    "outage",
    "percentOutage",
]
REQUIRED_FIELDS_US = ["period", "capacity", "outage", "percentOutage"]
COLUMN_MAPPING = {
    "period": "date",
    "facility": "facility_id",
    "facilityName": "facility_name",
    "percentOutage": "percent_outage",
}
NUMERIC_COLUMNS = ["capacity", "outage", "percent_outage"]

# Read-API limits: default page and hard maximum.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000


@dataclass(frozen=True)
class Dataset:
    """One public dataset: storage name, schema, merge keys, read order."""

    public: str
    storage: str
    schema: T.StructType
    keys: tuple[str, ...]
    # (column, ascending) pairs: a total order, so pages are stable.
    order: tuple[tuple[str, bool], ...]
    has_date: bool
    partition_by_month: bool


DATASETS: dict[str, Dataset] = {
    "facility": Dataset(
        "facility",
        "facility_outages",
        FACILITY_SCHEMA,
        ("date", "facility_id"),
        (("date", False), ("facility_id", True)),
        True,
        True,
    ),
    "us": Dataset("us", "us_outages", US_SCHEMA, ("date",), (("date", False),), True, False),
    "plants": Dataset(
        "plants", "plants", PLANTS_SCHEMA, ("facility_id",), (("facility_id", True),), False, False
    ),
}

STORAGE_TO_PUBLIC = {d.storage: d.public for d in DATASETS.values()}


def resolve(dataset: str) -> Dataset:
    """Public name (or storage name) -> dataset; unknown names are rejected."""
    if dataset in DATASETS:
        return DATASETS[dataset]
    if dataset in STORAGE_TO_PUBLIC:
        return DATASETS[STORAGE_TO_PUBLIC[dataset]]
    raise ValidationError(f"Invalid dataset: {dataset!r} is none of {', '.join(DATASETS)}")
