"""Validation and transform of raw source records.

Raw records carry the source's field names with every value as text. The
transform is one ``DataFrame.transform`` chain of built-in expressions, so it
runs inside whole-stage codegen on every executor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reactorlake.functions.dates import parse_date
from reactorlake.functions.numbers import coerce_double
from reactorlake.schemas import (
    COLUMN_MAPPING,
    FACILITY_BATCH_SCHEMA,
    NUMERIC_COLUMNS,
    REQUIRED_FIELDS_FACILITY,
    REQUIRED_FIELDS_US,
    US_SCHEMA,
)

REQUIRED = {"facility": REQUIRED_FIELDS_FACILITY, "us": REQUIRED_FIELDS_US}
OUTPUT_SCHEMA = {"facility": FACILITY_BATCH_SCHEMA, "us": US_SCHEMA}


def _present(field: str) -> Column:
    """A field counts as present unless absent (NULL) or the empty text."""
    c = F.col(field)
    return c.isNotNull() & (c.cast("string") != F.lit(""))


BAD_DATE = "period (not a date)"


def _source_numbers(df: DataFrame) -> dict[str, str]:
    """Numeric columns by the source name of their texts, as far as ``df`` has them."""
    back = {v: k for k, v in COLUMN_MAPPING.items()}
    return {back.get(c, c): c for c in NUMERIC_COLUMNS if back.get(c, c) in df.columns}


def parse_once(df: DataFrame) -> DataFrame:
    """Raw records with their parsed date and numbers (``_date``, ``_<column>``) beside the texts, for
    the functions below that take a ``day`` or ``parsed``: each text is parsed once for all of them."""
    return df.withColumns({"_date": parse_date("period"), **{f"_{c}": coerce_double(f) for f, c in _source_numbers(df).items()}})


def is_valid(required: list[str], day: Column | None = None) -> Column:
    """P1 predicate: every required field present, and a required period a date;
    no requirements -> always true."""
    if not required:
        return F.lit(True)
    present = reduce(lambda a, b: a & b, [_present(f) for f in required])
    return present & (parse_date("period") if day is None else day).isNotNull() if "period" in required else present


def validate_records(df: DataFrame, required: list[str]) -> DataFrame:
    """Keep records with all required fields (``0`` and ``" "`` pass)."""
    return df.where(is_valid(required))


def missing_fields(required: list[str], day: Column | None = None) -> Column:
    """Names of the failing required fields, in requirement order, then the bad date."""
    if not required:
        return F.array().cast("array<string>")
    checks = [F.when(~_present(f), F.lit(f)).otherwise(F.lit(None).cast("string")) for f in required]
    if "period" in required:
        # a present period that is no ``yyyy-MM-dd`` date: the record has no usable key
        checks.append(F.when(_present("period") & (parse_date("period") if day is None else day).isNull(), F.lit(BAD_DATE)))
    return F.array_compact(F.array(*checks))


def quarantine(df: DataFrame, required: list[str]) -> DataFrame:
    """Rejected records plus ``missing_fields`` (comma-joined report text).
    Every record is either valid or listed here."""
    return (
        df.withColumn("_missing", missing_fields(required))
        .where(F.size("_missing") > 0)
        .withColumn("missing_fields", F.array_join("_missing", ", "))
        .drop("_missing")
    )


def _fails(field: str, column: str, parsed: bool) -> Column:
    return _present(field) & (F.col(f"_{column}") if parsed else coerce_double(field)).isNull()


def failed_numbers(df: DataFrame, parsed: bool = False) -> Column:
    """The numeric texts of a raw record that P4 turns into NULL, as structs (``field``: its source name, ``text``)."""
    failed = [F.when(_fails(f, c, parsed), F.struct(F.lit(f).alias("field"), F.col(f).alias("text"))) for f, c in _source_numbers(df).items()]
    return F.array_compact(F.array(*failed))


def any_failed_number(df: DataFrame, parsed: bool = False) -> Column:
    """Whether ``failed_numbers`` lists any."""
    return reduce(lambda a, b: a | b, [_fails(f, c, parsed) for f, c in _source_numbers(df).items()], F.lit(False))


def validation_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """A5: total and valid record counts in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(is_valid(required)).alias("valid_records"),
    )


def rename_source_columns(df: DataFrame) -> DataFrame:
    """Source names -> table names (only the columns that exist)."""
    return df.withColumnsRenamed({k: v for k, v in COLUMN_MAPPING.items() if k in df.columns})


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Text -> DOUBLE; bad text becomes NULL and the row is kept."""
    return df.withColumns({c: coerce_double(c) for c in NUMERIC_COLUMNS if c in df.columns})


def project(df: DataFrame, dataset: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """P5: per-dataset projection with fixed output types (date parsed to DATE)."""
    schema = OUTPUT_SCHEMA[dataset]
    cols = []
    for field in schema.fields:
        if field.name == "date":
            cols.append(parse_date(F.col("date")).alias("date"))
        else:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
    cols += [F.col(k) for k in keep if k in df.columns]
    return df.select(*cols)


def transform_records(df: DataFrame, dataset: str, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """P7 = P1 -> P3 -> P4 -> P5.

    A record whose ``period`` is present but is not a ``yyyy-MM-dd`` date has no
    usable key; it is rejected like one with a missing field and ``quarantine`` lists it.
    """
    if dataset not in REQUIRED:
        raise ValueError(f"no transform for dataset {dataset!r}")
    return (
        df.transform(validate_records, REQUIRED[dataset])
        .transform(rename_source_columns)
        .transform(coerce_numbers)
        .transform(project, dataset, keep)
    )


def project_parsed(dataset: str) -> list[Column]:
    """P3-P5 over ``parse_once``: the columns of a valid record as they are stored."""
    source = {v: k for k, v in COLUMN_MAPPING.items()}
    parsed = {"date", *NUMERIC_COLUMNS}
    return [F.col(f"_{f.name}" if f.name in parsed else source.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in OUTPUT_SCHEMA[dataset].fields]


def drop_name(df: DataFrame) -> DataFrame:
    """The fact table keeps no name once the dimension is cut out."""
    return df.drop("facility_name")


def distinct_plants(facility_batch: DataFrame) -> DataFrame:
    """Distinct (facility_id, facility_name) pairs. Ordering (L8) is left to
    the caller's read, so no global sort is planned here."""
    return facility_batch.select("facility_id", "facility_name").distinct()
