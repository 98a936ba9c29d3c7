"""Outage-shaped frames derived from the driver's test tables.

This is a fixture, not an engine operator: the test tables carry no outage
data, so ``lineitem`` is reshaped into daily facility and national series and
``supplier`` into the facility dimension. The same rules are written as SQL in
``reactorlake.plans.oracle`` so DuckDB can reproduce every value bit for bit.

Rules (exact): capacity = sum of prices, outage = sum of price x discount, both
summed as decimals and then cast to DOUBLE; percent = outage * 100 / capacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.functions.dates import format_date

# Fixed values of the fixture's deterministic damage (day of year divisors).
BLANK_NAME_EVERY = 97
NULL_NAME_EVERY = 89
BAD_CAPACITY_EVERY = 83
BLANK_OUTAGE_EVERY = 89
# Increment fixture: re-read window and the shift that produces new keys.
INCREMENT_LOOKBACK_DAYS = 30
# Whole numbers are summed as their lower bits and the rest.
HALF_BITS = 24
INCREMENT_NEW_KEY_SHIFT_DAYS = 31


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(name: str, below: int) -> tuple[Column, Column]:
    """A column of doubles as whole hundredths, and whether that is its value as a decimal with two places: a double
    that is the nearest to such a number (smaller than ``below`` hundredths) reads as it."""
    number = F.rint(F.col(name) * 100.0)
    return number.cast("bigint"), (number / 100.0 == F.col(name)) & (F.abs(number) < below)


def _exact_sum(name: str, plain: Column, whole: Column, number: Column) -> list[Column]:
    """Sums behind ``_as_double``: of whole numbers where ``plain`` (in two halves, which no number of rows overflows), else of decimals."""
    some = F.when(plain, whole)
    halves = [F.sum(F.shiftright(some, HALF_BITS)).alias(f"{name}_high"), F.sum(some.bitwiseAND(F.lit((1 << HALF_BITS) - 1))).alias(f"{name}_low")]
    return [*halves, F.sum(F.when(~plain, number)).alias(f"{name}_odd")]


def _as_double(name: str, unit: int) -> Column:
    """The exact sum as DOUBLE, ``unit`` whole numbers being 1: below 2**52 one division, as a decimal's own conversion does it."""
    high, low, odd = (F.col(f"{name}_{x}") for x in ("high", "low", "odd"))
    small = odd.isNull() & (F.abs(high) < 1 << (51 - HALF_BITS)) & (low < 1 << 51)
    exact = (high.cast("decimal(19,0)") * F.lit(1 << HALF_BITS).cast("decimal(8,0)") + low.cast("decimal(19,0)")) * F.lit(f"{1 / unit:.4f}").cast("decimal(4,4)")
    total = (exact + F.coalesce(odd, F.lit(0).cast("decimal(18,2)"))).cast("double")
    return F.when(high.isNull(), odd.cast("double")).when(small, (high * F.lit(1 << HALF_BITS) + low) / F.lit(float(unit))).otherwise(total).alias(name)


def _daily(li: DataFrame, keys: list[Column]) -> DataFrame:
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    # as a rule prices are plain: their sums need no decimals, which take several times as long
    cents, plain = _hundredths("l_extendedprice", 1 << 31)
    percent, both = _hundredths("l_discount", 10_000)
    both = plain & both
    sums = li.groupBy(*keys).agg(*_exact_sum("capacity", plain, cents, price), *_exact_sum("outage", both, cents * percent, price * discount))
    daily = sums.select(*[c for c in sums.columns if not c.startswith(("capacity_", "outage_"))], _as_double("capacity", 100), _as_double("outage", 10_000))
    return daily.withColumn("percent_outage", F.try_divide(F.col("outage") * F.lit(100.0), F.col("capacity")))


def facility_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, facility_id, capacity, outage, percent_outage``: one row per day and supplier."""
    li = _table(spark, sf_dir, "lineitem")
    return _daily(
        li,
        [
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_suppkey").cast("string").alias("facility_id"),
        ],
    )


def us_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, capacity, outage, percent_outage``: one row per day."""
    li = _table(spark, sf_dir, "lineitem")
    return _daily(li, [F.col("l_shipdate").cast("date").alias("date")])


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``facility_id, facility_name`` from ``supplier``."""
    return _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("facility_id"),
        F.col("s_name").alias("facility_name"),
    )


def plants_with_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants plus the supplier balance, for fixtures that remove dimension rows."""
    return _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("facility_id"),
        F.col("s_name").alias("facility_name"),
        F.col("s_acctbal").alias("balance"),
    )


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def raw_facility_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-shaped facility records (API names, every value as text), with damage.

    name ``''`` on day-of-year multiples of 97, NULL on multiples of 89,
    capacity ``'n/a'`` on multiples of 83. ``seq`` is the landing order.
    """
    return raw_records_from(facility_outages(spark, sf_dir), plants(spark, sf_dir))


def raw_records_from(fac: DataFrame, names: DataFrame) -> DataFrame:
    """Source-shaped records of any facility frame, with the damage rule above."""
    doy = F.dayofyear("date")
    return fac.join(names, "facility_id", "left").select(
        format_date("date").alias("period"),
        F.col("facility_id").alias("facility"),
        F.when(doy % BLANK_NAME_EVERY == 0, F.lit(""))
        .when(doy % NULL_NAME_EVERY == 0, F.lit(None).cast("string"))
        .otherwise(F.col("facility_name"))
        .alias("facilityName"),
        F.when(doy % BAD_CAPACITY_EVERY == 0, F.lit("n/a")).otherwise(_text("capacity")).alias("capacity"),
        _text("outage").alias("outage"),
        _text("percent_outage").alias("percentOutage"),
    )


def raw_us_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-shaped national records: capacity ``'n/a'`` (kept as NULL) and
    outage ``''`` (record rejected) on the day-of-year multiples above."""
    us = us_outages(spark, sf_dir)
    doy = F.dayofyear("date")
    return us.select(
        format_date("date").alias("period"),
        F.lit(None).cast("string").alias("facility"),
        F.lit(None).cast("string").alias("facilityName"),
        F.when(doy % BAD_CAPACITY_EVERY == 0, F.lit("n/a")).otherwise(_text("capacity")).alias("capacity"),
        F.when(doy % BLANK_OUTAGE_EVERY == 0, F.lit("")).otherwise(_text("outage")).alias("outage"),
        _text("percent_outage").alias("percentOutage"),
    )


def _latest_date(frame: DataFrame) -> Column:
    """Scalar subquery: the frame's newest date (planned once, no cross join)."""
    return frame.select(F.max("date")).scalar()


def increment(frame: DataFrame) -> DataFrame:
    """A later batch for a daily table: the trailing 30 days re-sent with outage
    doubled (updates), plus those rows moved 31 days on (new keys)."""
    latest = _latest_date(frame)
    recent = frame.where(F.col("date") >= F.date_sub(latest, INCREMENT_LOOKBACK_DAYS))
    doubled = recent.withColumn("outage", F.col("outage") * F.lit(2.0)).withColumn(
        "percent_outage", F.try_divide(F.col("outage") * F.lit(100.0), F.col("capacity"))
    )
    moved = recent.withColumn("date", F.date_add("date", INCREMENT_NEW_KEY_SHIFT_DAYS))
    return doubled.unionByName(moved)
