"""Landed source pages -> raw records.

The remote API is not called from Spark. Its pages are landed as JSON, one
page envelope per JSON document, under ``<landing>/<run>/...``: a fetch run is the
first folder below the landing root, however deep its files lie; files directly in the root
are the run ``.``. Runs are ordered by name with numbers compared as numbers
(``run-9`` before ``run-10``).

    {"offset": 0, "response": {"total": "12345", "data": [{...record...}, ...]}}

Reading keeps the source's stop rules, evaluated per run as joins rather than
a driver loop: pages are read in offset order until the first missing or empty
page, and nothing at or past ``total``. Pages behind a *missing* page are held, not
dropped, and what can't be read as a page is broken: ``page_states`` names both, and a refresh reads
them again. Records keep a ``seq`` = (run order, landing time, page offset, file, position) so
later duplicates win. Inside a run folder pages are ordered by offset; files directly in the root are fetches
of their own, ordered by the time they landed.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reactorlake.functions.dates import parse_date
from reactorlake.functions.numbers import array_or_empty, text_to_long
from reactorlake.operators.numbering import number_pages, number_rows, number_tagged, tag_rows
from reactorlake.schemas import CORRUPT, LANDED_SCHEMA, PAGE_SIZE, RAW_RECORD_SCHEMA
from reactorlake.sources.tables import _fs_path, materialize

KEPT, HELD, IGNORED, BROKEN = "kept", "held", "ignored", "broken"
ROOT_RUN = "."

RECORD_FIELDS = RAW_RECORD_SCHEMA.names
PAGE_DATA = T.ArrayType(RAW_RECORD_SCHEMA)


def _file_name(path: Column) -> Column:
    """A file's path as Hadoop writes it (plain characters, ``file:/`` with one slash)."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def _root_name(spark: SparkSession, path: str) -> str:
    fs, p = _fs_path(spark, path)
    return str(fs.makeQualified(p))


def run_of(file: Column, root: str) -> Column:
    """The first folder below the landing root, or ``.``."""
    rel = file.substr(F.lit(len(root) + 2), F.length(file))
    return F.when(F.contains(rel, F.lit("/")), F.substring_index(rel, "/", 1)).otherwise(F.lit(ROOT_RUN))


def run_order(run: Column) -> Column:
    """Names with every number padded, so that text order is natural order."""
    return F.regexp_replace(F.regexp_replace(run, r"(\d+)", "0" * 20 + "$1"), r"\d*(\d{20})", "$1")


def landed_files(spark: SparkSession, path: str) -> DataFrame | None:
    """``run, file`` of every landed file (a listing, no file is opened); None without a landing."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return None
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(_file_name(F.col("path")).alias("file"))
    return listed.select(run_of(F.col("file"), _root_name(spark, path)).alias("run"), "file")


def read_pages(spark: SparkSession, path: str, files: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """S1 scan: one row per landed page (``run, file, at, offset, total, data, broken``) of a
    landing, or of some of its files. What isn't a page is a row whose ``broken`` says why.

    JSON-lines landings are split across tasks; ``multi_line=True`` reads one
    pretty-printed page per file (one task per file).
    """
    raw = (
        spark.read.schema(LANDED_SCHEMA)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)  # run folders are not key=value partitions
        .json(path if files is None else files)
    )
    return pages_of(raw, _root_name(spark, path))


def pages_of(raw: DataFrame, root: str) -> DataFrame:
    """Page envelopes (batch or stream) as ``run, file, at, offset, total, data, broken``."""
    named = raw.select("*", _file_name(F.col("_metadata.file_path")).alias("file"), F.unix_micros("_metadata.file_modification_time").alias("at"))
    run = run_of(F.col("file"), root)
    why = F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit("not a page: "), F.substring(CORRUPT, 1, 200))).when(F.col("response").isNull(), F.lit("no response"))
    return named.select(
        run.alias("run"),
        "file",
        F.when(run == ROOT_RUN, F.col("at")).otherwise(F.lit(0).cast("bigint")).alias("at"),
        F.when(F.col(CORRUPT).isNull(), F.col("offset")).alias("offset"),
        text_to_long(F.col("response.total")).alias("total"),
        F.when(why.isNull(), array_or_empty(F.col("response.data"))).otherwise(F.array().cast(LANDED_SCHEMA["response"].dataType["data"].dataType)).alias("data"),
        why.alias("broken"),
    )


def stage_pages(pages: DataFrame, label: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """``materialize`` for pages of about ``page_size`` records, or their texts: tasks hold some of them at a time."""
    return materialize(pages, label, page_size)


def page_infos(pages: DataFrame) -> DataFrame:
    """What the stop rules and the page index need of each page: ``run, file, offset, total, n, broken``
    and the first and last date of its records (``low, high``)."""
    # Texts of ten characters that are dates order as their dates do, so only the ends are parsed; where
    # a page holds other texts, or an end is no date, all its periods are.
    # Of the records only the periods are read.
    periods, dates = F.col("_periods"), F.transform("_periods", parse_date)
    paged = pages.withColumn("_periods", F.col("data")["period"])
    ends = paged.withColumns({"_plain": F.forall(periods, lambda p: p.isNull() | (F.length(p) == 10)), "_low": parse_date(F.array_min(periods)), "_high": parse_date(F.array_max(periods))})
    plain = F.col("_plain") & F.col("_low").isNotNull() & F.col("_high").isNotNull()
    dated = ends.withColumns({"_low": F.when(plain, F.col("_low")).otherwise(F.array_min(dates)), "_high": F.when(plain, F.col("_high")).otherwise(F.array_max(dates))})
    return dated.groupBy("run", "file", "offset", "broken").agg(
        F.max("total").alias("total"), F.max(F.size("_periods")).alias("n"), F.min("_low").alias("low"), F.max("_high").alias("high")
    )


def page_plan(spark: SparkSession, total: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per page to fetch (``page_no, offset, length``) of a source of
    ``total`` records. The page count is ceil(total / page_size); a total of 0
    still plans the first page (the source is always asked once)."""
    pages = max(1, -(-total // page_size))
    return spark.range(pages).select(
        F.col("id").alias("page_no"),
        (F.col("id") * page_size).alias("offset"),
        F.least(F.lit(page_size).cast("bigint"), F.greatest(F.lit(total).cast("bigint") - F.col("id") * page_size, F.lit(0).cast("bigint"))).alias("length"),
    )


def page_states(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """``run, file, offset, broken, state`` of every page: the source's stop rules per run.

    ``kept``: before the first missing and the first empty page, and before
    ``total`` (the first page always). ``held``: behind a missing page, which may still
    land. ``ignored``: behind an empty page or past the total. ``broken``: no page at all; its place counts
    as missing. Pages without an ``offset`` are plain landed files and are kept.
    ``pages`` are pages or their ``page_infos``.
    """
    infos = pages if "n" in pages.columns else page_infos(pages)
    paged = infos.where(F.col("offset").isNotNull() & F.col("broken").isNull())
    info = paged.groupBy("run", "offset").agg(F.max("total").alias("total"), F.max("n").alias("n"))
    ends = info.groupBy("run").agg(F.min_by("total", "offset").alias("total"), F.min(F.when(F.col("n") == 0, F.col("offset"))).alias("empty"))
    ends = ends.withColumn("total", F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)).cast("bigint"))
    # a page is missing where neither it nor its successor's place is landed: compare each page with the one before
    due = ends.select("run", F.lit(0).cast("bigint").alias("offset")).unionByName(info.select("run", (F.col("offset") + page_size).alias("offset")))
    missing = due.join(info.select("run", "offset"), ["run", "offset"], "left_anti").groupBy("run").agg(F.min("offset").alias("missing"))
    ends = ends.join(missing, "run", "left").withColumnsRenamed({"total": "run_total"})
    stop = F.least(F.col("empty"), F.col("missing"), F.col("run_total"))
    gap = F.coalesce(F.col("missing") < F.least(F.col("empty"), F.col("run_total")), F.lit(False))
    state = (
        F.when(F.col("broken").isNotNull(), BROKEN)
        .when(F.col("offset").isNull() | (F.col("offset") < stop), KEPT)
        .when(gap & (F.col("offset") < F.col("run_total")), HELD)
        .otherwise(IGNORED)
    )
    return infos.join(ends, "run", "left").select(*infos.columns, state.alias("state"))


def kept_pages(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """The pages that the stop rules keep. ``pages`` is read twice: stage it."""
    return pages_in(pages, page_states(pages, page_size).where(F.col("state") == KEPT))


def pages_in(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pages that are no broken ones and whose (run, file, offset) is in ``chosen``."""
    some = chosen.select("run", "file", F.col("offset").alias("_offset"))
    on = (pages["run"] == some["run"]) & (pages["file"] == some["file"]) & pages["offset"].eqNullSafe(some["_offset"])
    return pages.where(F.col("broken").isNull()).join(some, on, "left_semi")


#: Bits of a record's ``ord`` that hold its position in its page.
POS_BITS = 31


def page_places(pages: DataFrame) -> DataFrame:
    """The landing order of pages, one row per place: ``page`` (its number in that order), ``run``, ``at``,
    ``offset`` (0 without one), ``file``, ``run_key`` (the run as it is ordered)."""
    places = pages.select("run", "at", F.coalesce(F.col("offset"), F.lit(0).cast("bigint")).alias("offset"), "file").distinct()
    places = places.withColumn("run_key", run_order(F.col("run")))
    return number_rows(places, [F.col(c) for c in ("run_key", "at", "offset", "file")], "page")


def ordered_records(pages: DataFrame, places: DataFrame) -> DataFrame:
    """Every record of the pages, with the columns of its place but those only ``seq`` needs, and ``ord``: one
    number that orders records as ``seq`` does (``page``, then position)."""
    on = ["run", "file", "offset"]
    placed = pages.select("run", "file", F.coalesce(F.col("offset"), F.lit(0).cast("bigint")).alias("offset"), "data")
    placed = placed.join(places.drop("at", "run_key"), on).drop("file", "offset")
    exploded = placed.select(*[c for c in placed.columns if c != "data"], F.posexplode(F.col("data")).alias("pos", "rec"))
    order = F.shiftleft(F.col("page"), POS_BITS).bitwiseOR(F.col("pos").cast("bigint"))
    return exploded.select(*[F.col(f"rec.{f}").alias(f) for f in RECORD_FIELDS], order.alias("ord"), *[c for c in placed.columns if c not in ("data", "page")])


def place_of(df: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with ``ord``, with the columns of their page's place and ``pos``."""
    pos = F.col("ord").bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")
    return df.withColumns({"page": F.shiftright(F.col("ord"), POS_BITS), "pos": pos}).join(places, "page").drop("page", "ord")


def with_seq(df: DataFrame, places: DataFrame) -> DataFrame:
    """``seq`` instead of ``ord``: the places of the records go back to them by page number."""
    placed = place_of(df, places.select("page", "run_key", "at", "offset", "file"))
    seq = F.struct(F.col("run_key").alias("run"), "at", "offset", "file", "pos")
    return placed.select(*[c for c in df.columns if c != "ord"], seq.alias("seq"))


def records_from_pages(pages: DataFrame) -> DataFrame:
    """Every record of every kept page (no dedupe), with ``seq`` and its ``run``."""
    exploded = pages.select("run", "file", "at", "offset", F.posexplode(F.col("data")).alias("pos", "rec"))
    return exploded.select(
        *[F.col(f"rec.{f}").alias(f) for f in RECORD_FIELDS],
        F.struct(
            run_order(F.col("run")).alias("run"), F.col("at"), F.coalesce(F.col("offset"), F.lit(0).cast("bigint")).alias("offset"), F.col("file"), F.col("pos")
        ).alias("seq"),
        "run",
    )


def filter_period(
    records: DataFrame, start: _dt.date | Column | None = None, end: _dt.date | Column | None = None
) -> DataFrame:
    """Inclusive ``start`` / ``end`` bounds (dates, or date columns such
    as a scalar subquery; a NULL bound is no bound) on the record date. Records
    whose period is not a date are kept here; validation decides about them."""
    d = parse_date("period")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (d.isNull() | F.lit(start).isNull() | (d >= F.lit(start)))
    if end is not None:
        cond = cond & (d.isNull() | F.lit(end).isNull() | (d <= F.lit(end)))
    return records.where(cond)


def landed_records(
    spark: SparkSession,
    path: str,
    start: _dt.date | None = None,
    end: _dt.date | None = None,
    multi_line: bool = False,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """S1 + S3 + S5: the raw records the source would have returned. The JSON is
    parsed once, into a stage that the stop rules and the records both read."""
    pages = stage_pages(read_pages(spark, path, None, multi_line), "pages", page_size)
    return filter_period(records_from_pages(kept_pages(pages, page_size)), start, end).drop("run")


def page_envelopes(
    records: DataFrame, order: list | None = None, page_size: int = PAGE_SIZE, first_offset: int = 0, total: int | None = None
) -> DataFrame:
    """Records as source pages (``offset, response``), used to build landings from tables.

    Rows are numbered without a global window (in ``order`` if given, else any) and
    put into pages of exactly ``page_size`` rows (each page is held as a whole).
    """
    pages, count = _ordered_pages(records, order, page_size) if order else _pages(records, page_size)
    reported = count.cast("string") if total is None else F.lit(str(total))
    offset = (F.col("page_no") * F.lit(page_size) + F.lit(first_offset)).cast("bigint").alias("offset")
    return pages.select(offset, F.struct(reported.alias("total"), F.col("data")).alias("response"))


def page_texts(
    records: DataFrame, order: list | None = None, page_size: int = PAGE_SIZE, first_offset: int = 0, total: int | None = None
) -> DataFrame:
    """``page_envelopes`` as text: ``offset`` and the page's JSON (``value``), for pages that are staged before they are landed."""
    pages = page_envelopes(records, order, page_size, first_offset, total)
    return pages.select("offset", F.to_json(F.struct("offset", "response")).alias("value"))


def _ordered_pages(records: DataFrame, order: list | None, page_size: int) -> tuple[DataFrame, Column]:
    """Pages (``page_no, data``) of the records in ``order`` (without one: as they come), and their number of records."""
    numbered = number_pages(records.select(*RECORD_FIELDS, *[c for c in records.columns if c not in RECORD_FIELDS]), order or [], page_size)
    # counted on the stored numbering, so that the records are not computed a second time
    count = numbered.select(F.count(F.lit(1))).scalar()
    # without the exchange first, lists would be gathered on both sides of it, and sorted and spilled beyond a few pages a task
    rows = numbered.select("page_no", "page_pos", *RECORD_FIELDS).repartition("page_no")
    pages = rows.groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("page_pos", F.struct(*RECORD_FIELDS).alias("rec")))).alias("_recs"))
    return pages.select("page_no", F.transform("_recs", lambda x: x["rec"]).alias("data")), count


def _pages(records: DataFrame, page_size: int) -> tuple[DataFrame, Column]:
    """``_ordered_pages`` for any order: every task cuts its own rows into pages, so no record is shuffled but those of
    the rests, less than a page for each task, which make up the last pages together."""
    cut = records.select(*RECORD_FIELDS).mapInArrow(_cutter(page_size), T.StructType([T.StructField("data", PAGE_DATA)]))
    staged = tag_rows(cut.withColumn("n", F.size("data")), "pages-cut", page_size)
    count = staged.select(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    whole = staged.where(F.col("n") == page_size)
    wholes = whole.select(F.count(F.lit(1))).scalar()
    rest, _ = _ordered_pages(staged.where(F.col("n") < page_size).select(F.inline("data")), None, page_size)
    pages = number_tagged(whole, "page_no").select("page_no", "data")
    return pages.unionByName(rest.withColumn("page_no", F.col("page_no") + wholes)), count


def _cutter(page_size: int):
    """For ``mapInArrow``: a task's rows as lists of ``page_size`` rows; what is left at its end is one shorter list."""

    def cut(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, page_size - n)
                held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                if n == page_size:
                    yield page(pa, held, n)
                    held, n = [], 0
        if n:
            yield page(pa, held, n)

    def page(pa, held, n):
        rows = pa.concat_arrays([b.to_struct_array() for b in held])
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows)], ["data"])

    return cut


def write_pages(records: DataFrame, path: str, order: list | None = None, page_size: int = PAGE_SIZE, mode: str = "error") -> None:
    """Land records as JSON lines, one page envelope per line."""
    land(page_envelopes(records, order, page_size), path, mode)


def land(pages: DataFrame, path: str, mode: str = "error") -> None:
    """Land page envelopes, or their ``page_texts``, as gzipped JSON lines: field names repeat in every record, so the text
    is several times the data, and the fastest level takes most of that away. Each writing task's file is then read by one task."""
    texts = "value" in pages.columns
    writer = pages.select(["value"] if texts else pages.columns).write.mode(mode).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    (writer.text if texts else writer.json)(path)
