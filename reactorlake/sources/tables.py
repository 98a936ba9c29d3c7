"""Stored tables: base tables, published snapshots, existence tests.

Layout under one warehouse root (a shared filesystem path; by default a folder
under the session's ``spark.checkpoint.dir``)::

    data/<table>/<write>/[ym=YYYY-MM/]     files of one write, never changed afterwards
    base/<table>/manifest-<n>.json         what the base table is made of
    published/<table>/manifest-<n>.json    what readers see
    state/manifest-<n>.json                watermarks
    progress/<table>/manifest-<n>.json     folders that hold the states of landed pages
    rejected/<table>/manifest-<n>.json     folders that hold what refreshes rejected or could not convert
    pins/<token>.json                      manifests that a reader holds on to, and until when

A manifest lists, per month (one entry for tables without months), the folder
that holds it, its rows and the rows of each of its dates: counts and places of pages are read from it (at most one number
per day, whatever the rows). A write puts its files into a new folder and then switches the
manifest, the only step readers notice: a crash before it leaves the old table
whole. Publishing copies the base table's manifest, not its files. These are
plain parquet folders with a pointer file, not a transaction log: one writer at
a time is assumed.
"""

from __future__ import annotations

import contextlib
import contextvars
import datetime as _dt
import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reactorlake.errors import DataNotFoundError, ProcessingError
from reactorlake.functions.dates import format_month
from reactorlake.schemas import DATASETS, SEQ_SCHEMA, Dataset, resolve

MONTH_COL = "ym"
SEQ_COL = "seq"
#: The landing order as one number, while a refresh merges its rows.
ORD_COL = "ord"
#: The single part of a table without months.
WHOLE = "all"
#: What Spark raises for files that are gone or can't be read (and broken JSON of a manifest).
READ_ERRORS = (PySparkException, Py4JError, json.JSONDecodeError, OSError)
#: Folders of a log from which on they are written together as one.
LOG_FOLDERS = 8


# ---------------------------------------------------------------------------
# Shared folder
# ---------------------------------------------------------------------------


def shared_root(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local session without it (tests, a
    bare shell) gets a folder of its own; elsewhere executors would write to
    their own disks, so a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ProcessingError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="reactorlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/reactorlake/{name or uuid.uuid4().hex}"


_STAGE_ROOT: contextvars.ContextVar[str | None] = contextvars.ContextVar("reactorlake_stage_root", default=None)


@contextlib.contextmanager
def stage_scope(spark: SparkSession):
    """Stages written inside the block go to one folder that is deleted when
    the block ends (use it where nothing returned reads those stages, e.g. a
    refresh or one streaming micro-batch)."""
    root = shared_root(spark, f"_stage/scope-{uuid.uuid4().hex}")
    token = _STAGE_ROOT.set(root)
    try:
        yield root
    finally:
        _STAGE_ROOT.reset(token)
        fs, p = _fs_path(spark, root)
        if fs.exists(p):
            fs.delete(p, True)


#: Records that a row group of a stage holds where a row is a list of records: Spark's reader takes up to 4,096 rows of a
#: row group at once, whatever they hold, and its writer looks at the size of a row group after the first hundred only.
GROUP_RECORDS = 50_000
#: Bytes of such a row group, where rows hold more records than they should.
GROUP_BYTES = 8 << 20


def materialize(df: DataFrame, label: str = "stage", row_records: int = 1) -> DataFrame:
    """Cut lineage by writing ``df`` once as parquet into a fresh folder under
    the shared checkpoint folder and reading it back.

    Unlike ``Dataset.checkpoint(eager=True)`` (one job to count, a second that
    recomputes the plan to write the files), the plan runs exactly once; the
    result is a plain columnar scan, so later steps prune columns and lost
    executors re-read files instead of recomputing the upstream.

    ``row_records``: how many records a row holds (a page of them, or its text). Row groups of such rows are kept
    small, so that a task holds some pages at a time and not all pages of its file.
    """
    spark = df.sparkSession
    scope = _STAGE_ROOT.get()
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{scope}/{name}" if scope else shared_root(spark, f"_stage/{name}")
    writer = df.write.mode("error").option("compression", "zstd")  # written once, read a few times: smaller than snappy
    if row_records > 1:
        few = {"parquet.block.row.count.limit": max(1, GROUP_RECORDS // row_records), "parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1}
        writer = writer.options(**few)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame without rows that the planner knows to be empty: no task, and no Python worker, runs for it."""
    return spark.range(1).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


# ---------------------------------------------------------------------------
# Filesystem helpers (Hadoop FileSystem, so any cluster filesystem works)
# ---------------------------------------------------------------------------


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    found = (re.fullmatch(r"manifest-(\d+)\.json", st.getPath().getName()) for st in fs.listStatus(p))
    return sorted(int(m[1]) for m in found if m)


def read_manifest(spark: SparkSession, path: str, number: int | None = None) -> dict[str, dict] | None:
    """The newest (or a given) manifest of a table folder: part -> {folder, rows}; None without one."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    return _read_json(spark, f"{path}/manifest-{numbers[-1] if number is None else number:06d}.json")


def _read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs_path(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _fs_path(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(json.dumps(value, sort_keys=True).encode())
    finally:
        stream.close()


def switch_manifest(spark: SparkSession, path: str, parts: dict[str, dict]) -> None:
    """Make ``parts`` the table: written aside, then renamed into place."""
    number = (_numbers(spark, path) or [0])[-1] + 1
    aside_path = f"{path}/.manifest-{uuid.uuid4().hex}"
    _write_json(spark, aside_path, parts)
    fs, aside = _fs_path(spark, aside_path)
    _, target = _fs_path(spark, f"{path}/manifest-{number:06d}.json")
    if not fs.rename(aside, target):
        raise ProcessingError(f"could not switch the manifest in {path}")


def drop_old_manifests(spark: SparkSession, path: str, keep: int = 2, held: set[int] | None = None) -> set[str]:
    """Remove manifests older than the newest ``keep`` that nobody holds; the folders that the others use."""
    used: set[str] = set()
    numbers = _numbers(spark, path)
    stay = {*numbers[-keep:], *(n for n in numbers if n in (held or ()))}
    for n in stay:
        used |= {part["folder"] for part in (read_manifest(spark, path, n) or {}).values() if "folder" in part}
    for n in numbers:
        if n in stay:
            continue
        fs, p = _fs_path(spark, f"{path}/manifest-{n:06d}.json")
        fs.delete(p, False)
    return used


# ---------------------------------------------------------------------------
# Writing
# ---------------------------------------------------------------------------


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH_COL, format_month("date"))


def write_parts(spark: SparkSession, folder: str, df: DataFrame, dataset: Dataset, finish: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, dict]:
    """Write ``df`` into a new folder and return its manifest parts. The landing
    order (``seq``) is stored with the rows where there is one; readers of the public columns never open it.
    Rows with ``ord`` instead get their ``seq`` from ``finish``, which must not move them: after they were gathered by month.

    Facts are gathered by month with a rebalance hint (AQE splits a large month and
    merges small ones; nothing is sampled, so the plan runs once) and sorted by
    facility and date inside it, so row groups can be skipped by either.
    """
    rows = df.select(*dataset.schema.names, *[c for c in (SEQ_COL, ORD_COL) if c in df.columns])
    if finish and not dataset.partition_by_month:
        rows = finish(rows)
    if not dataset.partition_by_month:
        rows.write.mode("error").option("compression", "snappy").parquet(folder)
        written = spark.read.schema(dataset.schema).parquet(folder)
        if not dataset.has_date:
            return {WHOLE: {"folder": folder, "rows": written.count()}}
        days = {str(r["date"]): r["count"] for r in written.groupBy("date").count().collect()}  # one row per date
        return {WHOLE: {"folder": folder, "rows": sum(days.values()), "days": days}}
    laid = with_month(rows).hint("rebalance", MONTH_COL)
    laid = (finish(laid) if finish else laid).sortWithinPartitions(MONTH_COL, *[F.col(k) for k in reversed(dataset.keys)])
    laid.write.mode("error").partitionBy(MONTH_COL).option("compression", "snappy").parquet(folder)
    schema = T.StructType([*dataset.schema.fields, T.StructField(MONTH_COL, T.StringType())])
    parts: dict[str, dict] = {}
    for r in spark.read.schema(schema).parquet(folder).groupBy(MONTH_COL, "date").count().collect():  # one row per date written
        part = parts.setdefault(r[MONTH_COL], {"folder": f"{folder}/{MONTH_COL}={r[MONTH_COL]}", "rows": 0, "days": {}})
        part["rows"] += r["count"]
        part["days"][str(r["date"])] = r["count"]
    return parts


# ---------------------------------------------------------------------------
# Reading
# ---------------------------------------------------------------------------


def read_parts(
    spark: SparkSession,
    parts: dict[str, dict],
    dataset: Dataset,
    date_from: _dt.date | None = None,
    date_to: _dt.date | None = None,
    months: list[str] | None = None,
    with_seq: bool = False,
) -> DataFrame:
    """Scan with the fixed schema (and the landing order, NULL for rows stored without). Date bounds (and an explicit month list)
    choose the folders from the manifest, so other months are never listed or
    opened. Callers still filter on ``date``."""
    names = sorted(parts)
    schema = T.StructType([*dataset.schema.fields, T.StructField(SEQ_COL, SEQ_SCHEMA)]) if with_seq else dataset.schema
    if dataset.partition_by_month:
        names = [m for m in names if date_from is None or m >= date_from.strftime("%Y-%m")]
        names = [m for m in names if date_to is None or m <= date_to.strftime("%Y-%m")]
        names = [m for m in names if months is None or m in set(months)]
    folders = [parts[m]["folder"] for m in names if parts[m]["rows"]]
    if not folders:
        return empty_frame(spark, schema)
    return spark.read.schema(schema).parquet(*folders)


def newest_date(parts: dict[str, dict]) -> _dt.date | None:
    """The newest date of a table, from its manifest."""
    days = [d for part in parts.values() for d, n in part["days"].items() if n and d != "None"]
    return _dt.date.fromisoformat(max(days)) if days else None


def rows_per_date(parts: dict[str, dict], date_from: _dt.date | None = None, date_to: _dt.date | None = None) -> dict[_dt.date, int] | None:
    """Rows of each date within the bounds, from a manifest; None where it does not know (rows without a date)."""
    if any("days" not in part or "None" in part["days"] for part in parts.values()):
        return None
    days = {_dt.date.fromisoformat(d): n for part in parts.values() for d, n in part["days"].items()}
    return {d: n for d, n in days.items() if (date_from is None or d >= date_from) and (date_to is None or d <= date_to)}


class Snapshot:
    """The published tables as some manifests list them: a catalog for the read service."""

    def __init__(self, spark: SparkSession, parts_of: Callable[[str], dict[str, dict] | None]):
        self.spark, self._parts_of = spark, parts_of

    def _parts(self, name: str) -> dict[str, dict]:
        ds = resolve(name)
        try:
            parts = self._parts_of(ds.storage)
        except READ_ERRORS as exc:  # a broken manifest
            raise ProcessingError(f"the snapshot of {ds.public} can't be read") from exc
        if parts is None:
            raise DataNotFoundError(f"no published data for {ds.public}")
        return parts

    def load(self, name: str, date_from=None, date_to=None) -> DataFrame:
        parts = self._parts(name)
        try:
            return read_parts(self.spark, parts, resolve(name), date_from, date_to)
        except READ_ERRORS as exc:  # a folder that is gone
            raise ProcessingError(f"the snapshot of {resolve(name).public} can't be read") from exc

    def rows_per_date(self, name: str, date_from=None, date_to=None) -> dict[_dt.date, int] | None:
        return rows_per_date(self._parts(name), date_from, date_to)

    def row_count(self, name: str) -> int:
        return sum(part["rows"] for part in self._parts(name).values())


class Warehouse:
    """Paths and read/write entry points for one warehouse root."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or shared_root(spark, "warehouse")).rstrip("/")

    # paths
    def base_dir(self, storage: str) -> str:
        return f"{self.root}/base/{storage}"

    def snapshot_dir(self, storage: str) -> str:
        return f"{self.root}/published/{storage}"

    def state_dir(self) -> str:
        return f"{self.root}/state"

    # logs: small tables that every refresh adds to, as a list of folders behind a manifest
    def log_parts(self, log: str) -> dict[str, dict]:
        return read_manifest(self.spark, f"{self.root}/{log}") or {}

    def load_log(self, log: str, schema: T.StructType) -> DataFrame:
        folders = [part["folder"] for _, part in sorted(self.log_parts(log).items())]
        return self.spark.read.schema(schema).parquet(*folders) if folders else empty_frame(self.spark, schema)

    def append_log(self, log: str, rows: DataFrame, schema: T.StructType, newest: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Add rows. From ``LOG_FOLDERS`` folders on they are written together as one, reduced
        by ``newest``, so any number of refreshes leaves a bounded number of files."""
        parts = self.log_parts(log)
        folder = f"{self.root}/data/{log}/{uuid.uuid4().hex}"
        rows.select(*schema.names).write.mode("error").parquet(folder)
        parts[f"{len(parts):06d}"] = {"folder": folder, "rows": -1}
        if len(parts) >= LOG_FOLDERS:
            whole = self.spark.read.schema(schema).parquet(*[p["folder"] for _, p in sorted(parts.items())])
            folder = f"{self.root}/data/{log}/{uuid.uuid4().hex}"
            (newest(whole) if newest else whole).select(*schema.names).hint("rebalance").write.mode("error").parquet(folder)
            parts = {f"{0:06d}": {"folder": folder, "rows": -1}}
        switch_manifest(self.spark, f"{self.root}/{log}", parts)

    def new_folder(self, storage: str) -> str:
        return f"{self.root}/data/{storage}/{uuid.uuid4().hex}"

    def base_parts(self, storage: str) -> dict[str, dict] | None:
        return read_manifest(self.spark, self.base_dir(storage))

    def snapshot_parts(self, storage: str) -> dict[str, dict] | None:
        return read_manifest(self.spark, self.snapshot_dir(storage))

    # S14
    def base_exists(self, storage: str) -> bool:
        return self.base_parts(storage) is not None

    def base_tables_exist(self) -> bool:
        """All three base tables must exist."""
        return all(self.base_exists(d.storage) for d in DATASETS.values())

    def snapshot_exists(self, storage: str) -> bool:
        return self.snapshot_parts(storage) is not None

    def has_any_snapshot_data(self) -> bool:
        return any(part["rows"] for d in DATASETS.values() for part in (self.snapshot_parts(d.storage) or {}).values())

    def drop_base_tables(self) -> None:
        """Forget every base table (what an ephemeral disk loses on restart)."""
        fs, p = _fs_path(self.spark, f"{self.root}/base")
        if fs.exists(p):
            fs.delete(p, True)

    # S8 / S7 / S6
    def load_base(self, name: str, months: list[str] | None = None, with_seq: bool = False) -> DataFrame:
        ds = resolve(name)
        parts = self.base_parts(ds.storage)
        if parts is None:
            raise DataNotFoundError(f"no base table {ds.storage}")
        return read_parts(self.spark, parts, ds, months=months, with_seq=with_seq)

    def load_snapshot(self, name: str, date_from=None, date_to=None) -> DataFrame:
        return self.current().load(name, date_from, date_to)

    # catalog protocol used by the read service: readers see published snapshots
    def current(self) -> Snapshot:
        return Snapshot(self.spark, self.snapshot_parts)

    def load(self, name: str, date_from=None, date_to=None) -> DataFrame:
        return self.load_snapshot(name, date_from, date_to)

    def rows_per_date(self, name: str, date_from=None, date_to=None) -> dict[_dt.date, int] | None:
        return self.current().rows_per_date(name, date_from, date_to)

    def row_count(self, name: str) -> int:
        return self.current().row_count(name)

    # Reads of one version
    def pin(self, hold: _dt.timedelta = _dt.timedelta(hours=1)) -> str:
        """A token for the tables as they are published now. Their files stay for ``hold``, whatever is published since."""
        numbers = {ds.storage: (_numbers(self.spark, self.snapshot_dir(ds.storage)) or [None])[-1] for ds in DATASETS.values()}
        token = uuid.uuid4().hex
        _write_json(self.spark, f"{self.root}/pins/{token}.json", {"until": (_dt.datetime.now(_dt.UTC) + hold).isoformat(), "manifests": numbers})
        return token

    def at(self, token: str) -> Snapshot:
        """The tables that ``pin`` has given the token for."""
        pin = _read_json(self.spark, f"{self.root}/pins/{token}.json") if path_exists(self.spark, f"{self.root}/pins/{token}.json") else None
        if pin is None:
            raise DataNotFoundError("the pinned version is unknown or no longer held")

        def parts_of(storage: str) -> dict[str, dict] | None:
            number = pin["manifests"].get(storage)
            return None if number is None else read_manifest(self.spark, self.snapshot_dir(storage), number)

        return Snapshot(self.spark, parts_of)

    def release(self, token: str) -> None:
        fs, p = _fs_path(self.spark, f"{self.root}/pins/{token}.json")
        fs.delete(p, False)

    def _pinned(self) -> dict[str, set[int]]:
        """The manifests per table that are held; pins that have run out are removed."""
        fs, p = _fs_path(self.spark, f"{self.root}/pins")
        held: dict[str, set[int]] = {}
        for st in fs.listStatus(p) if fs.exists(p) else []:
            path = st.getPath().toString()
            pin = _read_json(self.spark, path)
            if _dt.datetime.fromisoformat(pin["until"]) < _dt.datetime.now(_dt.UTC):
                fs.delete(st.getPath(), False)
                continue
            for storage, number in pin["manifests"].items():
                held.setdefault(storage, set()).add(number)
        return held

    # S9
    def overwrite_base(self, name: str, df: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Replace a base table (``finish``: see ``write_parts``); its number of rows."""
        ds = resolve(name)
        parts = write_parts(self.spark, self.new_folder(ds.storage), df, ds, finish)
        switch_manifest(self.spark, self.base_dir(ds.storage), parts)
        return sum(p["rows"] for p in parts.values())

    def replace_months(self, name: str, df: DataFrame, months: list[str]) -> None:
        """Replace the given months of a base table by the rows of ``df`` (all of them in these months)."""
        ds = resolve(name)
        old = self.base_parts(ds.storage) or {}
        new = write_parts(self.spark, self.new_folder(ds.storage), df, ds)
        switch_manifest(self.spark, self.base_dir(ds.storage), {**{m: p for m, p in old.items() if m not in months}, **new})

    # S10 / S11
    def publish(self, name: str) -> bool:
        """Point the published snapshot at the base table's files; an empty table is
        skipped (the older snapshot stays)."""
        ds = resolve(name)
        parts = self.base_parts(ds.storage)
        if parts is None:
            raise DataNotFoundError(f"no base table {ds.storage}")
        if not any(p["rows"] for p in parts.values()):
            return False
        switch_manifest(self.spark, self.snapshot_dir(ds.storage), parts)
        return True

    def save_snapshot(self, name: str, df: DataFrame) -> None:
        """Replace one dataset's snapshot by name (snappy parquet)."""
        ds = resolve(name)
        switch_manifest(self.spark, self.snapshot_dir(ds.storage), write_parts(self.spark, self.new_folder(ds.storage), df, ds))

    def restore(self, name: str) -> int:
        """The base table made of the published files; its number of rows."""
        ds = resolve(name)
        parts = self.snapshot_parts(ds.storage)
        if parts is None:
            raise DataNotFoundError(f"no published data for {ds.public}")
        switch_manifest(self.spark, self.base_dir(ds.storage), parts)
        return sum(p["rows"] for p in parts.values())

    def drop_unused(self, keep: int = 2) -> None:
        """Remove old manifests and the writes that no kept manifest uses."""
        held = self._pinned()
        for ds in DATASETS.values():
            used = drop_old_manifests(self.spark, self.base_dir(ds.storage), keep)
            used |= drop_old_manifests(self.spark, self.snapshot_dir(ds.storage), keep, held.get(ds.storage))
            self._drop_writes(f"{self.root}/data/{ds.storage}", used)
            for log in (f"progress/{ds.storage}", f"rejected/{ds.storage}"):
                self._drop_writes(f"{self.root}/data/{log}", drop_old_manifests(self.spark, f"{self.root}/{log}", keep))
        drop_old_manifests(self.spark, self.state_dir(), keep)

    def _drop_writes(self, path: str, used: set[str]) -> None:
        fs, p = _fs_path(self.spark, path)
        for st in fs.listStatus(p) if fs.exists(p) else []:
            write = st.getPath().getName()
            if not any(f"/{write}" in folder for folder in used):
                fs.delete(st.getPath(), True)
