"""Helpers shared by the training-data operators: table reads, stages, running totals, batch slicing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import math
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: ASCII white space and its complement; words in every contract.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that
    they need no copy of it on their own path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and
    what one stage has freed else still counts while the next one runs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without that setting (tests) gets a folder of its own;
    elsewhere a missing setting is an error, since executors don't share disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _LOCAL_ROOTS.setdefault(app, tempfile.mkdtemp(prefix="llm-"))


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/llm/{label}-{uuid.uuid4().hex}"


_SCOPE: contextvars.ContextVar[str | None] = contextvars.ContextVar("llm_stage_scope", default=None)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Stages written inside the block are deleted when it ends, but for those written with ``keep``."""
    root = fresh_folder(spark, "scope")
    token = _SCOPE.set(root)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps and
    lost executors read files instead of recomputing the plan."""
    root = _SCOPE.get()
    path = f"{root}/{label}-{uuid.uuid4().hex}" if root and not keep else fresh_folder(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bucket_count(rows: int) -> int:
    """Buckets for ``with_running``: both the rows of a bucket and the table of bucket
    totals grow with the square root of the rows, so neither becomes the bottleneck."""
    return max(1, math.ceil(rows / max(2000, math.isqrt(rows))))


def with_running(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Exclusive running totals (``values``: output name -> summed value) inside
    ``group`` in the order (``bucket``, ``order``), without a window over a whole group.

    Totals per (group, bucket) are summed first; only that small table goes
    through a window per group, its offsets are joined back, and rows are summed
    inside their bucket. ``bucket`` must ascend with ``order`` and be sized by
    the caller so that one bucket holds a bounded number of rows. Group and
    bucket columns must not be null.
    """
    keys = [*group, bucket]
    work = df.select("*", *[v.alias(f"__v_{k}") for k, v in values.items()])
    totals = work.groupBy(*keys).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values])
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in values])
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = work.join(offsets, keys).withColumns({k: F.col(f"__o_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in values})
    return out.drop(*[f"__{p}_{k}" for k in values for p in "vo"])


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each slice stays near ``max_bytes``
    (one longer text is a slice of its own): memory is bounded by bytes, not rows."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
