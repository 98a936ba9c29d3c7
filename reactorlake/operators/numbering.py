"""Number every row of a result in a total order without a global window.

A ``row_number()`` over an un-partitioned window moves the whole result into
one task. Instead: range-partition on the order keys (a hot leading key is
split because the keys are unique), sort inside partitions, store each row's
partition index and position once (a parquet stage in the shared checkpoint
folder), count rows per partition (one tiny row per
partition), turn the counts into start offsets, and add the position inside
the partition. Only the per-partition offsets (bounded by the partition count)
are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reactorlake.sources.tables import materialize

# monotonically_increasing_id(): partition index in the upper 31 bits, record
# number within the partition in the lower 33 bits.
_RECORD_BITS = 33


def number_rows(
    df: DataFrame,
    order: list[Column],
    index_col: str = "row_idx",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``index_col``: the 0-based position of each row in ``order``.

    ``order`` must be a total order (unique keys) for the numbering to be
    deterministic; the read path always appends the table key as tie-break.
    An empty ``order`` numbers the rows in their current partitions (any fixed
    order; used where only contiguous numbers matter, such as page slicing).
    """
    if order:
        # Without an explicit count the range exchange is sized by the session
        # (AQE's initial partition number and advisory partition size), so the
        # partition count grows with the data instead of being pinned here.
        ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
        ranged = ranged.sortWithinPartitions(*order)
    else:
        # No order requested: number rows where they are (no shuffle, no sort).
        ranged = df
    # Partition index and position are computed once, in the same job that
    # writes them to the shared folder: the stored values fix the numbering,
    # so the counting pass and the numbering pass agree even when a task or an
    # executor is lost and the upstream is recomputed.
    return number_tagged(tag_rows(ranged, "numbering"), index_col)


def tag_rows(df: DataFrame, label: str, row_records: int = 1) -> DataFrame:
    """Stage rows (``row_records``: see ``materialize``) with their partition's index and their position in it (``_part``, ``_pos``)."""
    pos = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), _RECORD_BITS)
    return materialize(df.withColumn("_part", F.spark_partition_id()).withColumn("_pos", pos), label, row_records)


def number_tagged(tagged: DataFrame, index_col: str) -> DataFrame:
    """Add ``index_col`` to tagged rows; of each partition they may be the first ones only."""
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias(
            "_start"
        ),
    )
    return (
        tagged.join(F.broadcast(starts), "_part")
        .withColumn(index_col, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )


def number_pages(df: DataFrame, order: list[Column], page_size: int) -> DataFrame:
    """``row_idx``, ``page_no = row_idx div page_size``, ``page_pos``."""
    numbered = number_rows(df, order)
    return numbered.withColumns(
        {
            "page_no": F.floor(F.col("row_idx") / F.lit(page_size)).cast("bigint"),
            "page_pos": F.pmod(F.col("row_idx"), F.lit(page_size)).cast("bigint"),
        }
    )
