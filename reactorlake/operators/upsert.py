"""Last-wins dedupe and upsert as DataFrame algebra.

``upsert`` is the pure relational form: target rows whose key is not in the
batch, plus the whole batch. ``merge_latest`` is what refreshes use: the landing order of
stored and new rows decides. The partition-wise write around it lives in
``reactorlake.sources.tables``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed merge keys per stored table (M2).
MERGE_KEYS = {
    "facility_outages": ("date", "facility_id"),
    "us_outages": ("date",),
    "plants": ("facility_id",),
}


def _order_key(df: DataFrame, keys: Sequence[str], seq: str) -> Column:
    if seq in df.columns:
        return F.struct(F.col(seq))  # rows without an order come first instead of being passed over
    # No landing order: fall back to a deterministic pick among the values.
    return F.struct(*[F.col(c) for c in df.columns if c not in keys])


def last_wins(df: DataFrame, keys: Sequence[str], seq: str = "seq", keep_seq: bool = False) -> DataFrame:
    """One row per key, the one with the greatest ``seq``.

    ``max_by`` is a plain aggregate: it combines map-side, so a key repeated in
    a third of all rows still shuffles one partial row per task, not the rows.
    """
    values = [c for c in df.columns if c not in keys and c != seq]
    order = _order_key(df, keys, seq)
    packed = F.struct(*[F.col(c) for c in values]) if values else F.lit(True)
    aggs = [F.max_by(packed, order).alias("_winner")]
    if keep_seq and seq in df.columns:
        aggs.append(F.max(seq).alias(seq))
    out = df.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys] + [F.col(f"_winner.{c}").alias(c) for c in values]
    if keep_seq and seq in df.columns:
        cols.append(F.col(seq))
    return out.select(*cols)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``last_wins`` for an integer ``order`` that is never NULL and values of fixed width: the row
    with the greatest ``order`` of each key, ``order`` kept. Every column is a ``max_by`` of its own, so the
    buffers have a fixed width and rows are combined by hash, without a sort on either side of the shuffle."""
    values = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in values], F.max(order).alias(order))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched keys take the batch row (all columns), new keys are
    inserted, untouched target rows stay. The batch must be one row per key
    (run ``last_wins`` first)."""
    batch = batch.select(*target.columns)
    kept = target.join(batch.select(*keys), list(keys), "left_anti")
    return kept.unionByName(batch)


def merge_latest(target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """M1 in landing order: of the stored and the batch rows of a key the one that
    landed last stays, whichever of them was read first. A batch that holds older records (a
    run read late, or again) changes only keys that have nothing newer. Both sides have ``seq``; a stored
    row without one is older than any other."""
    return last_wins(target.unionByName(batch.select(*target.columns)), keys, seq, keep_seq=True)


#: What a batch row does to its key, see ``change_kinds``.
INSERTED, CHANGED, RENEWED, SAME, OLDER = "inserted", "changed", "renewed", "same", "older"


def change_kinds(target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The change feed of a merge: the batch's rows with their ``kind``, compared null-safely.

    ``inserted``: a new key. ``changed``: other values. ``renewed``: the same values, landed later
    (only the stored order moves). ``same``: nothing new. ``older``: the stored row landed later and stays. Without ``seq``
    on both sides a batch row is never older, and equal values are the same. The batch
    must be one row per key.
    """
    values = [c for c in batch.columns if c not in keys and c != seq]
    ordered = seq in batch.columns and seq in target.columns
    old = target.select(*keys, F.struct(*[F.col(c) for c in values]).alias("_old"), *([F.struct(F.col(seq)).alias("_order")] if ordered else []))
    both = batch.join(old, list(keys), "left")
    equal = F.struct(*[F.col(c) for c in values]).eqNullSafe(F.col("_old"))
    order = F.struct(F.col(seq)) if ordered else None
    kind = F.when(F.col("_old").isNull(), INSERTED)
    if ordered:
        kind = kind.when(order < F.col("_order"), OLDER).when(equal & (order == F.col("_order")), SAME).when(equal, RENEWED)
    else:
        kind = kind.when(equal, SAME)
    return both.withColumn("kind", kind.otherwise(CHANGED)).drop("_old", "_order")


def dimension_from_batch(facility_batch: DataFrame, seq: str = "seq") -> DataFrame:
    """One name per facility id, the most recently landed one (with its order, if the batch has one)."""
    cols = ["facility_id", "facility_name"] + ([seq] if seq in facility_batch.columns else [])
    batch = facility_batch.select(*cols)
    if dict(batch.dtypes).get(seq) == "bigint":  # an order of fixed width: names are combined by hash first
        batch = batch.groupBy("facility_id", "facility_name").agg(F.max(seq).alias(seq))
    return last_wins(batch, ["facility_id"], seq, keep_seq=True)
