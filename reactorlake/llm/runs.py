"""Batches of documents, sorted runs of hashed keys, and levels of merged runs.

Used where every key of a corpus must be compared with all others: a batch's
keys travel as sorted, compressed runs split by ranges of the key, the runs of a range are
merged in levels, and answers go back to the batch in the order of its keys.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reactorlake.llm.common import map_arrow, slices, stage
from reactorlake.llm.linking import with_best

KEY_BITS = 48
NO_ID = np.iinfo(np.int64).max
_U = np.uint64


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes, ordered by significance."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Levels:
    """Sorted runs of distinct keys with a value each. A new run enters as the
    smallest level; as long as the level above it is not over twice as large, the two merge, so there are
    logarithmically many and every key is merged logarithmically often."""

    def __init__(self, combine: np.ufunc) -> None:
        self.combine, self.runs = combine, []

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        run = self._distinct(keys, values)
        while self.runs and len(self.runs[-1][0]) <= 2 * len(run[0]):
            last = self.runs.pop()
            run = self._distinct(np.concatenate([last[0], run[0]]), np.concatenate([last[1], run[1]]))
        self.runs.append(run)

    def _distinct(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return keys, values
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[begin], self.combine.reduceat(values, begin)

    def scan(self, keys: np.ndarray, start: int) -> np.ndarray:
        """The combined value of each key over all levels."""
        out = np.full(len(keys), start, np.int64)
        for held, values in self.runs:
            if len(held):
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[at] == keys
                out[hit] = self.combine(out[hit], values[at[hit]])
        return out


def batches_of(docs: DataFrame, batch_bytes: int, same: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """Documents (id, text) packed into rows of about ``batch_bytes``: batch, ids,
    lengths, digests (of what ``same`` makes of a text), data (compressed), size. A longer text is a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            cols = [[uuid.uuid4().int >> 65], [ids], [[len(t) for t in texts]], [[hashlib.blake2b(same(t), digest_size=16).digest() for t in texts]], [zstandard.compress(b"".join(texts), 3)], [size]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["batch", "ids", "lengths", "digests", "data", "size"])

        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist(), strict=True):
                if texts and size + len(t) > batch_bytes:
                    yield row()
                    ids, texts, size = [], [], 0
                ids.append(i), texts.append(t)
                size += len(t)
        if texts:
            yield row()

    return map_arrow(docs, run, "batch long, ids array<long>, lengths array<long>, digests array<binary>, data binary, size long")


def layout(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, stops, ids) of a batch row; null ids as the largest."""
    data = np.frombuffer(zstandard.decompress(row.data, max_output_size=max(int(row.size), 1)), np.uint8) if row.size else np.empty(0, np.uint8)
    stops = np.cumsum(np.asarray(row.lengths, np.int64))
    ids = np.array([NO_ID if i is None or i != i else i for i in row.ids], np.int64)
    return data, stops - np.asarray(row.lengths, np.int64), stops, ids


def ranges_of(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of sorted keys."""
    of = ((keys >> _U(16)) * _U(ranges) >> _U(KEY_BITS - 16)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
    yield from zip(of[begin].tolist() if len(of) else [], begin, [*begin[1:], len(of)], strict=True)


def count_up(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, in one array."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def marked(notes: pd.DataFrame, n: int) -> np.ndarray:
    copy = np.zeros(n, bool)
    for c in notes["copies"]:
        if c is not None:
            copy[np.asarray(c, np.int64)] = True
    return copy


def copies_of(batches: DataFrame) -> DataFrame:
    """batch, copies: the places of documents whose digest has a smaller id elsewhere."""
    listed = batches.select("batch", F.posexplode(F.arrays_zip("ids", "digests")).alias("i", "d")).select("batch", "i", "d.ids", "d.digests")
    best = with_best(listed, "digests", "ids", "least", F.min)
    last = F.lit(int(NO_ID))
    copies = best.filter(F.coalesce(F.col("ids"), last) > F.coalesce(F.col("least"), last)).groupBy("batch").agg(F.collect_list("i").alias("copies"))
    return stage(copies, "batch-copies")


def key_runs(keys_of: Callable, ranges: int) -> Callable:
    """Batches to (batch, span, keys, counts): the sorted distinct keys of a batch, by range, with how often ``keys_of`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("span", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                keys, counts = np.unique(keys_of(row), return_counts=True)
                out = [(row.batch, r, pack(np.diff(keys[a:b], prepend=_U(0))), pack(counts[a:b].astype(np.int32))) for r, a, b in ranges_of(keys, ranges)]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=schema.names), preserve_index=False, schema=schema)

    return run


def scan_runs(answer: Callable[[np.ndarray], np.ndarray], counted: bool) -> Callable:
    """A range's runs to (batch, span, answer, n): ``answer`` of every key's total over
    all batches (of its counts, or of the batches that hold it), in the order of the run."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        levels = Levels(np.add)
        runs = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in group["keys"]]
        for keys, counts in zip(runs, group["counts"], strict=True):
            levels.add(keys, unpack(counts, np.int32).astype(np.int64) if counted else np.ones(len(keys), np.int64))
        out = [zstandard.compress(answer(levels.scan(keys, 0)).astype(np.uint8).tobytes(), 1) for keys in runs]
        return pd.DataFrame({"batch": group["batch"], "span": group["span"], "answer": out, "n": [len(k) for k in runs]})

    return run


def answers(notes: pd.DataFrame) -> np.ndarray:
    """A batch's answers in the order of its sorted distinct keys."""
    rows = notes[notes["answer"].notna()].sort_values("span")
    return np.frombuffer(b"".join(zstandard.decompress(a) for a in rows["answer"]), np.uint8)


ANSWERS = "batch long, span int, answer binary, n long"
RUNS = "batch long, span int, keys binary, counts binary"


def with_copies(answered: DataFrame, copies: DataFrame) -> DataFrame:
    """The notes of each batch: rows of answers and of copies."""
    return answered.unionByName(copies, allowMissingColumns=True)
