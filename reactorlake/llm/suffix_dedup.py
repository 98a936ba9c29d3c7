"""Removal of repeated byte strings with a logarithmic family of suffix indexes.

A byte is removed when a string of ``MATCH`` bytes that covers it also starts in
a document with a smaller id. Documents are packed into batches of about
``BATCH_BYTES``. Every batch gets a sparse suffix array: of each window of MATCH
bytes the suffix with the smallest hash of its first ``ANCHOR`` bytes is kept,
so equal windows keep equal suffixes; suffixes are ordered by that hash, which finds equal
prefixes as well as byte order does. Suffix arrays are split by ranges of the
order; in a range the batches' runs enter a family of levels (``Levels``), where levels of
like size merge, and each batch is scanned against all levels by binary search:

1. scan of the suffixes: those met in one batch and one document only can't be
   in a repeated string and are dropped (over nine tenths of a clean corpus);
2. scan of every window around the others: the smallest document id of each
   window's content. Windows of a range meet by 64-bit hash; a byte is removed only
   if the bytes are equal too, and windows whose hashes clash are compared by bytes alone.

Batches are written once and read again for each pass; between passes travel
sorted keys, bits, the contexts of shared suffixes and masks, never all windows.
Within a batch, equal contexts of several documents are settled at once and
travel once, so a passage that a third of all documents share costs one row a batch.
Of equal texts only the smallest id takes part; the others are removed whole.

Defined cases: null text is empty; texts shorter than MATCH bytes are kept. Null ids
count as larger than any other; rows of equal id never remove each other. Repeats
within one document alone are kept. A long text is a batch of its own and is
scanned in pieces. Empty input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import ship, stage, table, text_of
from reactorlake.llm.runs import (
    ANSWERS,
    KEY_BITS,
    NO_ID,
    RUNS,
    Levels,
    answers,
    batches_of,
    copies_of,
    count_up,
    key_runs,
    layout,
    marked,
    pack,
    ranges_of,
    scan_runs,
    unpack,
    with_copies,
)

MATCH = 50
ANCHOR = 24
BATCH_BYTES = 8 << 20
#: Input bytes whose suffixes one range of the order holds on average.
RANGE_BYTES = 16 << 20
#: Window starts that are hashed at once.
PIECE = 1 << 20

_rng = np.random.default_rng(50)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of all strings of the given sizes, by doubling."""
    powers, size = {1: _BYTE[data]}, 1
    while 2 * size <= max(sizes) and len(powers[size]) > size:
        p = powers[size]
        powers[2 * size] = p[:-size] * _power(size) + p[size:]
        size *= 2
    out = []
    for want in sizes:
        total = len(data) - want + 1
        if total <= 0:
            out.append(np.empty(0, np.uint64))
            continue
        h, done = np.zeros(total, np.uint64), 0
        for bit in sorted(powers, reverse=True):
            if want & bit:
                h = h * _power(bit) + powers[bit][done : done + total]
                done += bit
        out.append(h)
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int = MATCH) -> np.ndarray:
    """Whether the strings of ``size`` (8 or more) bytes at places ``a`` and ``b`` are equal."""
    equal = np.ones(len(a), bool)
    if len(a):
        eights = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), strides=(1,))
        for at in (*range(0, size - 7, 8), size - 8):
            equal &= eights[a + at] == eights[b + at]
    return equal


def suffixes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> dict[str, np.ndarray]:
    """The kept suffixes of a batch: key, doc (number in the batch), lo and n (the
    windows lo .. lo + n - 1 keep it), and the hashes of its first and last window."""
    found: dict[str, list] = {k: [] for k in ("key", "doc", "lo", "n", "first", "last")}
    width = MATCH - ANCHOR + 1
    for at in range(0, max(len(data) - MATCH + 1, 0), PIECE):
        part = data[at : at + PIECE + MATCH - 1]
        short, whole = rolling(part, (ANCHOR, MATCH))
        mixed = (short ^ (short >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        least = (mixed & _U(0xFFFFFFFF00000000)) | np.arange(len(short), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        window = np.arange(len(least))
        doc = np.searchsorted(stops, window + at, side="right")
        valid = (window + at >= starts[doc]) & (window + at + MATCH <= stops[doc])
        window, doc = window[valid], doc[valid]
        if not len(window):
            continue
        anchor = (least[valid] & _U(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(begin, len(anchor)))
        key = short[anchor[begin]]
        key = (key ^ (key >> _U(29))) * _U(0x94D049BB133111EB)
        values = (key >> _U(64 - KEY_BITS), doc[begin], window[begin] + at, n, whole[window[begin]], whole[window[begin] + n - 1])
        for k, v in zip(found, values, strict=True):
            found[k].append(v)
    empty = {"key": np.uint64, "first": np.uint64, "last": np.uint64}
    return {k: np.concatenate(v) if v else np.empty(0, empty.get(k, np.int64)) for k, v in found.items()}


def _contexts(ranges: int) -> Callable:
    """Pass 2, a batch and its bits to (span, batch, lo, n, id, context): windows around shared suffixes."""

    def run(left: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            data, starts, stops, ids = layout(row)
            s = suffixes(data, starts, stops)
            keys, inverse = np.unique(s["key"], return_inverse=True)
            shared = answers(notes)
            copy = marked(notes, len(ids))
            active = ~copy[s["doc"]]
            low, high = np.full(len(keys), NO_ID), np.full(len(keys), -1)
            np.minimum.at(low, inverse[active], s["doc"][active])
            np.maximum.at(high, inverse[active], s["doc"][active])
            pick = np.flatnonzero(active & ((shared[inverse] > 0) | (low != high)[inverse]))
            if not len(pick):
                continue
            s = {k: v[pick] for k, v in s.items()}
            doc_id = ids[s["doc"]]
            order = np.lexsort((s["n"], s["last"], s["first"]))
            same = np.concatenate([[True], np.any([s[k][order][1:] != s[k][order][:-1] for k in ("first", "last", "n")], axis=0)])
            order = order[np.lexsort((doc_id[order], np.cumsum(same)))]
            best = order[np.flatnonzero(same)[np.cumsum(same) - 1]]
            settled = np.zeros(len(pick), bool)
            maybe = doc_id[order] > doc_id[best]
            own, other, more = s["lo"][order[maybe]], s["lo"][best[maybe]], s["n"][order[maybe]] - 1
            settled[order[maybe]] = same_bytes(data, own, other) & same_bytes(data, own + more, other + more)
            order = np.argsort(s["key"], kind="stable")
            for r, a, b in ranges_of(s["key"][order], ranges):
                part = order[a:b]
                sent = part[~settled[part]]
                spots = np.repeat(s["lo"][sent], s["n"][sent] + MATCH - 1) + count_up(s["n"][sent] + MATCH - 1)
                done = part[settled[part]]
                out.append((r, row.batch, pack(s["lo"][sent]), pack(s["n"][sent].astype(np.uint8)), pack(doc_id[sent]), zstandard.compress(data[spots].tobytes(), 3), pack(s["lo"][done]), pack(s["n"][done].astype(np.uint8))))
        return pd.DataFrame(out, columns=["span", "batch", "lo", "n", "id", "context", "done_lo", "done_n"])

    return run


def _masks(group: pd.DataFrame) -> pd.DataFrame:
    """One range: for each context the windows whose content starts in a smaller id."""
    opened, raws, contexts, size = [], [], [], 0
    for row in group.itertuples():
        lo, n, ids = unpack(row.lo, np.int64), unpack(row.n, np.uint8).astype(np.int64), unpack(row.id, np.int64)
        raw = np.frombuffer(zstandard.decompress(row.context), np.uint8) if len(lo) else np.empty(0, np.uint8)
        sizes, step = n + MATCH - 1, count_up(n)
        begin = np.cumsum(sizes) - sizes
        windows = rolling(raw, (MATCH,))[0][np.repeat(begin, n) + step] if len(lo) else np.empty(0, np.uint64)
        opened.append((row.batch, windows, np.repeat(ids, n), np.repeat(begin + size, n) + step, np.repeat(lo, n) + step, unpack(row.done_lo, np.int64), unpack(row.done_n, np.uint8).astype(np.int64)))
        raws.append(raw)
        contexts.append((ids, begin + size, n))
        size += len(raw)
    data = np.concatenate(raws)
    ids, begin, n = (np.concatenate(c) for c in zip(*contexts, strict=True))
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(by_id), np.int64)
    rank[by_id] = np.arange(len(by_id))
    ids, begin = ids[by_id], begin[by_id]
    # a window's value: the rank of its context by id, then its place there (under 256); the least is a window of the smallest id
    levels, first = Levels(np.minimum), 0
    for (_, windows, *_), (own, _, m) in zip(opened, contexts, strict=True):
        levels.add(windows, np.repeat(rank[first : first + len(own)] * 256, m) + count_up(m))
        first += len(own)
    found, clashes = [], []
    for _, windows, own, at, *_ in opened:
        best = levels.scan(windows, NO_ID)
        gone = ids[best >> 8] < own if len(own) else np.empty(0, bool)
        best, at = best[gone], at[gone]
        other = begin[best >> 8] + (best & 255)
        # neighbouring windows that meet neighbours form runs of under MATCH windows: the first and the last cover all bytes
        start = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(other) != 1)])) if len(at) else np.empty(0, np.int64)
        stop = np.append(start[1:], len(at)) - 1 if len(at) else start
        equal = same_bytes(data, at[start], other[start]) & same_bytes(data, at[stop], other[stop])
        clashes.append(np.unique(windows[gone][np.repeat(~equal, stop - start + 1)]))
        found.append(gone)
    clashing = np.unique(np.concatenate(clashes))
    if len(clashing):
        _settle_clashes(data, clashing, opened, found)
    out = []
    for (batch, _, _, _, starts, done_lo, done_n), gone in zip(opened, found, strict=True):
        removed = np.concatenate([starts[gone], np.repeat(done_lo, done_n) + count_up(done_n)])
        if len(removed):
            removed.sort()
            out.append((batch, pack(np.diff(removed, prepend=0))))
    return pd.DataFrame(out, columns=["batch", "removed"])


def _settle_clashes(data: np.ndarray, clashing: np.ndarray, opened: list[tuple], found: list[np.ndarray]) -> None:
    """Decide the windows of clashing hashes anew, by their bytes."""
    least: dict[bytes, int] = {}
    hits = [np.flatnonzero(np.isin(windows, clashing)) for _, windows, *_ in opened]
    for (_, _, own, at, *_), hit in zip(opened, hits, strict=True):
        for a, i in zip(at[hit].tolist(), own[hit].tolist(), strict=True):
            content = data[a : a + MATCH].tobytes()
            least[content] = min(least.get(content, i), i)
    for (_, _, own, at, *_), hit, gone in zip(opened, hits, found, strict=True):
        gone[hit] = [least[data[a : a + MATCH].tobytes()] < i for a, i in zip(at[hit].tolist(), own[hit].tolist(), strict=True)]


def _cut(left: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """The last pass, a batch and its removed windows to one row per document."""
    out = []
    for row in left.itertuples():
        data, starts, stops, ids = layout(row)
        depth = np.zeros(len(data) + 1, np.int32)
        for r in notes["removed"]:
            if r is not None:
                lo = np.cumsum(unpack(r, np.int64))
                np.add.at(depth, lo, 1)
                np.add.at(depth, lo + MATCH, -1)
        gone = np.cumsum(depth[:-1]) > 0
        copy = marked(notes, len(ids))
        for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            if copy[i] and b - a >= MATCH:
                gone[a:b] = True
            own = gone[a:b]
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            known = row.ids[i] is not None and row.ids[i] == row.ids[i]
            out.append((int(row.ids[i]) if known else None, b - a, int(own.sum()), spans, hashlib.sha256(data[a:b][~own].tobytes()).hexdigest(), data[a:b][~own].tobytes()))
    return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"id": "Int64"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, on
    request, kept (the remaining bytes)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    batches = stage(batches_of(rows, BATCH_BYTES), "suffix-batches", "none")
    total = batches.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, math.ceil(total / RANGE_BYTES))
    copies = copies_of(batches)
    bare = batches.select("batch", "ids", "lengths", "data", "size")
    runs = bare.mapInArrow(key_runs(lambda row: suffixes(*layout(row)[:3])["key"], ranges), RUNS)
    # a suffix matters when another batch has it, or another document of its own batch (known there)
    shared = stage(runs.groupBy("span").applyInPandas(scan_runs(lambda held: held > 1, False), ANSWERS), "suffix-shared")
    notes = with_copies(shared, copies)
    contexts = bare.groupBy("batch").cogroup(notes.groupBy("batch")).applyInPandas(_contexts(ranges), "span int, batch long, lo binary, n binary, id binary, context binary, done_lo binary, done_n binary")
    masks = stage(contexts.groupBy("span").applyInPandas(_masks, "batch long, removed binary"), "suffix-masks")
    notes = with_copies(masks, copies)

    def last(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = _cut(left, right)
        return out if with_text else out.drop(columns="kept")

    kept = bare.groupBy("batch").cogroup(notes.groupBy("batch")).applyInPandas(last, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
    return kept.withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
