"""Periodic runs of words, by an online sparse diagonal recurrence.

A run with period q is a stretch of a text's words where every word equals the
one q before it, at least four periods (and six words) long, as long as possible and with no smaller
period. Position i and an earlier occurrence i - q of the same word lie on diagonal
q; the match length of a diagonal grows with every word that has such an occurrence
and ends with the first that has none:

    length(i, q) = length(i - 1, q) + 1 if word(i) = word(i - q), else the diagonal ends

Kept for every word and lag that would be quadratic in frequent words. A run matches on at
least 3 q words, so lags of 2**k to 2**(k + 1) - 1 are followed over blocks of 2**k words (named by
doubling: equal names are equal blocks of one text) and at every 2**k-th place only:

    length(i, q) = length(i - 2**k, q) + 2**k if block(i) = block(i - q), else it ends

Places with a block that occurs once in its text feed no diagonal. At most 2**k lags are
active at each of n / 2**k places, so a text of n words costs O(n) per k, also where it repeats one
word only. Where a diagonal ends its last partial block is compared by halving, and a long enough one is
emitted. A stretch with a smaller period is emitted for that period too,
with the same ends, and the smallest one is kept.

Work is per document inside Arrow batches, many documents at once; nothing is shuffled.

Defined cases: null and empty texts have no words and no runs, their collapsed text is
empty. Rows that repeat an id, or have none, are judged each by their own text. Empty
input gives an empty result. ``collapse`` keeps all other columns; ``detect`` ignores them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import map_arrow, slices, table
from reactorlake.llm.runs import count_up

#: A run has at least so many periods and so many words.
PERIODS, WORDS = 4, 6

Edit = Callable[[list, np.ndarray], tuple[np.ndarray, np.ndarray]]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (ASCII white space apart) of all texts, and each text's first word's position (with the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    keep = pc.not_equal(pc.binary_length(lists.values), 0)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return lists.values.filter(keep), before[lists.offsets.to_numpy()]


def _names(keys: np.ndarray, where: np.ndarray, total: int) -> np.ndarray:
    """Equal non-negative names for equal keys at ``where``; a negative name of its own for every other place."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    out = -1 - np.arange(total)
    many = count[name] > 1
    out[where[many]] = name[many]
    return out


def _diagonals(block: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, end, lag) of the stretches whose blocks match at one lag of size .. 2 * size - 1, in whole blocks."""
    total = len(block)
    live = np.flatnonzero(block >= 0)
    held = np.sort(block[live] * total + live)
    place = live[live % size == 0]
    base = block[place] * total
    low = np.searchsorted(held, base + np.maximum(place - 2 * size + 1, 0))
    high = np.where(place >= size, np.searchsorted(held, base + np.maximum(place - size, 0), side="right"), low)
    found = np.maximum(high - low, 0)
    at = np.repeat(place, found)
    lag = at - held[np.repeat(low, found) + count_up(found)] % total
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    # the recurrence: a match goes on where the same lag matched one block earlier
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + size)]))
    last = np.append(begin[1:], len(at))[: len(begin)] - 1
    long = last > begin  # a run's match holds two whole blocks at least
    return at[begin[long]], at[last[long]] + size, lag[begin[long]]


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period. ``codes`` are word
    numbers of all texts, ``bounds`` the texts' ends in them (from 0)."""
    total, sizes = len(codes), np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    size_of = sizes[text]
    places = np.flatnonzero(size_of >= WORDS)
    names = [_names(text[places] * (int(codes.max(initial=0)) + 1) + codes[places], places, total)]
    found, size = [], 1
    while (names[-1] >= 0).any():
        block = names[-1]
        start, end, lag = _diagonals(block, size)
        for level in reversed(range(len(names) - 1)):
            step, part = 1 << level, names[level]
            right = (end + step <= total) & (part[np.minimum(end, total - 1)] == part[end - lag])
            end = end + step * right
            left = (start - step - lag >= 0) & (part[start - step] == part[np.maximum(start - step - lag, 0)])
            start = start - step * left
        length = end - start + lag
        good = length >= np.maximum(WORDS, PERIODS * lag)
        found.append(np.stack([start[good] - lag[good], end[good], lag[good]]))
        both = np.flatnonzero((block[: total - size] >= 0) & (block[size:] >= 0) & (size_of[: total - size] >= 2 * size * PERIODS))
        names.append(_names(block[both] * total + block[both + size], both, total))
        size *= 2
    start, end, period = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    own = np.concatenate([np.ones(min(1, len(start)), bool), (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    start, end, period = start[own], end[own], period[own]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The (start, length, period) of greatest length / period, compared exactly; the first of equal ones."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _judge(ids: list | None, texts: pa.Array, edit: Edit | None) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, pa.Array]:
    """Runs (start, length, period) of each text, its number of words, and its collapsed text."""
    words, bounds = words_of(texts)
    sizes = np.diff(bounds)
    if edit is not None:
        first, period = edit(ids, sizes)
        at, first, period = count_up(sizes), np.repeat(first, sizes), np.repeat(period, sizes)
        own = np.where(at >= first, first + (at - first) % period, at)
        words = words.take(pa.array(np.repeat(bounds[:-1], sizes) + own))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    start, end, period = runs_of(codes, bounds)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    keep = np.cumsum(drop)[:-1] <= 0
    left = np.concatenate([[0], np.cumsum(keep)])[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep))), " ")
    runs: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    of = np.searchsorted(bounds, start, side="right") - 1  # the last text that begins there is the one with words
    for t, s, e, p in zip(of.tolist(), (start - bounds[of]).tolist(), (end - bounds[of]).tolist(), period.tolist(), strict=True):
        runs[t].append((s, e - s, p))
    return runs, sizes, collapsed


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; in words, by start, then period),
    best (the run of greatest length / period, ties by start, then period; else null) and collapsed: the
    words that no run repeats, joined by one space.

    ``edit`` gives for ids and numbers of words the place and the period from which on words are repeated first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in slices(batches):
            runs, sizes, collapsed = _judge(batch.column(0).to_pylist() if edit else None, batch.column(1), edit)
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
            best = [None if (b := greatest(rs)) is None else dict(zip(("start", "length", "period"), b, strict=True)) for rs in runs]
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(named, pa.list_(triple)), pa.array(best, triple), collapsed]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_words", "runs", "best", "collapsed"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind, one = docs.schema[id_col].dataType.simpleString(), "struct<start:bigint,length:bigint,period:bigint>"
    return map_arrow(rows, run, f"`{id_col}` {kind}, n_words long, runs array<{one}>, best {one}, collapsed string")


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their texts collapsed where they have a run; other texts and columns as they are."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=place):
            runs, _, collapsed = _judge(None, batch.column(place), None)
            text = pc.if_else(pa.array([len(r) > 0 for r in runs], pa.bool_()), collapsed, batch.column(place))
            yield batch.set_column(place, batch.schema.field(place), text)

    return map_arrow(docs, run, docs.schema)


def planted(ids: list, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contract's edit: a tenth of the ids repeat their words from a place on."""
    hashes = np.array([1 if i is None else zlib.crc32(str(i).encode()) for i in ids], np.int64)
    marked, g, n = (hashes % 10 == 0) & (sizes > 0), hashes // 10, np.maximum(sizes, 1)
    first = np.where(marked, g % n, sizes)
    return first, np.where(marked, 1 + (n - first) // (3 + g % 8), 1)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"), edit=planted)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
