"""Alignment of two tokenizers' tokens, by merge-path partitioning.

Tokenizer A (byte-level BPE) encodes a blank and the text, tokenizer B (pieces with byte fallback) the text,
to which it adds the blank itself; both spell the same bytes. Byte offsets where tokens of both end
cut them into groups, and the two tokens that end there are linked.

The sorted ends of all A tokens and all B tokens of a slice of documents are one merge. It is divided into pieces of
``PIECE`` ends each: on every diagonal (places in A and B that sum to a multiple of ``PIECE``) a
binary search finds where the merge crosses it, so every piece has equal work however the tokens lie and
however long a document is. A piece emits the ends that both sides share, looking one B end
past its own for a pair that the diagonal parts; groups that cross pieces are
stitched from the shared ends before and after.

How often an id pair is linked is counted over the corpus: per document, per batch and per task
first, then by pair. Documents look their links up in the most frequent pairs, at most
``FREQUENT_PAIRS`` (a bound on what is broadcast); the links to rarer pairs, of which none is
frequent, are joined with their counts.

Defined cases: null and empty texts, and texts that a tokenizer does not spell exactly (characters that
it normalises), have no tokens: zeros, an empty digest and no groups. Special
tokens' strings inside texts are ordinary text. Rows that repeat an id, or have none, count each. Empty
input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import map_arrow, slices, stage, table, text_of

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE = 1 << 14
FREQUENT_PAIRS = 1 << 21
#: Pairs that a task holds before it passes their counts on.
HELD_PAIRS = 1 << 20
SLICE_BYTES = 2 << 20
BLANK = "▁"

_LOADED: dict[tuple[str, str], Spellings] = {}
_COUNTS: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 bytes stand for
    themselves, the others, in order, for the letters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Spellings:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, names = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        spelled: list[bytes] = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            spelled[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_a = pa.array(spelled, pa.large_binary())
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if byte else p.replace(BLANK, " ").encode() for p, byte in pieces], pa.large_binary())
        self.size_a, self.size_b = (pc.binary_length(x).to_numpy() for x in (self.bytes_a, self.bytes_b))
        a, b = len(spelled), len(pieces)
        marks = [f"{i},".encode() for i in range(a)], [f"{i}|".encode() for i in range(a)], [f"{i},".encode() for i in range(b)], [f"{i};".encode() for i in range(b)]
        self.written = pa.array(list(itertools.chain(*marks)), pa.large_binary())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, their number per text, B ids, their number per text); a text that is not spelled exactly has none."""
        blank = [" " + t for t in texts]
        of_a = [e.ids for e in self.a.encode_batch_fast(blank, add_special_tokens=False)]
        of_b = self.b.encode(texts, out_type=int, num_threads=1)
        good = np.array([len(t) > 0 for t in texts], bool)
        ids, counts = [], []
        for found, spelled in ((of_a, self.bytes_a), (of_b, self.bytes_b)):
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.int64, int(counts[-1].sum())))
            whole = spelled.take(pa.array(ids[-1]))
            ends = whole.cast(pa.large_binary()).buffers()[1]
            ends = np.frombuffer(ends, np.int64, len(whole) + 1)[np.concatenate([[0], np.cumsum(counts[-1])])]
            data = memoryview(whole.buffers()[2]).cast("B") if len(whole) else memoryview(b"")
            good &= np.array([data[x:y] == t.encode() for x, y, t in zip(ends[:-1].tolist(), ends[1:].tolist(), blank, strict=True)], bool)
        kept = [i[np.repeat(good, n)] for i, n in zip(ids, counts, strict=True)]
        return kept[0], np.where(good, counts[0], 0), kept[1], np.where(good, counts[1], 0)


def spellings(path_a: str, path_b: str) -> Spellings:
    if (path_a, path_b) not in _LOADED:
        _LOADED[(path_a, path_b)] = Spellings(path_a, path_b)
    return _LOADED[(path_a, path_b)]


def diagonals(x: np.ndarray, y: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of sorted ``x`` and ``y`` (x first among equals) crosses every
    ``piece``-th diagonal: the number of elements of x and of y before it."""
    total = len(x) + len(y)
    across = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(across - len(y), 0), np.minimum(across, len(x))
    while (low < high).any():
        middle = (low + high) // 2
        # one more of x belongs before the diagonal if it isn't after the last of y there
        more = (low < high) & (x[np.minimum(middle, len(x) - 1)] <= y[np.clip(across - middle - 1, 0, len(y) - 1)])
        low, high = np.where(more, middle + 1, low), np.where(more | (low >= high), high, middle)
    return low, across - low


def shared_ends(x: np.ndarray, y: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``x`` and ``y`` (each strictly ascending) of the values in both, piece by piece of the merge path."""
    if not len(x) or not len(y):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = diagonals(x, y, piece)
    in_x, in_y = [], []
    for a, b, c, d in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), (j[1:] + 1).tolist(), strict=True):
        mine, theirs = x[a:b], y[c:d]  # an x that is the piece's last may have its equal y right behind the diagonal
        if len(mine) and len(theirs):
            at = np.searchsorted(theirs, mine)
            hit = np.flatnonzero(theirs[np.minimum(at, len(theirs) - 1)] == mine)
            in_x.append(a + hit)
            in_y.append(c + at[hit])
    return np.concatenate([np.empty(0, np.int64), *in_x]), np.concatenate([np.empty(0, np.int64), *in_y])


class Aligned:
    """The tokens of some texts, their groups and links."""

    def __init__(self, both: Spellings, texts: list[str], piece: int = PIECE) -> None:
        self.both = both
        self.a, self.n_a, self.b, self.n_b = both.encode(texts)
        # both sides spell a text with the same bytes, so ends counted over all texts still meet
        self.end_a, self.end_b = np.cumsum(both.size_a[self.a]), np.cumsum(both.size_b[self.b])
        self.link_a, self.link_b = shared_ends(self.end_a, self.end_b, piece)
        self.text_of = np.searchsorted(np.cumsum(self.n_a), self.link_a, side="right")
        self.links = np.bincount(self.text_of, minlength=len(texts))

    def digests(self) -> list[str]:
        """SHA-256 of the written groups of each text, empty without tokens."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.link_a] = last_b[self.link_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before = np.concatenate([[0], self.link_b + 1])  # B tokens before each group
        order = np.empty(len(self.a) + len(self.b), np.int64)
        n = len(self.both.bytes_a)
        order[np.arange(len(self.a)) + before[group_a]] = self.a + last_a * n
        order[np.arange(len(self.b)) + (self.link_a + 1)[group_b]] = self.b + 2 * n + last_b * len(self.both.bytes_b)
        written = self.both.written.take(pa.array(order))
        at = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1)[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        data = memoryview(written.buffers()[2]).cast("B") if len(written) else memoryview(b"")
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(links' distinct id pairs text by text, how often each is linked there, how many each text has)."""
        pair, code = np.unique(self.a[self.link_a] << 32 | self.b[self.link_b], return_inverse=True)
        own, times = np.unique(self.text_of * max(len(pair), 1) + code, return_counts=True)
        return pair[own % max(len(pair), 1)] if len(pair) else pair, times, np.bincount(own // max(len(pair), 1), minlength=len(self.links))

    def groups(self) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """(text, end in bytes within a blank and the text, A ids, B ids) of every group."""
        a, b, begin, current = 0, 0, 0, -1
        for t, i, j in zip(self.text_of.tolist(), self.link_a.tolist(), self.link_b.tolist(), strict=True):
            if t != current:
                current, begin = t, int(self.end_a[a - 1]) if a else 0
            yield t, int(self.end_a[i]) - begin, self.a[a : i + 1].tolist(), self.b[b : j + 1].tolist()
            a, b = i + 1, j + 1


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"), F.col(id_col).alias("id"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of tokens: id, group (from 0, per document), end (bytes of a blank and the text before it), a_ids, b_ids."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            found = list(Aligned(spellings(path_a, path_b), batch.column(1).to_pylist()).groups())
            text = np.array([t for t, *_ in found], np.int64)
            number = np.arange(len(text)) - np.searchsorted(text, text)
            lists = [pa.array([g[k] for g in found], pa.list_(pa.int32())) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(text)), pa.array(number), pa.array([e for _, e, *_ in found], pa.int64()), *lists], [id_col, "group", "end", "a_ids", "b_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(rows, run, f"`{id_col}` {kind}, group long, end long, a_ids array<int>, b_ids array<int>")


def linked_rows(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row (its own number), id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs with how often each is linked."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            found = Aligned(spellings(path_a, path_b), batch.column(1).to_pylist())
            pairs, times, counts = found.pairs()
            numbers = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.links, found.links)]
            lists = [_lists(counts, pairs, pa.int64()), _lists(counts, times, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *numbers, pa.array(found.digests(), pa.string()), *lists], names)

    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(rows, run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (no pair of its B id has more) of every linked id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new, times = (pc.list_flatten(batch.column(i)).to_numpy().astype(np.int64) for i in (0, 1))
            pairs, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, place, np.concatenate([counts, times]))
            counts = total
            if len(pairs) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    counted = map_arrow(rows.select("pairs", "times"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = stage(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), "align-pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))  # at most one row per B id
    return stage(counted.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-counts")


def _frequent(counts: DataFrame, most: int) -> int:
    """The power of two from which on at most ``most`` pairs are linked so often."""
    classes = {r.size: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("pairs")).collect()}
    held, least = 0, max(classes, default=-1) + 1
    while least > 0 and held + classes.get(least - 1, 0) <= most:
        least -= 1
        held += classes.get(least, 0)
    return least


def link_counts(rows: DataFrame, counts: DataFrame, most: int = FREQUENT_PAIRS) -> DataFrame:
    """``rows`` with n_best and count_sum instead of their pairs."""
    least = _frequent(counts, most)
    size = F.floor(F.log2("n")).cast("int")
    known = counts.filter(size >= least).sort("pair").toPandas()  # at most ``most`` rows
    name, shared = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)))
    plain = [f for f in rows.schema.names if f not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[name] = shared.value
        keys, n, best = _COUNTS[name]
        for batch in batches:
            lists, width = batch.column(batch.num_columns - 2), batch.num_columns - 2
            of, pairs = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
            times = pc.list_flatten(batch.column(batch.num_columns - 1)).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at = at[hit]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], of[hit], times[hit] * best[at])
            np.add.at(sums[1], of[hit], times[hit] * n[at])
            rest = [_lists(np.bincount(of[~hit], minlength=batch.num_rows), x[~hit], k) for x, k in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *map(pa.array, sums), *rest], [*plain, "n_best", "count_sum", "pairs", "times"])

    kinds = ", ".join(f"`{f}` {rows.schema[f].dataType.simpleString()}" for f in plain)
    told = map_arrow(rows.select(*plain, "pairs", "times"), run, f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<int>")
    if least <= 0:  # no pair is left out
        return told.drop("pairs", "times")
    told = stage(told, "align-told")
    each = told.filter("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    found = each.join(counts.filter(size < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("m_best"), F.sum(F.col("times") * F.col("n")).alias("m_sum"))
    both = told.drop("pairs", "times").join(found, "row", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("m_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("m_sum", F.lit(0))).drop("m_best", "m_sum")


def report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = stage(linked_rows(docs, path_a, path_b, id_col, text_col), "align-rows")
    out = link_counts(rows, pair_counts(rows), most)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))
