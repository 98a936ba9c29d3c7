"""Repeated lines, found by sharded minimal perfect hash tables that documents probe.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys
of at least ``MIN_CHARS`` code points that stand in at least ``MIN_DOCS`` documents lose their lines
everywhere but in the document of largest id that holds them.

1. Documents give the 128-bit hashes of their distinct keys, combined per slice and per
   task before the shuffle (so a line of every third document is a few rows a task).
2. The distinct hashes that repeat often enough are dealt to shards. Each shard gets a minimal perfect
   hash: levels of bits, a key has the bit of the first level where it hashes alone, and its rank among
   the bits is its slot in three arrays: fingerprint (64 bits of the hash), documents and last id.
3. Documents probe the arrays; lines are never joined. An index of at most
   ``BROADCAST_BYTES`` goes to every worker. A larger one stays in shards: hashes and ids travel to the
   shard's arrays, in groups of about ``PROBES`` (a shard that holds frequent lines is
   copied for several groups), and only hits travel back to their documents.

A line that isn't indexed passes for an indexed one only if it reaches a slot with its own 64-bit fingerprint
(2**-64 a probe).

Defined cases: null and empty texts are one empty line. Null ids count as the smallest id, so their lines go
first; if all documents with a key lack an id, they all keep it. Rows that repeat an id count as
documents each and are all the holder of their id. Empty input gives an empty result.
``strip`` keeps all other columns; ``report`` ignores them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import map_arrow, ship, slices, stage, table
from reactorlake.llm.shingles import scramble

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 17
BROADCAST_BYTES = 64 << 20
PROBES = 4 << 20
#: Bits of a level for each key that enters it.
GAMMA = 1.7
LEVELS = 64
NO_ID = np.iinfo(np.int64).min
SPACES = " \t\n\v\f\r"
_U = np.uint64
INDEX = "shard long, keys long, bytes long, load long, levels array<int>, bits binary, prints binary, documents binary, last binary"

_LOADED: dict[str, Shards] = {}


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (scramble(h1 ^ scramble(h2 + _U(level) * _U(0x9E3779B97F4A7C15))) % _U(size)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the levels' bits, one after the other, of distinct keys (h1, h2)."""
    left, sizes, bits = np.arange(len(h1)), [], []
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys that are not distinct have no perfect hash")
        size = max(64, math.ceil(GAMMA * len(left)))
        slot = _slot(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        left = left[~alone[slot]]
        sizes.append(size)
        bits.append(alone)
    return sizes, np.concatenate(bits) if bits else np.empty(0, bool)


def places(h1: np.ndarray, h2: np.ndarray, sizes: list[int], bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The slot of each key in a perfect hash (``rank``: set bits before each bit); strangers have none (-1) or anyone's."""
    out, open_, begin = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = begin + _slot(h1[open_], h2[open_], level, size)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, begin = open_[~hit], begin + size
    return out


class Shard:
    """One shard's arrays."""

    def __init__(self, row) -> None:
        self.sizes = [int(x) for x in row.levels]
        self.bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), count=sum(self.sizes)).view(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1
        self.prints, self.documents, self.last = np.frombuffer(row.prints, _U), np.frombuffer(row.documents, np.int64), np.frombuffer(row.last, np.int64)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that aren't indexed."""
        out = places(h1, h2, self.sizes, self.bits, self.rank)
        known = out >= 0
        out[known] = np.where(self.prints[out[known]] == h2[known], out[known], -1)
        return out


class Shards:
    """All shards of a small index."""

    def __init__(self, rows: list[Row], count: int) -> None:
        self.count, self.shards = count, {r.shard: Shard(r) for r in rows}

    def last(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexed, the last id) of each key."""
        known, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        of = (h1 % _U(self.count)).astype(np.int64)
        for number, shard in self.shards.items():
            here = np.flatnonzero(of == number)
            slot = shard.probe(h1[here], h2[here])
            here, slot = here[slot >= 0], slot[slot >= 0]
            known[here], last[here] = True, shard.last[slot]
        return known, last


def _build(group: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = group["h1"].to_numpy().view(_U), group["h2"].to_numpy().view(_U)
    sizes, bits = perfect_hash(h1, h2)
    place = np.argsort(places(h1, h2, sizes, bits, np.cumsum(bits) - 1))
    packed = np.packbits(bits).tobytes()
    n, last = group["n"].to_numpy().astype(np.int64), group["last"].to_numpy().astype(np.int64)
    arrays = [h2[place].tobytes(), n[place].tobytes(), last[place].tobytes()]
    size = len(packed) + sum(map(len, arrays))
    return pd.DataFrame([(int(group["shard"].iloc[0]), len(h1), size, int(n.sum()), sizes, packed, *arrays)], columns=[c.split()[0] for c in INDEX.split(", ")])


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines, and each text's first line's position (with the end)."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    return lists.values, lists.offsets.to_numpy().astype(np.int64)


def _keyed(lines: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions of the lines with long enough keys, the number of each one's key, and the keys' hashes)."""
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACES))
    long = pc.greater_equal(pc.utf8_length(keys), least)
    coded = keys.filter(long).dictionary_encode()
    raw = b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in pc.cast(coded.dictionary, pa.binary()).to_pylist())
    pairs = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return np.flatnonzero(long.to_numpy(zero_copy_only=False)), coded.indices.to_numpy().astype(np.int64), pairs[:, 0].copy(), pairs[:, 1].copy()


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _holders(lines: pa.Array, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document) of every key that a document holds, and the keys' hashes."""
    at, key, h1, h2 = _keyed(lines, least)
    document = np.searchsorted(bounds, at, side="right") - 1
    pairs = np.unique(key * max(len(bounds), 1) + document)
    return pairs // max(len(bounds), 1), pairs % max(len(bounds), 1), h1, h2


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def line_counts(base: DataFrame, least: int) -> DataFrame:
    """h1, h2, n (documents) and last (largest id) of every distinct key of ``base`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, document, h1, h2 = _holders(*_lines(batch.column(1)), least)
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n, last = np.diff(np.append(begin, len(key))), np.maximum.reduceat(_ids(batch.column(0))[document], begin)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1.view(np.int64), h2.view(np.int64), n, last)], ["h1", "h2", "n", "last"])

    return map_arrow(base, run, "h1 long, h2 long, n long, last long").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _shard(h1: str, count: int):
    """``h1`` as an unsigned number, modulo the number of shards."""
    two_to_64 = (1 << 64) % count
    return F.pmod(F.pmod(F.col(h1), F.lit(count)) + F.when(F.col(h1) < 0, F.lit(two_to_64)).otherwise(F.lit(0)), F.lit(count)).cast("long")


def line_index(base: DataFrame, least: int = MIN_CHARS, documents: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """The index shards (``INDEX``) of the keys in at least ``documents`` documents, and how many shards there are."""
    ship(base.sparkSession)
    kept = stage(line_counts(base, least).filter(F.col("n") >= documents), "line-keys")
    count = max(1, math.ceil(kept.count() / SHARD_KEYS))
    built = kept.withColumn("shard", _shard("h1", count)).groupBy("shard").applyInPandas(_build, INDEX)
    return stage(built, "line-index"), count


def _small(index: DataFrame, count: int, limit: int) -> Broadcast | None:
    """The index for every worker, if its arrays have at most ``limit`` bytes."""
    if (index.agg(F.sum("bytes")).first()[0] or 0) > limit:
        return None
    return index.sparkSession.sparkContext.broadcast((index.collect(), count))


def _far_hits(base: DataFrame, index: DataFrame, count: int, least: int) -> DataFrame:
    """id and gone (structs h1, h2): the keys that each id's documents lose, by probes in the shards."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, document, h1, h2 = _holders(*_lines(batch.column(1)), least)
            columns = (h1[key].view(np.int64), h2[key].view(np.int64), _ids(batch.column(0))[document])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h1", "h2", "id"])

    sent = stage(map_arrow(base, probes, "h1 long, h2 long, id long").withColumn("shard", _shard("h1", count)), "line-probes")
    usual = math.ceil(sent.count() / count)
    groups = index.select("shard", F.ceil((F.col("load") + usual) / PROBES).cast("int").alias("groups"))
    sent = sent.join(groups, "shard").withColumn("part", F.pmod(F.xxhash64("id", "h2"), F.col("groups")).cast("int"))
    copies = index.join(groups, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    def hits(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "h1": [], "h2": []}).astype("int64")
        shard = Shard(next(right.itertuples()))
        slot = shard.probe(left["h1"].to_numpy().view(_U), left["h2"].to_numpy().view(_U))
        lost = (slot >= 0) & (shard.last[np.maximum(slot, 0)] != left["id"].to_numpy())
        return left.loc[lost, ["id", "h1", "h2"]]

    met = sent.drop("groups").groupBy("shard", "part").cogroup(copies.drop("groups").groupBy("shard", "part")).applyInPandas(hits, "id long, h1 long, h2 long")
    return met.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def _near(shared: Broadcast, least: int) -> Callable:
    """Which lines of a slice go, by probes of the worker's own copy of the index."""
    name = uuid.uuid4().hex

    def run(lines: pa.Array, bounds: np.ndarray, ids: np.ndarray, _: pa.Array | None) -> np.ndarray:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Shards(*shared.value)
        at, key, h1, h2 = _keyed(lines, least)
        known, last = _LOADED[name].last(h1, h2)
        lost = np.zeros(len(lines), bool)
        lost[at] = known[key] & (last[key] != np.repeat(ids, np.diff(bounds))[at])
        return lost

    return run


def _told(least: int) -> Callable:
    """Which lines of a slice go, by the keys that came back to its documents."""

    def run(lines: pa.Array, bounds: np.ndarray, ids: np.ndarray, gone: pa.Array) -> np.ndarray:
        at, key, h1, h2 = _keyed(lines, least)
        numbers = {pair: i for i, pair in enumerate(zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), strict=True))}
        document, flat = pc.list_parent_indices(gone).to_numpy(), pc.list_flatten(gone)
        pairs = zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True)
        dead = np.array([d * len(numbers) + numbers[p] for d, p in zip(document.tolist(), pairs, strict=True) if p in numbers], np.int64)
        lost = np.zeros(len(lines), bool)
        lost[at] = np.isin((np.searchsorted(bounds, at, side="right") - 1) * len(numbers) + key, dead)
        return lost

    return run


def _cut(docs: DataFrame, id_col: str, text_col: str, least: int, documents: int, limit: int, make: Callable, schema) -> DataFrame:
    """``make(batch, kept texts, lines, dropped lines)`` over the documents; ``batch`` has their columns."""
    base = _base(docs, id_col, text_col)
    index, count = line_index(base, least, documents)
    shared = _small(index, count, limit)
    width = len(docs.columns)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    if shared is None:
        lost_of = _told(least)
        gone = _far_hits(base, index, count, least).select(F.col("id").alias("__gone_id"), F.col("gone").alias("__gone"))
        docs = docs.join(gone, F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))) == F.col("__gone_id"), "left").drop("__gone_id")
    else:
        lost_of = _near(shared, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text_at):
            lines, bounds = _lines(pc.cast(batch.column(text_at), pa.string()))
            gone = batch.column(width) if batch.num_columns > width else None
            lost = lost_of(lines, bounds, _ids(pc.cast(batch.column(id_at), pa.int64())), gone)
            left = np.concatenate([[0], np.cumsum(~lost)])[bounds]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), lines.filter(pa.array(~lost))), "\n")
            own = pa.RecordBatch.from_arrays(batch.columns[:width], schema=pa.schema([batch.schema.field(i) for i in range(width)]))
            yield make(own, kept, np.diff(bounds), np.diff(bounds) - np.diff(left))

    return map_arrow(docs, run, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS, documents: int = MIN_DOCS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept (the text that stays)."""

    def make(batch: pa.RecordBatch, kept: pa.Array, lines: np.ndarray, dropped: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), kept], [id_col, "n_lines", "n_dropped", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _cut(docs.select(id_col, text_col), id_col, text_col, least, documents, limit, make, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept string")


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS, documents: int = MIN_DOCS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without the lines that they lose; a text that loses none stays as it is (null, too)."""
    at = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch, kept: pa.Array, lines: np.ndarray, dropped: np.ndarray) -> pa.RecordBatch:
        return batch.set_column(at, batch.schema.field(at), pc.if_else(pa.array(dropped > 0), kept, batch.column(at)))

    return _cut(docs, id_col, text_col, least, documents, limit, make, docs.schema)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), many AS (
  SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT k, doc_id FROM keyed WHERE length(k) >= {MIN_CHARS}) GROUP BY k HAVING count(*) >= {MIN_DOCS}
), marked AS (
  SELECT doc_id, line, i, coalesce(last <> doc_id, false) AS lost FROM keyed LEFT JOIN many USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
