"""Document fingerprints by MinHash.

``PERMUTATIONS`` universal hash permutations x -> a*x + b (mod 2^32, a odd) run
over the 32-bit hashes of a text's five-word shingles in vectorised numpy; the
minima, folded to 16 bits, are the signature, written as hex. Likeness of two
fingerprints is the share of equal positions.

``near_duplicates`` joins signature bands in Spark, verifies the candidates'
exact Jaccard similarity of shingle sets and returns classes
(``linking.link_classes``); equal sets are one class beforehand.

``edited_fingerprints`` needs the next document by descending id. Ids are cut
into ranges at their approximate quantiles (rows without an id by their text's hash), so ranges balance
by rows however the ids lie. Each range is sorted and streamed, and its last document gets the first one of
the next range as a copied tail row; texts are shuffled once.

Defined cases: null text is empty; a text without words has no shingles, the
fingerprint of ``f`` digits only, and is 1.0 like another such text. Shorter texts
than five words are one shingle. Null ids come last; equal and null ids are ordered by their text's hash, then text. The
next document of the only row is itself. Empty input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import map_arrow, scope, slices, stage, table, text_of
from reactorlake.llm.shingles import shingle_sets

WIDTH = 5
PERMUTATIONS = 128
BAND = 4
PERCENT = 80
#: Accuracy of the quantiles, in ranges: a range is at most about a tenth of its share too large.
ACCURACY = 10

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The folded minima of all permutations over one set of shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        rows = _A[:, None] * x[None, at : at + 1024]
        rows += _B[:, None]
        np.minimum(best, rows.min(axis=1), out=best)
    return (best ^ (best >> np.uint32(16))).astype(np.uint16) if len(x) else np.full(PERMUTATIONS, 0xFFFF, np.uint16)


def signatures(texts: list[str]) -> list[np.ndarray]:
    return [signature(s) for s in shingle_sets(pa.array(texts, pa.string()), WIDTH)]


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint, bands (array of band keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sigs = [signature(s) for s in shingle_sets(batch.column(1), WIDTH)]
            bands = [[f"{i}:{s[i : i + BAND].astype('>u2').tobytes().hex()}" for i in range(0, PERMUTATIONS, BAND)] for s in sigs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hex(s) for s in sigs], pa.string()), pa.array(bands, pa.list_(pa.string()))], ["id", "fingerprint", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), run, f"id {kind}, fingerprint string, bands array<string>")


def _in_ranges(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """``rows`` (id, text) with their hash, an ascending order key (o_null, o_id, hash) and ``part``: ``parts`` ranges of
    ids with like numbers of rows, then ranges of hashes for rows without an id; and how many parts there may be."""
    from pyspark.ml.feature import Bucketizer

    cuts = [i / parts for i in range(1, parts)] or [0.5]
    total, nulls, marks = rows.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.approx_percentile("id", cuts, ACCURACY * (parts + 1))).first()
    bounds = sorted({float(x) for x in marks or []}) or [0.0]
    free = math.ceil(nulls * parts / total) if nulls else 0
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "o_null": F.col("id").isNull(), "o_id": F.bitwise_not("id"), "__at": F.coalesce(F.col("id").cast("double"), F.lit(0.0))})
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__at", outputCol="__bucket").transform(keyed)
    spread = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * max(free, 1))
    part = F.when(F.col("o_null"), len(bounds) + 1 + F.least(spread, F.lit(max(free - 1, 0)))).otherwise(len(bounds) - F.col("__bucket"))
    return cut.withColumn("part", part.cast("int")).drop("__at", "__bucket"), len(bounds) + 1 + free


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, see the module text: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows, parts = _in_ranges(rows, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    order = ["o_null", "o_id", "hash"]
    firsts = rows.groupBy("part").agg(F.min(F.struct(*order)).alias("o")).sort("part").collect()  # at most one row per part
    of = {r.part: r.o for r in firsts}
    before = {r.part: firsts[i - 1].part for i, r in enumerate(firsts)}

    def by_part(values: list[int | None]) -> Column:  # one folded literal, whatever the number of parts
        return F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), F.col("part"))

    first = {c: by_part([of[p][c] if p in of else None for p in range(parts)]) for c in ("o_id", "hash")}
    opens = F.col("o_id").eqNullSafe(first["o_id"]) & (F.col("hash") == first["hash"])
    here = F.struct("part", F.lit(False).alias("tail"))
    there = F.struct(by_part([before.get(p, 0) for p in range(parts)]).cast("int").alias("part"), F.lit(True).alias("tail"))
    rows = rows.withColumn("spot", F.explode(F.when(opens, F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("spot.part", "spot.tail", "id", "text", *order)
    ordered = rows.repartition(max(len(firsts), 1), "part").sortWithinPartitions("part", "tail", *order, "text").drop(*order)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, id, text, signature of the row that waits for its next document
        for batch in slices(batches, column=3):
            part, tail, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            sigs = signatures(texts)
            done, edits = [], []
            for p, t, d, text, sig in zip(part, tail, ids, texts, sigs, strict=True):
                if last is not None and last[0] == p:
                    half = len(last[2]) // 2
                    done.append((*last[1:], float(np.mean(last[3] == sig))))
                    edits.append(last[2][: len(last[2]) - half] + text[:half])
                last = None if t else (p, d, text, sig)
            new = signatures(edits)
            cols = [
                pa.array([d for d, *_ in done], pa.int64()),
                pa.array([len(t) for _, t, *_ in done], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                pa.array([_hex(s) for _, _, s, _ in done], pa.string()),
                pa.array([_hex(s) for s in new], pa.string()),
                pa.array([float(np.mean(d[2] == s)) for d, s in zip(done, new, strict=True)], pa.float64()),
                pa.array([x for *_, x in done], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(ordered, run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class).

    Candidates share a band of ``BAND`` of the ``PERMUTATIONS`` minima (at 0.8 a
    pair is missed with a chance under 1e-7); each is verified exactly.
    """
    from reactorlake.llm import linking

    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    with scope(docs.sparkSession):
        rows = linking.set_rows(base, WIDTH)
        sets = stage(linking.set_classes(rows), "minhash-classes")
        reps = sets.filter("id = rep")
        marks = fingerprints(base.join(reps.select("id"), "id", "left_semi"), "id", "text")
        bits = [F.lit(0).cast("long").alias(c) for c in linking.SKETCH]
        keys = marks.select(F.explode("bands").alias("key"), "id", F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit(0).alias("u"), F.lit(linking.PLAIN).alias("kind"), *bits)
        about = rows.select("id", "sig", "n", F.lit(0).alias("u"), "wide").join(reps.select("id", "sig"), ["id", "sig"], "left_semi")
        found = linking.link_classes(stage(keys, "minhash-bands"), about, lambda ids: linking.sets_of(ids, base, WIDTH), percent)
        out = sets.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        return stage(out.select(F.col("id").alias(id_col), F.coalesce("component", "rep", "id").alias("class_id")), "minhash-links", keep=True)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
