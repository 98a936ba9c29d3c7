"""N-gram Jaccard self-join with token-combination prefixes.

Tokens are hashes of a text's distinct word shingles. Exact document counts of
all tokens put them into classes: unique, then powers of two; a set is
ordered by class, ties by hash, so its rarest tokens come first. For sets that share at least t of
their union, with n the size of one:

* at most d = floor(n * (1 - t) / t) tokens differ in all;
* if the first shared token is rare (fewer than ``FREQUENT`` documents) it stands among the first
  ``n - ceil(t * n) + 1`` tokens of both: rare tokens there are indexed alone, unique
  ones not at all;
* otherwise all shared tokens are frequent, the first ``d + 2`` of them stand among
  the first ``2 * d + 2`` tokens of both (the extended prefix), and as at most d foreign
  tokens can stand in their d + 1 gaps, two of them are neighbours in both:
  pairs of neighbouring frequent tokens of the extended prefix are indexed.

So every linked pair shares a key, and is then verified on whole sets (``linking``).
Documents are packed into batches once; each batch's sorted tokens are counted
against all others in ranges (``runs``), and the classes go back to the batch.

Defined cases: null and empty texts have no shingles, n_shingles 0, and their
own id as component. Fewer words than the width are one shingle. Rows that
repeat an id are one document with several texts. Null ids have the component of their equal texts, or
null. Empty input gives an empty result. Extra columns are ignored (``representatives``
keeps them).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import release, scope, ship, stage, table, text_of
from reactorlake.llm.linking import WIDE, digest, link_classes, postings, set_classes, sketch
from reactorlake.llm.runs import ANSWERS, KEY_BITS, RUNS, answers, batches_of, copies_of, key_runs, layout, marked, scan_runs, with_copies
from reactorlake.llm.shingles import scramble, shingle_sets

WIDTH = 3
PERCENT = 90
#: Documents from which on a token counts as frequent, a power of two.
FREQUENT = 32
BATCH_BYTES = 4 << 20
RANGE_BYTES = 16 << 20


def token_class(counts: np.ndarray) -> np.ndarray:
    """0: one document, 1: two and three, 2: four to seven, and so on."""
    return np.floor(np.log2(np.maximum(counts, 1)))


def words_of(text: bytes) -> bytes:
    """Texts of equal words have equal sets."""
    return b" ".join(text.lower().split())


def _token_keys(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint64(64 - KEY_BITS)


def _sets(row, width: int) -> list[np.ndarray]:
    data, starts, stops, _ = layout(row)
    offsets = np.append(starts, stops[-1:]).astype(np.int32)
    return shingle_sets(pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), width)


def index_keys(grams: np.ndarray, classes: np.ndarray, percent: int, frequent: int) -> tuple[np.ndarray, int, np.ndarray, int]:
    """The keys of one set: rare shared tokens with the position of the first, pairs of frequent ones likewise.
    A set with more unique tokens than any partner may miss has no keys."""
    n = len(grams)
    lost = n * (100 - percent) // percent
    if np.count_nonzero(classes == 0) > lost:
        return grams[:0], 0, grams[:0], 0
    if lost == 0:  # only equal sets can be linked: the set itself is the key
        return scramble(grams.sum(keepdims=True) + np.uint64(n)) if n else grams, 0, grams[:0], 0
    order = np.lexsort((grams, classes))[: 2 * lost + 2]
    g, c = grams[order], classes[order]
    first, rare = int(np.searchsorted(c, 1)), int(np.searchsorted(c, frequent.bit_length() - 1))
    prefix = n - (-(-n * percent // 100)) + 1
    often = g[rare:]
    return g[first : min(rare, prefix)], first, scramble(often[:-1] * np.uint64(0x9E3779B97F4A7C15) + scramble(often[1:] + np.uint64(1))), rare


def indexed_sets(base: DataFrame, width: int, percent: int, frequent: int) -> DataFrame:
    """One row per document of ``base`` (id, text): id, n, sig (the set's digest), the keys
    (``index_keys``; none for copies) and, where there are keys, u (its unique tokens), its sketches and the set itself (grams)."""
    ship(base.sparkSession)
    batches = stage(batches_of(base, BATCH_BYTES, words_of), "ngram-batches", "none")
    ranges = max(1, math.ceil((batches.agg(F.sum("size")).first()[0] or 0) / RANGE_BYTES))
    bare = batches.select("batch", "ids", "lengths", "data", "size")

    def tokens(row) -> np.ndarray:
        sets = _sets(row, width)
        return _token_keys(np.concatenate(sets)) if sets else np.empty(0, np.uint64)

    counted = bare.mapInArrow(key_runs(tokens, ranges), RUNS).groupBy("span").applyInPandas(scan_runs(token_class, True), ANSWERS)
    notes = with_copies(stage(counted, "ngram-classes"), copies_of(batches))

    def index(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            sets = _sets(row, width)
            keys = np.unique(_token_keys(np.concatenate(sets))) if sets else np.empty(0, np.uint64)
            classes, copy = answers(right), marked(right, len(sets))
            for i, s in enumerate(sets):
                of = classes[np.searchsorted(keys, _token_keys(s))]
                singles, first, pairs, ahead = index_keys(s if not copy[i] else s[:0], of if not copy[i] else of[:0], percent, frequent)
                live = len(singles) + len(pairs) > 0
                known = row.ids[i] is not None and row.ids[i] == row.ids[i]
                about = (sketch(s), sketch(s, len(WIDE)), s.view(np.int64)) if live else (None, None, None)
                out.append((int(row.ids[i]) if known else None, len(s), int(np.count_nonzero(of == 0)), digest(s), singles.view(np.int64), first, pairs.view(np.int64), ahead, *about))
        release()
        return pd.DataFrame(out, columns=["id", "n", "u", "sig", "singles", "first", "pairs", "ahead", "sketch", "wide", "grams"]).astype({"id": "Int64"})

    schema = "id long, n int, u int, sig string, singles array<long>, first int, pairs array<long>, ahead int, sketch array<long>, wide array<long>, grams array<long>"
    return stage(bare.groupBy("batch").cogroup(notes.groupBy("batch")).applyInPandas(index, schema), "ngram-sets")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id. Ids must be integers."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    with scope(docs.sparkSession):
        rows = indexed_sets(base, width, percent, frequent)
        sets = stage(set_classes(rows), "ngram-reps")
        indexed = rows.filter("grams IS NOT NULL AND id IS NOT NULL")
        about = indexed.select("id", "sig", "n", "u", "wide").join(sets.filter("id = rep").select("id", "sig"), ["id", "sig"], "left_semi")
        grams = indexed.select("id", "grams")
        found = link_classes(postings(rows, sets), about, lambda ids: grams.join(ids, "id", "left_semi"), percent)
        out = sets.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        out = out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
        return stage(out, "ngram-links", keep=True)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest id of their component, all columns
    kept; documents with null ids stay."""
    groups = link(docs, id_col, text_col, width, percent)
    gone = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
