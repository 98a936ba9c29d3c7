"""Sequence packing by power-of-two decomposition.

A document of n ids (its tokens and one closing id) is cut into n // 2048
pieces of 2048 ids and one piece per set bit of the rest, longest first. Every
piece is a sequence of its own in the bucket of its length, so no sequence
crosses documents and none is padded. Sequences are numbered bucket by bucket,
longest first, in (document, start) order, with totals carried over bounded
blocks (``common.with_running``).

Tokenising runs on Arrow batches: texts are split at ASCII white space, which
the tokenizer's own splitting never joins, each distinct piece of a slice is
encoded once, and ids are gathered with numpy.

Defined cases: null and empty texts are the closing id alone, one piece of
length 1. Rows repeating a document id are packed each; null ids too. Empty input gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import bucket_count, map_arrow, release, slices, stage, table, with_running

MAX_LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct words whose ids a Python worker keeps.
CACHE_WORDS = 1_000_000

_LOADED: dict[str, Vocabulary] = {}


class Vocabulary:
    """The ids of the words a Python worker has met: words as one Arrow array, ids in one numpy array."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def places(self, words: pa.Array) -> np.ndarray:
        """Each distinct word's place; new words are encoded and added."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        place = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(place)
        new = words.filter(missing)
        if len(new):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
            first = len(self.words)
            self.words = pa.concat_arrays([self.words, new])
            out = pc.fill_null(place, 0).to_numpy().astype(np.int64)
            out[missing.to_numpy(zero_copy_only=False)] = first + np.arange(len(new))
            return out
        return place.to_numpy().astype(np.int64)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in one array, and each text's number of ids."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    vocabulary = _LOADED[path]
    words = pc.ascii_split_whitespace(texts)
    coded = words.values.dictionary_encode()
    # the tokenizer lower-cases; doing so first finds more known words, but may not make special tokens of ordinary text
    names = pc.if_else(pc.match_substring(coded.dictionary, "<|"), coded.dictionary, pc.ascii_lower(coded.dictionary)).dictionary_encode()
    place = vocabulary.places(names.dictionary)[names.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
    index = place[coded.indices.to_numpy()]
    per_word = vocabulary.sizes[index]
    ends = np.cumsum(per_word)
    total = int(ends[-1]) if len(ends) else 0
    ids = vocabulary.flat[np.repeat(vocabulary.starts[index] - (ends - per_word), per_word) + np.arange(total)] if total else np.empty(0, np.uint32)
    bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()]
    return ids, np.diff(bounds)


def cuts(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Piece lengths of a document of n ids: full ones, then the set bits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pieces(path: str, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, counts = encode(pc.fill_null(batch.column(1), ""), path)
            stops = np.cumsum(counts + 1)
            own = np.full(int(stops[-1]), end_id, "<u4")
            own[np.delete(np.arange(len(own)), stops - 1)] = ids
            pieces = [cuts(n, most) for n in (counts + 1).tolist()]
            doc = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
            length = np.fromiter(itertools.chain.from_iterable(pieces), np.int64, len(doc))
            at = np.cumsum(length) - length
            data = memoryview(own).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            start = at - (stops - counts - 1)[doc]
            columns = [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, (counts + 1)[doc]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``most`` must be a power of two.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    pieces = stage(map_arrow(ids, _pieces(tokenizer_path, most, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"), "pack-pieces")
    blocks = bucket_count(pieces.count())
    # longest bucket first, inside it blocks of documents
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    turn = F.lit(most.bit_length()) - F.length(F.bin("length"))
    spot = pieces.withColumn("block", turn.cast("long") * F.lit(blocks) + block)
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    numbered = with_running(spot, [], "block", order, {"sequence_id": F.lit(1).cast("long")})
    return numbered.drop("block").withColumn("offset", F.lit(0).cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
