"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from its own words
alone: surface statistics, and its words and character trigrams hashed into ``BUCKETS`` bins each, go through
a learned tanh layer. Gated attention weights it against its document's other passages, and the weighted passage
representation is scored by a logistic layer. Only document labels are known;
the attention is learned from them by gradient descent (Adam, numpy).

Training uses at most ``TRAIN_DOCS`` labelled documents, those with the smallest
hash of their id, one text for each id (the one with the smallest hash), and at most ``TRAIN_PASSAGES`` passages
of each, drawn alike from its whole text. Only their encoded passages, not their texts, reach the driver.
Scoring is a map over the documents: no shuffle, whole texts, all passages; passages are
encoded in blocks of ``BLOCK_WORDS`` words, of which only the hidden layer is kept.

Defined cases: null and empty texts are one passage of zeros and get that
passage's score. Null ids are never trained on nor held out. A document with several labels
counts by their mean (0.5 and more: label 1); null labels don't count. With no labelled rows, or
labels of one class only, every score is the smoothed share of label 1,
(ones + 1) / (rows + 2). Repeated rows are scored each, equal texts
alike; of several texts of one labelled id one is learned from. Empty input gives an empty result. Extra columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import map_arrow, slices, table

PASSAGE = 64
TRAIN_DOCS, TRAIN_PASSAGES = 6000, 16
BUCKETS = 128
BLOCK_WORDS = 200_000
#: Passages that are scored at once.
PIECE = 64
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE = 40, 256, 0.01
#: Fold that is held out: crc32 of the id as text, modulo FOLDS.
FOLDS, HELD_OUT = 3, 1
#: Hashed shares are divided by so many of their common deviation; weight decay of the matrices.
HASH_SCALE, DECAY = 4.0, 1e-2

# classes of bytes: lower case 0, upper case 1, digits 2, beyond ASCII 3, common marks 4, other marks 5
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4
CLASSES = 6
N_SURFACE = CLASSES + 6
N_FEATURES = N_SURFACE + 2 * BUCKETS
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that training never sees (false for null ids)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]


def _hashed(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Roots of the shares of words and of trigrams inside words (A-Z lower-cased) that fall into each bucket."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    lengths, run = np.diff(at), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at) - 1)))
    place = np.arange(len(low)) - np.repeat(at[:-1], lengths)
    word = np.add.reduceat((low + 1) * _POWERS[place & 255], at[:-1])
    word = ((word ^ (word >> 31)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    inside = np.flatnonzero(place < np.repeat(lengths, lengths) - 2)
    three = (low[inside] << 16) | (low[inside + 1] << 8) | low[inside + 2]
    three = (three * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)
    found = []
    for hashes, owner in ((word, run), (three, np.repeat(run, lengths)[inside])):
        bins = owner * BUCKETS + (hashes % BUCKETS).astype(np.int64)
        counts = np.bincount(bins, minlength=len(starts) * BUCKETS).reshape(-1, BUCKETS)
        found.append(np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)))
    return np.hstack(found)


def _encode(values: pa.Array, starts: np.ndarray) -> np.ndarray:
    """Features of runs of words that begin at ``starts``, from the words of each run alone."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at, kinds = offsets - offsets[0], _CLASS[data]
    lengths = np.diff(at).astype(np.float64)
    codes = values.dictionary_encode().indices.to_numpy().astype(np.int64)
    repeated = np.concatenate([[0.0], (codes[1:] == codes[:-1]).astype(np.float64)])
    repeated[starts] = 0.0
    words = np.diff(np.append(starts, len(values)))
    kind_counts = np.column_stack([_sums((kinds == k).astype(np.int32), at[starts]) for k in range(CLASSES)])
    total = _sums(lengths, starts)
    mean = total / words
    spread = np.sqrt(np.maximum(_sums(lengths**2, starts) / words - mean**2, 0))
    span = np.int64(codes.max() + 1)
    distinct = np.bincount(np.unique(np.repeat(np.arange(len(starts)), words) * span + codes) // span, minlength=len(starts))
    marked = (kinds[at[1:] - 1] >= 4).astype(np.float64)
    surface = [np.log1p(words), mean, spread, _sums(marked, starts) / words, _sums(repeated, starts) / words, distinct / words]
    return np.hstack([kind_counts / total[:, None], np.column_stack(surface), _hashed(data, at, starts)]).astype(np.float32)


@dataclass
class Passages:
    """The words of some texts, cut into passages; a text without words is one passage of zeros.

    ``first`` holds each text's first passage, and at its end the number of passages."""

    values: pa.Array
    starts: np.ndarray
    stops: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Passages:
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        full = pc.not_equal(pc.binary_length(words.values), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(full)])[words.offsets.to_numpy()]
        n_words = np.diff(bounds)
        n_passages = np.maximum(-(-n_words // PASSAGE), 1)
        first = np.concatenate([[0], np.cumsum(n_passages)])
        own = np.repeat(np.arange(len(n_words)), n_passages)
        starts = bounds[:-1][own] + (np.arange(int(first[-1])) - first[:-1][own]) * PASSAGE
        return cls(words.values.filter(pa.array(full)), starts, np.minimum(starts + PASSAGE, bounds[1:][own]), first)

    def features(self, lo: int, hi: int) -> np.ndarray:
        """Features of the passages from ``lo`` up to ``hi``."""
        out = np.zeros((hi - lo, N_FEATURES), np.float32)
        filled = np.flatnonzero(self.stops[lo:hi] > self.starts[lo:hi])
        if len(filled):
            begin, end = self.starts[lo + filled[0]], self.stops[lo + filled[-1]]
            out[filled] = _encode(self.values.slice(begin, end - begin), self.starts[lo + filled] - begin)
        return out

    def blocks(self) -> Iterator[np.ndarray]:
        """All passages in order, about ``BLOCK_WORDS`` words at a time."""
        step = max(1, BLOCK_WORDS // PASSAGE)
        for lo in range(0, len(self.starts), step):
            yield self.features(lo, min(lo + step, len(self.starts)))

    def sample(self, text: int, most: int) -> np.ndarray:
        """Features of at most ``most`` passages of one text: those with the smallest mixed place, in order."""
        picked = np.arange(self.first[text], self.first[text + 1])
        if len(picked) > most:
            mixed = (np.arange(len(picked)).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            picked = np.sort(picked[np.argsort((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), kind="stable")[:most]])
        return np.concatenate([self.features(i, i + 1) for i in picked])


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the scorer; ``prior`` alone when nothing could be learned."""

    prior: float
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Hidden layer and attention score of every passage."""
        w = self.weights
        x = np.clip((x.astype(np.float64) - w["mean"]) / w["scale"], -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"] + w["bv"]), 1 / (1 + np.exp(-(h @ w["U"] + w["bu"])))
        return {"x": x, "h": h, "t": t, "g": g, "s": (t * g) @ w["a"]}

    def pool(self, h: np.ndarray, s: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Attention of the passages inside their documents, weighted representations and scores."""
        w = self.weights
        starts, seg = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(s - np.maximum.reduceat(s, starts)[seg])
        a = e / np.add.reduceat(e, starts)[seg]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"att": a, "z": z, "p": 1 / (1 + np.exp(-(z @ w["c"] + w["c0"]))), "seg": seg, "starts": starts}

    def score(self, found: Passages) -> np.ndarray:
        if not self.weights:
            return np.full(len(found.first) - 1, self.prior)
        parts = [self._encode_alike(x) for x in found.blocks()]
        z = self.pool(np.concatenate([h for h, _ in parts]), np.concatenate([s for _, s in parts]), found.first)["z"]
        return 1 / (1 + np.exp(-((z * self.weights["c"]).sum(1) + self.weights["c0"])))

    def _encode_alike(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layers and attention scores by pieces of one shape: products of other shapes differ in the last digits."""
        n = len(x)
        f = self.encode(np.pad(x, ((0, -n % PIECE), (0, 0))).reshape(-1, PIECE, x.shape[1]))
        return f["h"].reshape(-1, HIDDEN)[:n], f["s"].reshape(-1)[:n]

    def gradients(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the log losses of the documents, weighted by ``share``."""
        w, f = self.weights, self.encode(x)
        f |= self.pool(f["h"], f["s"], first)
        seg, h, t, g, a = f["seg"], f["h"], f["t"], f["g"], f["att"]
        do = (f["p"] - labels) * share
        dz = (do[:, None] * w["c"])[seg]
        da = (dz * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, f["starts"])[seg])
        dtg = ds[:, None] * w["a"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "bv": dt.sum(0), "U": h.T @ dg, "bu": dg.sum(0),
            "a": (t * g).T @ ds, "c": f["z"].T @ do, "c0": do.sum(),
        }


def train(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit the attention model to document labels; the same bags give the same model."""
    n, ones = len(labels), float(np.sum(labels))
    model = Model((ones + 1) / (n + 2))
    if ones in (0.0, float(n)):
        return model
    rng = np.random.default_rng(7)
    every = np.concatenate(bags)
    mean, scale = every.mean(0, dtype=np.float64), np.maximum(every.std(0, dtype=np.float64), 1e-3)
    scale[N_SURFACE:] = HASH_SCALE * np.sqrt((scale[N_SURFACE:] ** 2).mean())  # one scale, so that rare buckets stay faint
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model.weights = {
        "mean": mean, "scale": scale,
        "W": draw(every.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "bv": np.zeros(ATTENTION),
        "U": draw(HIDDEN, ATTENTION), "bu": np.zeros(ATTENTION), "a": draw(ATTENTION), "c": draw(HIDDEN), "c0": np.zeros(()),
    }
    learned = [k for k in model.weights if k not in ("mean", "scale")]
    first_m, second_m = ({k: np.zeros_like(model.weights[k]) for k in learned} for _ in range(2))
    step = 0
    balance = np.where(labels == 1, n / (2 * ones), n / (2 * (n - ones)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            pick = order[at : at + BATCH]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            w, share = model.weights, np.sqrt(balance[pick]) / len(pick)
            grads = model.gradients(np.concatenate([bags[i] for i in pick]), first, labels[pick], share)
            step += 1
            for k in learned:
                grad = grads[k] + (DECAY * w[k] if w[k].ndim == 2 else 0)
                first_m[k] = 0.9 * first_m[k] + 0.1 * grad
                second_m[k] = 0.999 * second_m[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (first_m[k] / (1 - 0.9**step)) / (np.sqrt(second_m[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most)  # at most ``most`` rows are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=2):
            found = Passages.of(batch.column(2))
            bags = [found.sample(i, TRAIN_PASSAGES).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), batch.column(3), pa.array(bags, pa.binary())], ["id", "label", "hash", "bag"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    picked = texts.join(F.broadcast(sample), "id").select("id", "label", "text", "hash")
    bags = map_arrow(picked, run, "id string, label int, hash long, bag binary")
    rows = bags.groupBy("id", "label").agg(F.min(F.struct("hash", "bag"))["bag"].alias("bag")).collect()  # at most ``most``
    rows.sort(key=lambda r: (r.id, r.bag))
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES) for r in rows]
    return train(bags, np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(Passages.of(batch.column(1))), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=0):
            good = batch.filter(pa.array(model.score(Passages.of(batch.column(0))) >= threshold))
            yield pa.RecordBatch.from_struct_array(good.column(1).combine_chunks() if isinstance(good.column(1), pa.ChunkedArray) else good.column(1))

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    return map_arrow(rows, run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
