"""Operators over documents: odd cases and brute-force versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reactorlake.llm import common, exact_dedup, minhash, mixing, ngram_join, packing, pii, quality, runs, suffix_dedup
from tests.llm import brute
from tests.llm.conftest import ROWS

TOKENS = __import__("public_tokenizers").path(packing.TOKENIZER)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- exact dedup -------------------------------------------------------------


def test_exact_report_on_odd_rows(odd, nothing):
    norm = [(i, brute.SPACE.sub(" ", t or "")) for i, t, *_ in ROWS]
    keep, size = {}, {}
    for i, t in norm:
        size[t] = size.get(t, 0) + 1
        if i is not None:
            keep[t] = min(keep.get(t, i), i)
    want = sorted((str(i), str(keep.get(t)), size[t], i == keep.get(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.report(odd).collect())
    assert got == want
    assert exact_dedup.report(nothing).count() == 0


def test_exact_survivors_keep_all_columns(odd, nothing):
    kept = exact_dedup.survivors(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len({brute.SPACE.sub(" ", t or "") for _, t, *_ in ROWS})
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 5, 6, 8, 9, 10, 11]
    assert exact_dedup.survivors(nothing).count() == 0


def test_exact_digest_collision_compares_content(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.report(docs).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 4: (2, 2)}


# --- mixing ------------------------------------------------------------------


def test_mix_targets_stop_at_twice_the_source(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 7)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    # a and the null source stop first, then c; the rest goes to b
    assert got["a"] == 20 and got[None] == 14 and got["c"] == 1000
    assert got["b"] == pytest.approx(1.5 * 1517 - 1034)
    assert sum(got.values()) == pytest.approx(1.5 * 1517)


def test_mix_is_near_targets_and_stable(documents):
    rows = mixing.decide(documents).collect()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    # rounding leaves less than a word per source, and the next packet in the order takes it
    assert all(abs(taken[s] - target[s]) <= len(taken) for s in taken)
    again = mixing.decide(documents.repartition(7)).collect()
    assert sorted((r.id, r.taken) for r in rows) == sorted((r.id, r.taken) for r in again)


def test_mix_rows_have_the_decided_words(documents, odd, nothing):
    words = lambda t: len(brute.WORD.findall(t or ""))
    decided = {}
    for r in mixing.decide(documents).collect():
        decided[r.id] = decided.get(r.id, 0) + r.taken
    got, texts = {}, dict(pairs(documents))
    for i, t in pairs(mixing.mix(documents)):
        got[i] = got.get(i, 0) + words(t)
        assert texts[i].lstrip(" \t\n").startswith(t.lstrip(" \t\n")) or texts[i] == t
    assert got == {i: n for i, n in decided.items() if n}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert len(mixing.decide(odd).collect()) == len(ROWS)
    assert mixing.decide(nothing).count() == 0 and mixing.mix(nothing).count() == 0


# --- packing -----------------------------------------------------------------


def test_packing_round_trip(odd, nothing, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS)
    few = odd.select("doc_id", "text").filter("doc_id IS NOT NULL AND doc_id NOT IN (7, 9)").union(documents.select(F.col("doc_id") + 100, "text"))
    rows = packing.pack(few, TOKENS).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.sequence_id for r in rows} == set(range(len(rows)))
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in order] == sorted((r.length for r in rows), reverse=True)
    for i, t in pairs(few):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert packing.pack(odd, TOKENS).filter("doc_id = 9").agg(F.sum("length")).first()[0] == 2 * packing.pack(odd, TOKENS).filter("doc_id = 9").first().doc_tokens
    assert packing.pack(nothing, TOKENS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, TOKENS, most=1000)


def test_special_strings_and_unicode_are_encoded_as_the_tokenizer_does():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["", "  ", "Hello <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "ΣΑΣ Σ İI", "a\x1cb\x85c it's I'M é ﬁ １２３", "UPPER upper"]
    ids, n = packing.encode(pa.array(texts), TOKENS)
    want = [e.ids for e in Tokenizer.from_file(TOKENS).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


# --- n-gram join and fingerprints --------------------------------------------


def test_ngram_join_equals_brute_force(documents):
    want = brute.linked(pairs(documents), 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(documents).collect()}
    assert got == want


def test_ngram_join_edited_copies_and_frequent_tokens(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 150)) for _ in range(4)]
    rows = []
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(rng.integers(0, 6)):
            words[rng.integers(0, 150)] = f"edit{rng.integers(0, 10**6)}"
        rows.append((i * 3 + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(ngram_join, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 50_000)
    for frequent in (4, 16, 256):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs, frequent=frequent).collect()}
        assert got == brute.linked(rows, 3, 90)


def test_ngram_join_odd_rows(odd, nothing):
    rows = ngram_join.link(odd).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1] == got[2] == (10, 1) and got[6] == got[7] == (got[6][0], 6)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[8] == (1, 8) and got[None][1] is None
    kept = ngram_join.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id) == [1, 3, 4, 5, 6, 8, 9, 9, 10, 11]
    assert ngram_join.link(nothing).count() == 0


def test_near_duplicate_classes_hold_exact_links(documents, odd, nothing):
    want = brute.linked(pairs(documents), 5, 80)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents).collect()}
    assert got == {i: c for i, (_, c) in want.items()}
    assert minhash.near_duplicates(odd).count() == len(ROWS) and minhash.near_duplicates(nothing).count() == 0


def test_edited_fingerprints(documents, nothing):
    rows = {r.doc_id: r for r in minhash.edited_fingerprints(documents).collect()}
    texts = dict(pairs(documents))
    order = sorted(texts, reverse=True)
    off = []
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = brute.shingles(t, 5), brute.shingles(edited, 5)
        off.append(abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(off) < 0.04 and max(off) < 0.2
    assert minhash.edited_fingerprints(nothing).count() == 0


def test_edited_fingerprints_odd_rows(odd):
    rows = minhash.edited_fingerprints(odd).collect()
    assert len(rows) == len(ROWS)
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[6] == prints[7] and prints[3] == prints[4] == {"f" * 512}
    one = odd.filter("doc_id = 1")
    r = minhash.edited_fingerprints(one).first()
    t = ROWS[0][1]
    assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + t[: len(t) // 2]).encode()).hexdigest() and r.near_next == 1.0


# --- personal data -----------------------------------------------------------


def test_base_spans_equal_the_plain_patterns(spark, odd, documents):
    tricky = ["a@b.c_d@e.f", "a@b.c.@d.e", "@", "x@y", "x@y.", "1.2.3.4.5 256.1.1.1 0001.2.3.4", "+1 2", "+12345678 +1(23)45-67.89 0", "4111-1111-1111-1111 4111 1111  1111 1111", "1" * 300, "++49 30 1234567", "a..b@c-d.e-f..g@h.i"]
    docs = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string").union(documents.select("doc_id", "text")).union(odd.select(F.col("doc_id") + 5000, "text").filter("doc_id IS NOT NULL").distinct())
    got = {r.id: r.s for r in pii.find(docs).select("id", pii._listed(tuple(pii.PATTERNS)).alias("s")).collect()}
    assert got == {i: ",".join(brute.base_spans(t)) for i, t in pairs(docs)}


def test_revealing_terms_are_found_and_taken_out(spark, nothing):
    rows = [(i, f"report {i} filler{i} Zorblax wrote from zorb@mail.example on day{i} about topic{i % 7}") for i in range(6)]
    rows += [(100 + i, f"report about topic{i % 7} with common words and nothing else") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    found = {r.id: r for r in pii.find(docs).collect()}
    terms = {rows[i][1][s.start : s.stop] for i in range(6) for s in found[i].term}
    assert "Zorblax" in terms and "report" not in terms and not any(t.startswith("filler") for t in terms)
    assert all(not found[100 + i].term for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zorb@" not in clean[0] and "[EMAIL]" in clean[0] and "Zorblax" not in clean[0] and clean[100] == rows[6][1]
    assert pii.find(nothing).count() == 0 and pii.sanitise(nothing).count() == 0


def test_copies_do_not_hide_revealing_terms(spark):
    texts = [f"Zorblax{' and' * (i + 1)} more from zorb@mail.example" for i in range(3)]
    texts = [t for t in texts for _ in range(30)] + [f"note {i} with other and more words from nobody" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: [texts[r.id][s.start : s.stop] for s in r.term] for r in pii.find(docs).collect()}
    assert all("Zorblax" in found[i] for i in range(90)) and not any(found[i] for i in range(90, 190))


def test_terms_are_found_anywhere_and_for_rare_values(spark):
    gap = " ".join(f"common{i}" for i in range(60))
    texts = [f"Zorblax {gap} from zorb@mail.example {gap} Li" for _ in range(1)] + [f"Qo {i % 2} {gap} call +49 30 1234567" for i in range(2)]
    texts += [f"{gap} note {i % 2}" + " x" * i for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: [texts[r.id][s.start : s.stop] for s in r.term] for r in pii.find(docs).collect()}
    assert {"Zorblax", "Li"} <= set(found[0]) and not any(t.startswith("common") for t in found[0])
    assert "Qo" in found[1] and "Qo" in found[2] and not any(found[i] for i in range(3, 103))


# --- quality -----------------------------------------------------------------


def test_quality_learns_on_its_folds_only(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).join(labels, "doc_id").withColumn("held", quality.held_out(F.col("doc_id"))).filter("held").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in scored]) > 0.9
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs.repartition(3), flipped)
    assert all(np.allclose(model.weights[k], again.weights[k]) for k in model.weights)


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 0), (10, 1), (11, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[3] == by[4] == by[5] and by[6] == by[7]
    assert quality.keep(odd, model).columns == odd.columns
    assert quality.fit(odd, labels.filter("false")).prior == 0.5
    assert quality.fit(nothing, labels).prior == 0.5 and quality.score(nothing, model).count() == 0


def test_passage_scores_do_not_depend_on_their_batch(monkeypatch):
    import pyarrow as pa

    texts = [t for _, t, *_ in ROWS]
    found = quality.Passages.of(pa.array(texts))
    x = np.concatenate(list(found.blocks()))
    for i, t in enumerate(texts):
        alone = quality.Passages.of(pa.array([t], pa.string()))
        assert np.array_equal(x[found.first[i] : found.first[i + 1]], np.concatenate(list(alone.blocks())))
    monkeypatch.setattr(quality, "BLOCK_WORDS", 150)
    assert len(list(found.blocks())) > 100 and np.array_equal(np.concatenate(list(found.blocks())), x)


def test_passage_features_equal_a_plain_count():
    import pyarrow as pa

    words = "Ab ab, ÀB 12 ab ab a-Z".split()
    got = next(quality.Passages.of(pa.array([" ".join(words)])).blocks())[0]
    kinds = Counter(int(quality._CLASS[b]) for w in words for b in w.encode())
    total = sum(kinds.values())
    lengths = [len(w.encode()) for w in words]
    want = [kinds[k] / total for k in range(quality.CLASSES)]
    want += [np.log1p(7), np.mean(lengths), np.std(lengths), 1 / 7, 1 / 7, 6 / 7]
    mask, low = 2**64 - 1, [w.encode().lower() for w in words]
    found = [[0] * quality.BUCKETS, [0] * quality.BUCKETS]
    for w in low:
        h = sum((c + 1) * pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i, c in enumerate(w)) & mask
        found[0][((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & mask) >> 32 & 127] += 1
        for i in range(len(w) - 2):
            found[1][(int.from_bytes(w[i : i + 3], "big") * 0x94D049BB133111EB & mask) >> 32 & 127] += 1
    want += [np.sqrt(n / sum(f)) for f in found for n in f]
    assert np.allclose(got, want)


def _small_bags(rng, n=12):
    bags = [rng.normal(size=(rng.integers(1, 5), quality.N_FEATURES)).astype(np.float32) for _ in range(n)]
    return bags, (rng.random(n) < 0.5).astype(float)


def test_forward_equals_a_plain_version(monkeypatch):
    from math import exp, tanh

    monkeypatch.setattr(quality, "EPOCHS", 2)
    bags, labels = _small_bags(np.random.default_rng(3))
    labels[:2] = 0, 1
    model = quality.train(bags, labels)
    w = {k: v.tolist() for k, v in model.weights.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    layer = lambda x, m, b: [dot(x, [row[j] for row in m]) + b[j] for j in range(len(b))]
    want = []
    for bag in bags:
        hs, ss = [], []
        for x in bag.tolist():
            x = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(x, w["mean"], w["scale"], strict=True)]
            h = [tanh(v) for v in layer(x, w["W"], w["b"])]
            gated = [tanh(t) / (1 + exp(-u)) for t, u in zip(layer(h, w["V"], w["bv"]), layer(h, w["U"], w["bu"]), strict=True)]
            hs.append(h)
            ss.append(exp(dot(gated, w["a"])))
        z = [sum(s * h[j] for s, h in zip(ss, hs, strict=True)) / sum(ss) for j in range(quality.HIDDEN)]
        want.append(1 / (1 + exp(-(dot(z, w["c"]) + w["c0"]))))
    f = model.encode(np.concatenate(bags))
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    assert np.allclose(model.pool(f["h"], f["s"], first)["p"], want)


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    rng = np.random.default_rng(5)
    bags, labels = _small_bags(rng)
    labels[:2] = 0, 1
    model = quality.train(bags, labels)
    x, first = np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    share = rng.random(len(bags))

    def loss():
        f = model.encode(x)
        p = model.pool(f["h"], f["s"], first)["p"]
        return -(share * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    for k, grad in model.gradients(x, first, labels, share).items():
        base = model.weights[k].copy()
        for at in rng.integers(0, base.size, 5):
            sides = []
            for move in (1e-5, -1e-5):
                model.weights[k] = np.array(base)
                model.weights[k].reshape(-1)[at] += move
                sides.append(loss())
            model.weights[k] = base
            assert np.isclose(np.asarray(grad).reshape(-1)[at], (sides[0] - sides[1]) / 2e-5, rtol=1e-4, atol=1e-7), k


def test_one_passage_decides_and_has_the_attention():
    import pyarrow as pa

    rng = np.random.default_rng(11)
    usual, bad = [f"word{i:03d}" for i in range(300)], [f"grim{i:03d}" for i in range(40)]

    def document(label):
        parts = [rng.choice(usual, quality.PASSAGE).tolist() for _ in range(int(rng.integers(4, 9)))]
        at = int(rng.integers(len(parts)))
        if not label:
            parts[at][::2] = rng.choice(bad, quality.PASSAGE // 2).tolist()
        return " ".join(w for p in parts for w in p), at

    labels = np.arange(600) % 2
    made = [document(label) for label in labels]
    found = quality.Passages.of(pa.array([t for t, _ in made]))
    model = quality.train([found.sample(i, quality.TRAIN_PASSAGES) for i in range(400)], labels[:400].astype(float))
    p = model.score(found)[400:]
    assert np.mean((p >= 0.5) == labels[400:]) > 0.95
    parts = [model.encode(b) for b in found.blocks()]
    att = model.pool(np.concatenate([f["h"] for f in parts]), np.concatenate([f["s"] for f in parts]), found.first)["att"]
    top = [int(np.argmax(att[found.first[i] : found.first[i + 1]])) == made[i][1] for i in range(400, 600) if not labels[i]]
    assert np.mean(top) > 0.9


def test_fit_takes_one_bounded_text_for_an_id(spark, monkeypatch):
    rows = [(1, f"good text number {i}") for i in range(200)] + [(2, "BAD!!! TEXT!!! " * 20_000), (4, None), (5, "other good text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 1), (5, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "held_out", lambda c: F.lit(False))
    monkeypatch.setattr(quality, "train", lambda bags, labels: seen.append(([b.shape for b in bags], labels.tolist(), bags[0].tobytes())))
    quality.fit(docs, labels)
    quality.fit(docs.repartition(2), labels)
    assert seen[0][0] == [(1, quality.N_FEATURES), (quality.TRAIN_PASSAGES, quality.N_FEATURES), (1, quality.N_FEATURES), (1, quality.N_FEATURES)]
    assert seen[0][1] == [1, 0, 1, 1] and seen[0] == seen[1]


# --- repeated strings --------------------------------------------------------


def test_repeats_equal_brute_force(documents):
    want = brute.repeats(pairs(documents))
    texts = dict(pairs(documents))
    got = {(r.doc_id, (texts[r.doc_id] or "").encode()): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(documents).collect()}
    assert got == want


def test_repeats_over_many_batches_and_ranges(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 60_000)
    want = sorted((k[0], *v) for k, v in brute.repeats(pairs(documents)).items())
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(documents).collect()) == want


def test_suffixes_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    starts, stops = np.array([0, 30, 3000, 3000]), np.array([30, 3000, 3000, 9000])

    def windows(s):
        return {(k, lo + i) for k, lo, n in zip(s["key"].tolist(), s["lo"].tolist(), s["n"].tolist(), strict=True) for i in range(n)}

    whole = windows(suffix_dedup.suffixes(data, starts, stops))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert windows(suffix_dedup.suffixes(data, starts, stops)) == whole
    assert sorted(w for _, w in whole) == [*range(30, 2951), *range(3000, 8951)]


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_clashing_hashes_never_remove(monkeypatch, bits):
    import pandas as pd
    import zstandard

    rng = np.random.default_rng(bits)
    letters = lambda n: "".join(rng.choice(list("abcdef"), n))
    shared = [letters(90), letters(60), letters(50)]
    rows = [(i, letters(40) + shared[i % 3] + letters(int(rng.integers(0, 40))) + shared[0][: 40 + i]) for i in (5, 3, 9, 1, 8, 2, 7, 4)]
    rolling = suffix_dedup.rolling
    monkeypatch.setattr(suffix_dedup, "rolling", lambda data, sizes: [h >> np.uint64(64 - bits) for h in rolling(data, sizes)])
    left, notes = [], []
    for batch, part in enumerate((rows[:3], rows[3:])):
        texts = [t.encode() for _, t in part]
        row = (batch, [i for i, _ in part], [len(t) for t in texts], zstandard.compress(b"".join(texts)), sum(map(len, texts)))
        left.append(pd.DataFrame([row], columns=["batch", "ids", "lengths", "data", "size"]))
        keys = len(np.unique(suffix_dedup.suffixes(*runs.layout(next(left[-1].itertuples()))[:3])["key"]))
        notes.append(pd.DataFrame([(batch, 0, zstandard.compress(bytes([1]) * keys), keys, None)], columns=["batch", "span", "answer", "n", "copies"]))
    contexts = pd.concat([suffix_dedup._contexts(1)(a, b) for a, b in zip(left, notes, strict=True)])
    masks = suffix_dedup._masks(contexts).assign(copies=None)
    got = {}
    for a in left:
        for r in suffix_dedup._cut(a, masks[masks.batch == a.batch[0]]).itertuples():
            got[r.id] = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
    assert got == {k[0]: v for k, v in brute.repeats(rows).items()} and sum(v[1] for v in got.values()) > 300


def test_repeats_odd_rows(odd, nothing):
    rows = suffix_dedup.remove_repeats(odd.filter("doc_id IS NULL OR doc_id NOT IN (6, 7)"), with_text=True).collect()
    want = brute.repeats([(i, t) for i, t, *_ in ROWS if i not in (6, 7)])
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == {(k[0], *v) for k, v in want.items()}
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in rows)
    long = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd).filter("doc_id IN (6, 7)").collect()}
    assert long[6].n_removed == 0 and long[7].n_removed == long[7].n_bytes and long[7].n_spans == 1
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_levels_stay_few_and_combine():
    levels = runs.Levels(np.minimum)
    rng = np.random.default_rng(0)
    best = {}
    for _ in range(64):
        keys, values = rng.integers(0, 5000, 300).astype(np.uint64), rng.integers(0, 1000, 300)
        levels.add(keys, values)
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            best[k] = min(v, best.get(k, v))
    assert len(levels.runs) <= 8
    asked = np.arange(5000, dtype=np.uint64)
    assert levels.scan(asked, 9999).tolist() == [best.get(k, 9999) for k in range(5000)]


def _pairs_of(monkeypatch, docs):
    sizes, real = {}, pii.stage

    def spy(df, label, *args):
        out = real(df, label, *args)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(pii, "stage", spy)
    pii.find(docs).count()
    monkeypatch.setattr(pii, "stage", real)
    return sizes["pii-pairs"]


def test_one_long_text_costs_its_values_plus_its_words(spark, monkeypatch):
    rows = lambda n: [(1, " ".join(f"name{i} u{i}@mail.example" for i in range(n)))] + [(2 + i, f"note {i}") for i in range(20)]
    small, large = (_pairs_of(monkeypatch, spark.createDataFrame(rows(n), "doc_id long, text string")) for n in (100, 400))
    assert 0 < small <= 2 * 100 + 10 and large <= 4 * small + 10


def test_planted_terms_are_found_and_chance_words_stay(spark):
    import random

    rng = random.Random(5)
    chance = lambda k: " ".join(f"w{rng.randrange(40)}" if rng.random() < 0.7 else f"rare{rng.randrange(10**6)}" for _ in range(k))
    rows = [(i, f"{chance(60)} Zorblax{i % 10} {chance(40)} zorb{i % 10}@mail.example {chance(50)}") for i in range(60)]
    rows += [(100 + i, f"{chance(90)} solo{i}@mail.example {chance(30)}") for i in range(40)]
    rows += [(200 + i, chance(rng.randrange(10, 300))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked, words, planted = 0, 0, 0
    for r in pii.find(docs).collect():
        text = dict(rows)[r.id]
        terms = {text[s.start : s.stop] for s in r.term}
        planted += f"Zorblax{r.id % 10}" in terms
        marked += sum(t.startswith(("rare", "w")) for t in terms)
        words += len({w for w in text.split() if w.startswith(("rare", "w"))}) if r.id < 200 else 0
    assert planted == 60 and marked < 0.05 * words


def test_disclosure_equals_its_formula(spark):
    texts = [f"Zorblax common a{i} from zorb@mail.example" for i in range(4)] + [f"common other b{i} c{i % 3}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import math
    import re

    rows = pii._rows(docs, "doc_id", "text")
    held = pii._found(rows).filter("text IS NOT NULL").select("key", "entities", "text")
    words = {t: {w for w in re.split(r"[\W_]+", t.lower()) if w} for t in texts}
    n_t = {w: sum(w in ws for ws in words.values()) for w in set().union(*words.values())}
    own, tokens = texts[:4], sum(map(len, words.values()))
    p, want = sum(len(words[t]) for t in own) / tokens, {}
    size = lambda w: int(math.log2(n_t[w]))
    told = {}
    for w in n_t:
        n_et = sum(w in words[t] for t in own)
        if n_et:
            d = math.log2(n_et * 34 / (4 * n_t[w])) / math.log2(34 / n_et)
            if d >= pii.GENERALISE:
                told[w] = d, n_et
    for w, (d, n_et) in told.items():
        q = n_et / n_t[w]
        luck = math.exp(-n_t[w] * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))) if q > p else 1
        if sum(size(x) == size(w) for x in n_t) * luck <= pii.CHANCE * sum(size(x) == size(w) for x in told):
            want[w] = d
    got = {r.term: r.disclosure for r in pii.disclosing(rows, held).collect()}
    assert "zorblax" in got and got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in got)


def test_fingerprint_ranges_balance_by_rows(spark):
    ids = [*range(2000), 10**15, *([None] * 1000)]
    docs = spark.createDataFrame([(i, f"text {k} of many") for k, i in enumerate(ids)], "id long, text string")
    ranged, parts = minhash._in_ranges(docs, 16)
    sizes = {r.part: r["count"] for r in ranged.groupBy("part").count().collect()}
    share = len(ids) / 16
    assert len(sizes) >= 14 and max(sizes.values()) < 2 * share and max(sizes) < parts
    rows = ranged.select("part", "o_null", "o_id", "hash").collect()
    assert sorted(rows, key=lambda r: (r.part, r.o_null, r.o_id or 0, r.hash)) == sorted(rows, key=lambda r: (r.o_null, r.o_id or 0, r.hash))


def test_next_documents_with_null_and_repeated_ids(spark, monkeypatch):
    ids = [*range(0, 60, 3), *([7] * 5), *([None] * 25), 10**17]
    rows = [(i, f"words {k} stand in text {k * 7 % 13}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = [(r.doc_id, r.edited_sha256) for r in minhash.edited_fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_of_a_join_are_deleted(spark, odd):
    import os

    def folders():
        root = common.shared_root(spark).removeprefix("file:")
        return set(os.listdir(f"{root}/llm")) if os.path.isdir(f"{root}/llm") else set()

    before = folders()
    links = ngram_join.link(odd)
    assert {n.rsplit("-", 1)[0] for n in folders() - before} == {"ngram-links"} and links.count() == odd.count()
