"""Line dedup, token alignment and periodic runs against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reactorlake.llm import line_dedup, periodic, token_align
from tests.llm import brute

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
rows_of = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- line dedup -------------------------------------------------------------------


def _lines_report(df, **kw):
    return collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.report(df, **kw).collect())


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        h1, h2 = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        if n:
            h1[: n // 2] = h1[0]  # many equal first halves
            sizes, bits = line_dedup.perfect_hash(h1, h2)
            assert bits.sum() == n and sum(sizes) == len(bits) and len(bits) < 5 * n + 200
            import pandas as pd

            frame = pd.DataFrame({"shard": 0, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "n": np.arange(n) + 5, "last": np.arange(n) * 7})
            row = next(line_dedup._build(frame).itertuples())
            shard = line_dedup.Shard(row)
            slot = shard.probe(h1, h2)
            assert sorted(slot.tolist()) == list(range(n))
            assert (shard.last[slot] == np.arange(n) * 7).all() and (shard.documents[slot] == np.arange(n) + 5).all()
            assert (shard.probe(h1, h2 ^ np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        line_dedup.perfect_hash(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_line_dedup_equals_brute_force(documents):
    want = collections.Counter(brute.cut_lines(rows_of(documents), 20, 2))
    assert sum(r[2] for r in want) > 0
    assert _lines_report(documents, least=20, documents=2) == want
    assert _lines_report(documents) == collections.Counter(brute.cut_lines(rows_of(documents)))


def test_line_dedup_through_far_shards(documents, monkeypatch):
    want = collections.Counter(brute.cut_lines(rows_of(documents), 20, 2))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)  # many shards
    monkeypatch.setattr(line_dedup, "PROBES", 200)  # and several groups for some
    assert _lines_report(documents, least=20, documents=2, limit=0) == want
    assert _lines_report(documents, least=20, documents=2) == want


def test_line_dedup_holder_and_white_space(spark):
    line = "x" * 40
    texts = [(1, f" {line}\t\nown one"), (2, f"{line.upper()}\n{line}"), (3, f"\v{line}\f"), (4, f"{line}\nrest\n"), (5, f"a\n{line}\n{line} \nb"), (6, "y" * 39)]
    texts += [(i, "y" * 39) for i in range(7, 20)] + [(20 + i, "ü" * 40) for i in range(4)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = collections.Counter(brute.cut_lines(texts))
    assert want[(1, 2, 1, "own one")] == 1 and want[(5, 4, 0, texts[4][1])] == 1 and want[(2, 2, 2, "")] == 1 and want[(4, 3, 1, "rest\n")] == 1
    for limit in (0, line_dedup.BROADCAST_BYTES):
        assert _lines_report(df, limit=limit) == want


def test_line_dedup_odd_rows(odd, nothing, spark):
    for limit in (0, line_dedup.BROADCAST_BYTES):
        assert _lines_report(odd, least=10, documents=2, limit=limit) == collections.Counter(brute.cut_lines(rows_of(odd), 10, 2))
        assert line_dedup.report(nothing, limit=limit).count() == 0 and line_dedup.strip(nothing, limit=limit).columns == nothing.columns
    out = line_dedup.strip(odd, least=10, documents=2)
    assert out.columns == odd.columns and out.schema["text"] == odd.schema["text"] and out.count() == odd.count()
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id}
    assert kept[3] is None and kept[4] == "" and kept[6] == "" and kept[7] != ""  # 7 holds the long line
    # all holders without an id keep the line
    lone = spark.createDataFrame([(None, "z" * 50)] * 6, "doc_id long, text string")
    assert {(r.n_dropped, r.kept) for r in line_dedup.report(lone).collect()} == {(0, "z" * 50)}


def test_unsigned_shards(spark):
    for count in (1, 3, 7, 1000):
        df = spark.createDataFrame([(x,) for x in (-1, -(2**63), 2**63 - 1, 0, 5, -12345)], "h1 long")
        got = [(r.h1, r.s) for r in df.withColumn("s", line_dedup._shard("h1", count)).collect()]
        assert all(s == (h % 2**64) % count for h, s in got)


# --- periodic runs ----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9)), max_size=5), min_size=1, max_size=4))
def test_runs_equal_brute_force(texts):
    words = [[w for u, n in t for w in u * n] for t in texts]
    runs, sizes, collapsed = periodic._judge(None, pa.array([" ".join(w) for w in words]), None)
    assert sizes.tolist() == [len(w) for w in words]
    assert runs == [brute.word_runs(w) for w in words]
    assert collapsed.to_pylist() == [brute.collapsed(w) for w in words]


def test_best_run_is_compared_exactly():
    assert periodic.greatest([]) is None
    assert periodic.greatest([(0, 12, 3), (20, 8, 2), (40, 4, 1)]) == (0, 12, 3)
    a, b = (0, 3 * 10**8 + 1, 10**8), (5, 3 * (10**8 - 1) + 1, 10**8 - 1)
    assert Fraction(b[1], b[2]) > Fraction(a[1], a[2]) and periodic.greatest([a, b]) == b


def _plain_periodic(i, text):
    words = brute.WORD.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute.word_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (i, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute.collapsed(words)))


def test_periodic_query_equals_brute_force(spark, documents, tmp_path):
    short = documents.filter("length(text) < 4000 OR text IS NULL")  # trying every period is cubic
    short.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = collections.Counter(_plain_periodic(*r) for r in rows_of(short))
    assert got == want and sum(r[1] > 0 for r in want) > 5


def test_periodic_odd_rows(odd, nothing):
    found = collections.defaultdict(list)
    for r in periodic.detect(odd).collect():
        found[r.doc_id].append(r)
    assert all(r.n_words == 0 and r.runs == [] and r.best is None and r.collapsed == "" for i in (3, 4, 5) for r in found[i])
    assert len(found[9]) == 2 and found[9][0] == found[9][1]
    long = found[6][0]  # 30,000 times one word, then two words 20,000 times
    assert long.n_words > 50_000 and tuple(long.best) == (0, 30_000, 1) and long.collapsed.startswith("word a")
    assert periodic.detect(nothing).count() == 0
    out = periodic.collapse(odd)
    assert out.columns == odd.columns and out.schema["text"] == odd.schema["text"]
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id}
    assert texts[3] is None and texts[2] == "Alpha  beta gamma delta epsilon\tzeta eta theta iota kappa lambda mu" and texts[6] == long.collapsed
    assert periodic.collapse(nothing).count() == 0


def test_one_word_repeated_costs_little():
    words, bounds = np.zeros(300_000, np.int64), np.array([0, 300_000])
    assert [x.tolist() for x in periodic.runs_of(words, bounds)] == [[0], [300_000], [1]]


# --- token alignment --------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path(token_align.TOKENIZER_A), public_tokenizers.path(token_align.TOKENIZER_B)


def test_merge_path_pieces_are_equal_and_whole():
    rng = np.random.default_rng(2)
    for _ in range(100):
        x, y = (np.unique(rng.integers(0, 300, rng.integers(0, 90))) for _ in range(2))
        both = np.intersect1d(x, y)
        for piece in (1, 2, 5, 64, 1000):
            i, j = token_align.shared_ends(x, y, piece)
            assert (x[i] == both).all() and (y[j] == both).all()
            if len(x) and len(y):
                a, b = token_align.diagonals(x, y, piece)
                work = np.diff(a) + np.diff(b)
                assert (work[:-1] == piece).all() and 0 < work[-1] <= piece
                merged = sorted([(v, 0) for v in x.tolist()] + [(v, 1) for v in y.tolist()])
                assert a.tolist() == [sum(s == 0 for _, s in merged[: p + q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)]


def _plain_alignment(rows, paths):
    both = token_align.spellings(*paths)
    spelled = [b.as_py() for b in both.bytes_a], [b.as_py() for b in both.bytes_b]
    found, counts = [], collections.Counter()
    for i, t in rows:
        a, b = ([], []) if not t else (both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t))
        if b"".join(spelled[0][k] for k in a) != b"".join(spelled[1][k] for k in b) or t and b"".join(spelled[0][k] for k in a) != (" " + t).encode():
            a, b = [], []
        groups, links = brute.aligned(a, b, *spelled)
        counts.update(links)
        found.append((i, a, b, groups, links))
    most = collections.Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    out = []
    for i, a, b, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), sha(text) if a else ""))
    return collections.Counter(out)


TEXTS = [
    (1, "hello world"), (2, "Hello  worlds\n\nnew\tline "), (3, None), (4, ""), (5, " "), (6, "<|endoftext|> and <s> and <unk> and <0x41>"),
    (7, "Ünïcode ß 日本語 \U0001f600 é ﬁ ２"), (8, "▁under"), (9, "internationalisation of tokenisers"), (9, "internationalisation of tokenisers"),
    (None, "hello world"), (11, "nul \x00 byte"), (12, "  two leading"),
]


def test_alignment_equals_brute_force(spark, documents, paths):
    rows = TEXTS + [r for r in rows_of(documents) if len(r[1] or "") < 1500][:60]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _plain_alignment(rows, paths)
    for most in (token_align.FREQUENT_PAIRS, 40, 0):  # all pairs broadcast, some, none
        assert collections.Counter(tuple(r) for r in token_align.report(df, *paths, most=most).collect()) == want
    assert {r[0]: r[1] for r in want}[8] == 0  # spelled as a blank by one of them


def test_groups_spell_their_texts(spark, paths):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    both = token_align.spellings(*paths)
    texts = collections.defaultdict(dict)
    for r in token_align.align(df, *paths).collect():
        a, b = b"".join(both.bytes_a[i].as_py() for i in r.a_ids), b"".join(both.bytes_b[i].as_py() for i in r.b_ids)
        assert a == b
        texts[r.doc_id][r.group] = (a, r.end)
    for i, t in TEXTS:
        if i in (1, 2, 6, 12):
            parts = [texts[i][k] for k in range(len(texts[i]))]
            assert b"".join(p for p, _ in parts) == (" " + t).encode()
            assert [e for _, e in parts] == np.cumsum([len(p) for p, _ in parts]).tolist()


def test_alignment_odd_rows(odd, nothing, paths):
    got = collections.defaultdict(list)
    for r in token_align.report(odd, *paths).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == odd.count()
    assert all(tuple(got[i][0])[1:] == (0, 0, 0, 0, 0, 0, "") for i in (3, 4))
    assert len(got[9]) == 2 and got[9][0] == got[9][1] and got[6][0][1:] == got[7][0][1:] and got[6][0].n_links > 50_000
    assert token_align.report(nothing, *paths).count() == 0 and token_align.align(nothing, *paths).count() == 0


def test_pieces_do_not_change_the_alignment(paths):
    both, rng = token_align.spellings(*paths), random.Random(3)
    texts = ["".join(rng.choice("ab c\nÜ日") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    whole = token_align.Aligned(both, texts)
    for piece in (1, 3, 17):
        cut = token_align.Aligned(both, texts, piece)
        assert cut.digests() == whole.digests() and (cut.link_a == whole.link_a).all() and (cut.link_b == whole.link_b).all()
