"""The corpus pipeline against plain versions of its stages."""

from __future__ import annotations

import importlib.util
import zlib
from collections import Counter

import numpy as np
import pytest

from reactorlake.llm import common, mixing, packing, quality
from tests.llm import brute

if importlib.util.find_spec("corpus_pipeline") is None:  # removed together with the operators
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_plain_versions(spark):
    from tokenizers import Tokenizer

    docs = common.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "ngram_join", "mixing", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    model = quality.fit(docs, common.table(spark, SF, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.5}
    out = common.stage(corpus_pipeline.STAGES[0][1](spark, docs, SF), "t")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == good
    assert all(r == rows[r.doc_id] for r in out.collect())

    first = {}
    for i in sorted(good):
        first.setdefault(brute.SPACE.sub(" ", rows[i].text or ""), i)
    out = common.stage(corpus_pipeline.STAGES[1][1](spark, out, SF), "t")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(first.values())

    linked = brute.linked([(i, rows[i].text) for i in first.values()], 5, 80)
    alone = {i for i, (_, c) in linked.items() if c == i}
    out = common.stage(corpus_pipeline.STAGES[2][1](spark, out, SF), "t")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == alone

    want = {r.id: r.taken for r in mixing.decide(out).collect() if r.taken}
    out = common.stage(corpus_pipeline.STAGES[3][1](spark, out, SF), "t")
    taken = Counter()
    for r in out.collect():
        taken[r.doc_id] += len(brute.WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert out.columns == docs.columns and dict(taken) == want

    tok = Tokenizer.from_file(__import__("public_tokenizers").path(packing.TOKENIZER))
    pieces = Counter()
    for r in out.collect():
        ids, at = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4"), 0
        for n in packing.cuts(len(ids)):
            pieces[(r.doc_id, at, n, zlib.crc32(ids[at : at + n]))] += 1
            at += n
    out = corpus_pipeline.STAGES[4][1](spark, out, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in out) == pieces
    assert len({r.sequence_id for r in out}) == len(out)

    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, out))


def test_near_copies_are_those_of_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(400)]
    run = [*words[:200], *(f"new{i}" for i in range(30)), *words[230:]]
    rows = [(1, " ".join(words)), (2, " ".join(run)), (3, " ".join([*words[:200], *(f"x{i}" for i in range(200))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, (_, c) in brute.linked(rows, 5, 80).items() if c == i}
    assert want == {1, 3} and {i for i, (_, c) in brute.linked(rows, 3, 90).items() if c == i} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()} == want


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd, nothing):
        docs = start
        for name, function in corpus_pipeline.STAGES[:-1]:
            docs = common.stage(function(spark, docs, str(tmp_path)), "odd")
            assert docs.columns == start.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0 or start is odd


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
