"""Frames that hold every odd case at once."""

from __future__ import annotations

import pytest

LONG = "word " * 30_000 + "a" * 100_000 + "@ " + "1 2-3 " * 20_000 + "x@" + "b." * 20_000 + "c"
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"),
    (2, "Alpha  beta gamma delta epsilon\tzeta eta theta iota kappa lambda mu", "en", "s1"),
    (3, None, None, None),
    (4, "", "en", "s2"),
    (5, " \n\t ", "en", None),
    (6, LONG, "en", "s1"),
    (7, LONG, "en", "s1"),
    (8, "one", "en", "s3"),
    (9, "Ünïcode ÀÉÎ ß \U0001f600 mail a.b@c.de, 10.0.0.255 and +49 (30) 123-4567 4111 1111 1111 1111", "de", "s3"),
    (9, "Ünïcode ÀÉÎ ß \U0001f600 mail a.b@c.de, 10.0.0.255 and +49 (30) 123-4567 4111 1111 1111 1111", "de", "s3"),
    (10, "the same passage of more than fifty bytes stands in several of the documents, first", "en", "s2"),
    (11, "and the same passage of more than fifty bytes stands in several of the documents, too", "en", "s2"),
    (None, "the same passage of more than fifty bytes stands in several of the documents, last", "en", "s2"),
    (None, None, "en", None),
]
CLASHES = ["id", "key", "digest", "salt", "norm", "row", "n", "rep", "size", "part", "tail", "bucket", "component", "source_no", "kept", "spans", "term", "batch"]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
