"""Exact deduplication with skew-safe combining.

Texts are equal when identical after replacing each run of ASCII white space by
one space. Three combining stages, each grouping by the digest *and the full
normalised text*, so equal digests of different texts never merge:

1. local: the map-side half of the first aggregation leaves one row per text,
   salt and input split;
2. salted: rows of one digest meet in ``SALTS`` tasks (the salt comes from the
   document id), so a text held by a third of all rows is spread;
3. global: at most ``SALTS`` winners per text are combined.

Verdicts go back to the documents by (digest, salt), again spread over the
salts; a bit mask remembers which salts a text was seen in. No text is joined.

Defined cases: null text is empty, so null, empty and all-space texts form at
most two classes ('' and ' '). Null ids lose against any id; a class with null ids only has
a null ``keep_id`` and keeps its rows in the report. Rows that repeat both id and text get the same
verdict in the report and are one row among ``survivors``. Empty input gives an
empty result. Extra columns are ignored by the report and carried by
``survivors`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import SPACE, stage, table, text_of

#: Tasks that share one digest; a bit mask of them fits a long.
SALTS = 32


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """id, norm, digest, salt and, with ``carry``, the whole row (its text only where it
    differs from ``norm``, which travels anyway) and a mark of the text that tells equal ids apart."""
    base = docs.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(text_of(text_col), SPACE, " ").alias("norm"),
        *([F.struct("*").alias("row"), F.md5(text_of(text_col).cast("binary")).alias("mark")] if carry else []),
    )
    if carry:
        text = F.col("row")[text_col]
        other = ~F.col("norm").eqNullSafe(text)
        base = base.withColumn("row", F.struct(F.col("row").withField(text_col, F.when(other, text)).alias("row"), other.alias("other")))
    return base.withColumns({"digest": F.sha2("norm", 256), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")})


def _combine(keyed: DataFrame, carry: bool) -> DataFrame:
    """One row per distinct text: digest, norm, keep_id (or the winning row), group_size, salts."""
    if carry:
        rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
        salted = keyed.groupBy("digest", "salt", "norm").agg(F.min_by("row", rank).alias("row"), F.min(rank).alias("rank"))
        return salted.groupBy("digest", "norm").agg(F.min_by("row", "rank").alias("row"))
    salted = keyed.groupBy("digest", "salt", "norm").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(
        F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each group of equal texts, with all its columns."""
    won = _combine(_keyed(docs, id_col, text_col, True), True)
    row = F.col("row.row").withField(text_col, F.when(F.col("row.other"), F.col("row.row")[text_col]).otherwise(F.col("norm")))
    return won.select(row.alias("row")).select("row.*")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, id_col, text_col, False)
    merged = _combine(keyed, False)
    winners = stage(merged.select("digest", "keep_id", "group_size", "salts"), "exact-winners")
    if winners.groupBy("digest").count().filter("count > 1").isEmpty():
        spread = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.expr("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
        joined = keyed.drop("norm").join(winners.select("digest", "keep_id", "group_size", spread.alias("salt")), ["digest", "salt"])
    else:  # two texts share a digest: tell them apart by their whole content
        joined = keyed.join(merged, ["digest", "norm"])
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
