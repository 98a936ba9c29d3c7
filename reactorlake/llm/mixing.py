"""Mixing sources to target weights by weighted fair queueing.

1. Targets: sources in code-point order (null last) get the repeating weights,
   share ``SHARE`` times all words, and stop at ``CAP`` times their own size; the
   excess goes to the others by weight until no source is above (water filling,
   solved in closed form over the small table of sources).
2. Every document is queued up to ``ceil(CAP)`` times, in a shuffled order given by a digest
   of its id and text. The virtual finish time of a packet is the cumulative
   words of its source up to and including it, divided by the source's target.
   A document in service when the virtual clock reaches 1 is served in two
   packets, one finishing at 1, so that a long document can't push its source
   far off its target.
3. All packets are put in one global order by finish time (range buckets with
   carried totals) and cut where the running words reach the total budget.

Running totals never run over a whole source: see ``common.with_running``.

Defined cases: null and all-space texts have size 0 and take 0. A source of
size 0 has target 0. Null sources form one source. Rows repeating id, source and text are
equal rivals: the multiset of their results is fixed, not which row gets which. Empty input
gives an empty result. Extra columns are ignored by ``decide`` and carried by ``mix``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reactorlake.llm.common import WORD, bucket_count, stage, table, text_of, with_running

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary")).alias("key"),
    )


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source_no, source, source_size, target. The windows
    run over one row per source, never over documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table_ = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    limit = F.col("source_size") * F.lit(float(cap))
    s = per.withColumn("source_no", rank).withColumns({"w": F.get(table_, F.pmod("source_no", F.lit(len(weights)))), "limit": limit})
    order = W.orderBy(F.col("limit") / F.col("w"), "source_no")
    below, above = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(above))
    free = F.when(F.col("limit") >= F.col("level") * F.col("w"), F.col("level"))
    s = s.withColumn("final", F.max(free).over(everyone))
    return s.select("source_no", "source", "source_size", F.coalesce(F.least("limit", F.col("final") * F.col("w")), "limit").alias("target"))


def _queue(sized: DataFrame, per: DataFrame) -> DataFrame:
    """Documents with the words of their source shuffled before them (``before``)
    and a number inside the source (``ord``)."""
    buckets = bucket_count(sized.count())
    named = sized.join(per, sized["source"].eqNullSafe(per["source"])).drop(per["source"])
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    named = named.withColumn("bucket", F.floor(spot * F.lit(buckets) / F.lit(float(1 << 32))).cast("long"))
    order = [F.col("key"), F.col("id"), F.col("size")]
    return with_running(named, ["source_no"], "bucket", order, {"before": F.col("size"), "ord": F.lit(1).cast("long")}).drop("bucket")


def _packets(queue: DataFrame, cap: float) -> DataFrame:
    """One row per document, turn and part: start, words, virtual finish time."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)))
    packet = queue.filter("size > 0 AND target > 0").withColumn("turn", turns).withColumn("start", F.col("before") + F.col("turn") * F.col("source_size"))
    early = F.greatest(F.least(F.floor("target") - F.col("start"), F.col("size")), F.lit(0)).cast("long")
    parts = F.array(F.struct(F.lit(0).alias("part"), early.alias("words")), F.struct(F.lit(1).alias("part"), (F.col("size") - early).alias("words")))
    packet = packet.withColumn("p", F.explode(F.filter(parts, lambda x: x["words"] > 0))).select("source_no", "ord", "start", "size", "target", "p.part", "p.words")
    finish = (F.col("start") + F.col("size")) / F.col("target")
    return packet.withColumn("finish", F.when(F.col("part") == 0, F.least(finish, F.lit(1.0))).otherwise(F.greatest(finish, F.lit(1.000000001))))


def decide(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
) -> DataFrame:
    """One row per document: id, key, source, size, source_size, target, taken (words, repeats counted)."""
    sized = stage(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    per = stage(targets(sized, weights, share, cap), "mix-targets")
    queue = stage(_queue(sized, per), "mix-queue")
    # two numbers over the table of sources
    words, limits = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0)) * cap).first()
    budget = math.floor(min(words * share, limits))
    # a source advances evenly in virtual time, so equal steps of it hold about equally many packets
    steps = bucket_count(2 * sized.count())
    packet = _packets(queue, cap).withColumn("step", F.floor(F.col("finish") * F.lit(steps)).cast("long"))
    served = with_running(packet, [], "step", [F.col(c) for c in ("finish", "source_no", "start", "part", "ord")], {"served": F.col("words")})
    taken = F.greatest(F.least(F.lit(budget) - F.col("served"), F.col("words")), F.lit(0)).cast("long")
    won = served.groupBy("source_no", "ord").agg(F.sum(taken).alias("taken"))
    return queue.join(won, ["source_no", "ord"], "left").select("id", "key", "source", "size", "source_size", "target", "ord", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept;
    a document cut by the budget keeps its first words with the space between them."""
    won = decide(docs, id_col, text_col, source_col, **settings).filter("taken > 0")
    same = W.partitionBy("id", "source", "key")
    won = won.withColumn("copy", F.row_number().over(same.orderBy("ord"))).select(F.col("id").alias("w_id"), F.col("source").alias("w_source"), F.col("key").alias("w_key"), F.col("copy").alias("w_copy"), "size", "taken")
    text = text_of(text_col)
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"))
    rows = rows.withColumn("copy", F.row_number().over(same.orderBy(F.lit(0))))
    on = (F.col("key") == F.col("w_key")) & (F.col("copy") == F.col("w_copy")) & F.col("id").eqNullSafe(F.col("w_id")) & F.col("source").eqNullSafe(F.col("w_source"))
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size"))))
    out = rows.join(won, on).withColumn("turn", turn).withColumn("n", F.least(F.col("size"), F.col("taken") - F.col("turn") * F.col("size")))
    old = F.col("row")[text_col]
    first = F.array_join(F.slice(F.regexp_extract_all(old, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("n").cast("int")), "")
    return out.select(F.col("row").withField(text_col, F.when(F.col("n") < F.col("size"), first).otherwise(old)).alias("row")).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
 w AS (SELECT *, CASE no % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w, source_size * 2.0::DOUBLE AS lim FROM s),
 l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (ORDER BY lim / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 t AS (SELECT *, coalesce(least(lim, (max(CASE WHEN lim >= level * w THEN level END) OVER ()) * w), lim) AS target FROM l),
 q AS (SELECT d.*, t.no, t.source_size, t.target,
       coalesce(sum(size) OVER x, 0) AS before, row_number() OVER (PARTITION BY t.no ORDER BY key, doc_id, size) AS ord
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
       WINDOW x AS (PARTITION BY t.no ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT *, before + turn * source_size AS start FROM q, (VALUES (0), (1)) v(turn) WHERE size > 0 AND target > 0),
 p AS (SELECT *, CAST(greatest(least(floor(target) - start, size), 0) AS BIGINT) AS early FROM e),
 k AS (SELECT no, ord, start, 0 AS part, early AS words, least((start + size)::DOUBLE / target, 1.0::DOUBLE) AS finish FROM p WHERE early > 0
       UNION ALL SELECT no, ord, start, 1, size - early, greatest((start + size)::DOUBLE / target, 1.000000001::DOUBLE) FROM p WHERE size > early),
 r AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, no, start, part, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS served FROM k),
 b AS (SELECT floor(least(sum(source_size) * 1.5::DOUBLE, sum(source_size) * 2.0::DOUBLE)) AS budget FROM s),
 g AS (SELECT no, ord, CAST(sum(greatest(least(budget - served, words), 0)) AS BIGINT) AS taken FROM r, b GROUP BY no, ord)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0) AS taken FROM q LEFT JOIN g USING (no, ord)
"""
