"""From index keys to classes: candidate pairs without all pairs of a group, exact checks, components.

Texts with equal shingle sets are one class beforehand (``set_classes``), so
copies never meet pairwise. ``link_classes`` then takes posting rows
(key, id, n, u, pos, kind) and works in two rounds:

1. every row of a key is compared with the key's pivot (the row with the fewest
   tokens of its own, so that the many keys of one family have one pivot), one pair per row;
   verified links give first components;
2. rows meet again by pivot, once per (pivot, row) however many keys they share. Only rows outside the
   pivot's component are compared with rows of other components, and only those pairs are made
   that size, own tokens and a 2,048-bit sketch of both sets allow.

Pairs within one component need no check, so nothing is lost: every pair that
shares a key shares its pivot, and is either verified, ruled out by a bound that all
linked pairs meet, or already connected. ``components`` finds
connected components by alternating large and small stars; each round is
written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reactorlake.llm.common import map_arrow, slices, stage
from reactorlake.llm.shingles import shingle_sets

SALTS = 32
#: Bits of a set's parity sketch, in longs.
SKETCH = [f"s{i}" for i in range(4)]
#: The same for the second round, where a set is sent once per pivot instead of once per key.
WIDE = [f"w{i}" for i in range(32)]
#: Kinds of keys: no position filter, the first shared token, a pair of neighbours.
PLAIN, SINGLE, PAIR = 0, 1, 2


def with_best(df: DataFrame, key: str, id_col: str, out: str, best: Callable[[str], Column] = F.min) -> DataFrame:
    """Adds the smallest (or ``best``) id among the rows of ``key``. Rows are spread
    over salts of their id, and a bit mask tells to which salts a key's answer must go."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    few = salted.groupBy(key, "__salt").agg(best(id_col).alias(out)).groupBy(key).agg(best(out).alias(out), F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__mask"))
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.col("__mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
    return salted.join(few.select(key, out, each.alias("__salt")), [key, "__salt"]).drop("__salt", "__mask")


def sketch(shingles: np.ndarray, longs: int = len(SKETCH)) -> np.ndarray:
    """Parities of the set's hashes in 64 bits a long: two sketches differ in at most as many bits as the sets in tokens."""
    parity = np.bincount((shingles & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def digest(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def set_rows(base: DataFrame, width: int) -> DataFrame:
    """One row per document of ``base`` (id, text): id, n (size of its shingle set), sig (the set's digest), wide (its sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([digest(s) for s in sets], pa.string()), pa.array([sketch(s, len(WIDE)) for s in sets], pa.list_(pa.int64()))], ["id", "n", "sig", "wide"])

    kind = base.schema["id"].dataType.simpleString()
    return stage(map_arrow(base, run, f"id {kind}, n int, sig string, wide array<long>"), "link-sets")


def set_classes(rows: DataFrame) -> DataFrame:
    """id, n, sig, rep of ``set_rows``: rep is the smallest id with an equal set, its own for an empty set."""
    found = with_best(rows.select("id", "n", "sig"), "sig", "id", "rep")
    return found.select("id", "n", "sig", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"))


def postings(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """key, id, n, u, pos, kind and sketch of the class representatives. ``rows``: id, n, u, sig,
    singles, first (position of the first single), pairs, ahead (of the first pair), sketch."""
    reps = rows.filter("size(singles) + size(pairs) > 0").join(classes.filter("id = rep").select("id", "sig"), ["id", "sig"], "left_semi")
    bits = [F.get("sketch", F.lit(i)).alias(c) for i, c in enumerate(SKETCH)]

    def kind(keys: str, ahead: str, code: int) -> DataFrame:
        each = reps.select("id", "n", "u", "sketch", F.col(ahead).alias("ahead"), F.posexplode(keys).alias("i", "key"))
        return each.select("key", "id", "n", "u", (F.col("i") + F.col("ahead")).alias("pos"), F.lit(code).alias("kind"), *bits)

    return kind("singles", "first", SINGLE).unionAll(kind("pairs", "ahead", PAIR))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (id, component) for every linked id, component the smallest id."""
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = mark
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "stars")


def sets_of(ids: DataFrame, base: DataFrame, width: int) -> DataFrame:
    """(id, grams) of the given ids, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams = [s.view(np.int64) for s in shingle_sets(batch.column(1), width)]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            values = pa.array(np.concatenate(grams) if grams else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "grams"])

    kind = base.schema["id"].dataType.simpleString()
    return map_arrow(base.join(ids, "id", "left_semi").select("id", "text"), run, f"id {kind}, grams array<long>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A & B| >= percent * |A | B|."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.withColumn("shared", shared).filter(F.col("shared") * 100 >= percent * (F.size("ga") + F.size("gb") - F.col("shared"))).select("a", "b").distinct()


def _may_link(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Bounds that every linked pair meets on the key that yields it first.

    Linked sets of n and m tokens differ in at most ``loss`` tokens. So do their
    sketches, and the tokens before the first shared one are among them. Before the
    first pair of neighbours, every gap between shared tokens holds another of them.
    """
    n, m, pos, at = x("n"), y("n"), x("pos"), y("pos")
    loss = F.floor((n + m) * (100 - percent) / (100 + percent))
    place = F.when(x("kind") == SINGLE, pos + at <= loss).otherwise((pos + at <= 3 * loss) & (F.abs(pos - at) <= loss))
    apart = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in SKETCH[1:]), F.bit_count(x(SKETCH[0]).bitwiseXOR(y(SKETCH[0]))))
    return (x("kind") == PLAIN) | ((F.least(n, m) * 100 >= F.greatest(n, m) * percent) & place & (apart <= loss))


def _second_round(spokes: DataFrame, known: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows with one pivot and different components that may be linked.

    ``spokes``: id and pivot; ``about``: id, n, u (tokens that no other document has), wide. Linked sets of n
    and m tokens differ in at most (n + m) * c tokens, c = (100 - percent) / (100 + percent); own tokens
    always differ, so u - c * n must not be positive in sum. That also tells, by the smallest one
    of a pivot, which rows can have no partner at all.
    """
    share = (100 - percent) / (100 + percent)
    of = known.select("id", "component")
    named = spokes.join(of, "id", "left").join(of.select(F.col("id").alias("pivot"), F.col("component").alias("main")), "pivot", "left")
    named = stage(named.select("id", "pivot", F.coalesce("component", "id").alias("component"), F.coalesce("main", "pivot").alias("main")), "link-named")
    split = named.filter("component <> main").select("pivot").distinct()
    facts = about.select("id", "n", "u", *[F.get("wide", F.lit(i)).alias(c) for i, c in enumerate(WIDE)])
    rows = named.join(split, "pivot", "left_semi").join(facts, "id").withColumn("excess", F.col("u") - F.col("n") * share)
    rows = stage(rows, "link-rows")
    slack = 1e-6
    fewest = rows.groupBy("pivot").agg(F.min("excess").alias("least"))
    outside = rows.filter("component <> main").join(fewest, "pivot").filter(F.col("excess") + F.col("least") <= slack).drop("least")
    needed = outside.groupBy("pivot").agg(F.min("excess").alias("least"))
    others = rows.join(needed, "pivot").filter(F.col("excess") + F.col("least") <= slack)
    cols = ["id", "n", "excess", "component", *WIDE]
    other = others.select("pivot", *[F.col(c).alias(f"y_{c}") for c in cols], (F.col("component") == F.col("main")).alias("y_main"))
    loss = F.floor((F.col("n") + F.col("y_n")) * share + slack)
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"y_{c}"))).cast("int") for c in WIDE[1:]), F.bit_count(F.col(WIDE[0]).bitwiseXOR(F.col(f"y_{WIDE[0]}"))).cast("int"))
    sizes = F.least("n", "y_n") * 100 >= F.greatest("n", "y_n") * percent
    meet = (F.col("component") != F.col("y_component")) & (F.col("y_main") | (F.col("id") < F.col("y_id"))) & (F.col("excess") + F.col("y_excess") <= slack) & sizes & (apart <= loss)
    found = outside.join(other, "pivot").filter(meet)
    return found.select(F.least("id", "y_id").alias("a"), F.greatest("id", "y_id").alias("b")).distinct()


def link_classes(keys: DataFrame, about: DataFrame, sets_for: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Components (id, component) of the documents whose shingle sets are alike,
    among the pairs that share a key. ``keys``: key, id, n, u, pos, kind and the
    sketch (only key, id and kind count for ``PLAIN`` keys); ``about``: id, n, u and the wide sketch of every
    id; ``sets_for`` gives (id, grams) of a frame of ids."""
    shared = keys.select("key").groupBy("key").count().filter("count > 1").select("key")
    live = stage(keys.join(shared, "key", "left_semi"), "link-live")
    order = F.shiftleft(F.col("u").cast("long"), 40) + F.shiftrightunsigned(F.xxhash64("id"), 24)
    # one row per key, written first: the joins below then stand directly on their shuffles, and Spark can split a frequent key
    pivots = stage(live.groupBy("key").agg(*[F.min_by(c, order).alias(f"y_{c}") for c in ("id", "n", "pos", *SKETCH)]), "link-pivots")
    x, y = F.col, lambda c: F.col(f"y_{c}")
    starred = live.join(pivots, "key").filter(F.col("id") != F.col("y_id"))
    spokes = stage(starred.groupBy("id", F.col("y_id").alias("pivot")).agg(F.max(F.coalesce(_may_link(x, y, percent), F.lit(False))).alias("may")), "link-spokes")
    first = stage(spokes.filter("may").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "link-pairs")
    sets = lambda pairs: sets_for(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    links = stage(verify(first, stage(sets(first), "link-grams"), percent), "link-found")
    pairs = _second_round(spokes.select("id", "pivot"), components(links), about, percent)
    second = stage(stage(pairs, "link-pairs").join(first, ["a", "b"], "left_anti"), "link-pairs")
    return components(links.union(verify(second, stage(sets(second), "link-grams"), percent)))
