"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

Base spans are found by patterns (email, ip, card, phone). Each found value is
a protected entity; all words of the texts that hold it are its candidate
terms. With N distinct texts, n_e of them holding the entity, n_t the term and n_et both,

    PMI(e; t) = log2(n_et * N / (n_e * n_t)),  disclosure = PMI(e; t) / log2(N / n_et)

is 1 for a term that stands in exactly the entity's texts, and less the fewer of
them have it or the more others do, so that neither a chance word of one text of a frequent entity
nor a common word reaches it, while rare entities count like others. A few co-occurrences are
no estimate: every rare word of a text stands in just its texts. So the share of terms that chance alone
would put there is bounded, too. With V terms of the corpus as frequent as t (within a power
of two) and the entity's texts holding a share p of all (text, word) pairs,

    chance = V * exp(-n_t * KL(n_et / n_t || p)) / (terms of that frequency that disclose the entity)

must be at most ``CHANCE``: the rare words of one text are as many as rare words of any text, so they
stay, unless texts without the value have hardly any. Terms whose disclosure
reaches ``GENERALISE`` are generalised wherever they stand in the entity's texts, from
``REMOVE`` on removed. Copies of a text are no evidence.

Values with the same set of texts (an address list) are one entity, so one long text costs
its values plus its words, not their product.

DataFrame functions only. Word counts combine before the shuffle; terms too common to
reach ``GENERALISE`` for any entity are left out before they are paired with entities, which loses none.

Defined cases: null text is empty and has no spans. Null ids and rows that
repeat an id are judged each by their own text. Empty input gives an empty
result. Extra columns are ignored by ``find`` and kept by ``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reactorlake.llm.common import stage, table, text_of

# Patterns match what the contract's do, written so that Java needs no recursion or rescans on long runs.
_NAME, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++@{_LABEL}++\.{_LABEL}(?:(?!\.(?!{_LABEL}))[A-Za-z0-9.-])*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![ -](?![0-9]))[0-9 -])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
GENERALISE, REMOVE = 0.75, 0.95
#: Largest share of an entity's terms that may be there by chance.
CHANCE = 0.1
#: Matches whose places are summed in one go; the rest of long lists is handled block by block.
BLOCK = 256
SPLIT_WORDS = r"[^\p{L}\p{N}]+"
A_WORD = r"[\p{L}\p{N}]+"
_SPAN = "struct<start:int,stop:int,value:string>"


def _located(text: Column, pattern: str) -> Column:
    """All matches with their places (code points, end exclusive)."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("value")))).alias("spans"))

    def block(acc: Column, i: Column) -> Column:
        part = F.aggregate(F.slice(both, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), none.alias("spans")), add)
        return F.struct(part["at"].alias("at"), F.concat(acc["spans"], part["spans"]).alias("spans"))

    none = F.array().cast(f"array<{_SPAN}>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    return F.when(F.size(found) > 0, F.aggregate(blocks, empty, block)["spans"]).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i + 1, F.lit(1)).cast("int")
        doubled = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(i % 2 == 1, doubled).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans per kind; a cheap test first spares most texts the search."""
    check = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda s: F.when(F.length(_digits(s["value"])).between(16, 19), _luhn(s["value"])).otherwise(False),
        "phone": lambda s: F.length(_digits(s["value"])).between(8, 15),
    }
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    return {k: F.when(may[k], F.filter(_located(text, p), check[k])).otherwise(F.array().cast(f"array<{_SPAN}>")) for k, p in PATTERNS.items()}


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))


def _found(rows: DataFrame) -> DataFrame:
    """id, key, the base spans per kind, the distinct values (entities) and, where there are any, the text."""
    spans = rows.withColumns(base_spans(F.col("text")))

    def values(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: _entity(kind, s["value"]))

    spans = spans.withColumn("entities", F.array_distinct(F.concat(*[values(k) for k in PATTERNS])))
    return spans.select("id", "key", *PATTERNS, "entities", F.when(F.size("entities") > 0, F.col("text")).alias("text"))


def _terms(text: str) -> Column:
    words = F.transform(F.split(text, SPLIT_WORDS), lambda w: F.lower(w))
    return F.explode(F.filter(F.array_distinct(words), lambda w: w != "")).alias("term")


def _disclosure(n_et: Column, n_e: Column, n_t: Column, n: Column) -> Column:
    return F.log2(n_et * n / (n_e * n_t)) / F.greatest(F.log2(n / n_et), F.lit(1e-9))


def _entities(values: DataFrame) -> DataFrame:
    """entity, c1, c2 (128 bits of its set of texts), n_e and width (words of these texts) of
    every value (key, entity, n_words)."""
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"c{i}") for i in (1, 2)]
    return values.groupBy("entity").agg(*marks, F.count("*").alias("n_e"), F.sum("n_words").alias("width"))


def disclosing(rows: DataFrame, held: DataFrame) -> DataFrame:
    """key, term, disclosure of the terms that reach ``GENERALISE`` for a value of their text, and not by chance."""
    total = max(rows.select("key").distinct().count(), 1)
    n = F.lit(float(total))
    words = stage(rows.dropDuplicates(["key"]).select(_terms("text")).groupBy("term").agg(F.count("*").alias("n_t")), "pii-words")
    size = F.floor(F.log2("n_t")).cast("int")
    sizes = words.groupBy(size.alias("size")).agg(F.count("*").alias("v"), F.sum("n_t").alias("tokens")).collect()  # a row per power of two
    tokens = F.lit(float(max(sum(r.tokens for r in sizes), 1)))
    kinds = F.create_map(*[F.lit(x) for r in sizes for x in (r["size"], float(r.v))]) if sizes else F.create_map(F.lit(0), F.lit(0.0))
    listed = F.filter(F.array_distinct(F.split("text", SPLIT_WORDS)), lambda w: w != "")
    values = held.select("key", F.size(listed).alias("n_words"), F.explode("entities").alias("entity"))
    entities = stage(_entities(values), "pii-entities")
    most = entities.agg(F.max("n_e")).first()[0] or 0
    # with n_et = min(n_e, n_t), the most that a term can disclose
    bound = _disclosure(F.least("n_e", "n_t"), F.col("n_e"), F.col("n_t"), n) >= GENERALISE - 1e-9
    rarest = total ** (1 - GENERALISE) * most**GENERALISE  # the bound, solved for n_t at the largest n_e
    terms = held.select("key", _terms("text")).join(words.filter(F.col("n_t") <= rarest * (1 + 1e-9)), "term")
    classes = values.select("key", "entity").join(entities, "entity").select("key", "c1", "c2", "n_e", "width").distinct()
    pairs = stage(terms.join(classes, "key").filter(bound), "pii-pairs")
    counted = pairs.groupBy("c1", "c2", "term").agg(F.count("*").alias("n_et"), *[F.first(c).alias(c) for c in ("n_e", "n_t", "width")])
    told = counted.withColumn("disclosure", _disclosure(F.col("n_et"), F.col("n_e"), F.col("n_t"), n)).filter(F.col("disclosure") >= GENERALISE)
    told = told.withColumn("size", size).withColumn("alike", F.count("*").over(Window.partitionBy("c1", "c2", "size")))
    share, p = F.col("n_et") / F.col("n_t"), F.col("width") / tokens
    rest = F.when(F.col("n_et") < F.col("n_t"), (1 - share) * F.log((1 - share) / F.greatest(1 - p, F.lit(1e-12)))).otherwise(0.0)
    luck = F.when(share > p, F.exp(-F.col("n_t") * (share * F.log(share / p) + rest))).otherwise(1.0)
    told = told.filter(F.try_element_at(kinds, F.col("size")) * luck <= CHANCE * F.col("alike"))
    return pairs.select("key", "c1", "c2", "term").join(told.select("c1", "c2", "term", "disclosure"), ["c1", "c2", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, key (of its text), email, ip, card, phone (span arrays), term (spans with ``action``)."""
    rows = _rows(docs, id_col, text_col)
    found = stage(_found(rows), "pii-found")
    held = found.filter("text IS NOT NULL").select("key", "entities", "text").dropDuplicates(["key"])
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    told = disclosing(rows, held).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("term"), action.alias("action")))).alias("told"))
    words = F.transform(_located(F.col("text"), A_WORD), lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop"), F.try_element_at("told", F.lower(w["value"])).alias("action")))
    terms = held.join(told, "key").select(F.col("key").alias("t_key"), F.filter(words, lambda w: w["action"].isNotNull()).alias("term"))
    out = found.drop("entities", "text").join(terms, F.col("key") == F.col("t_key"), "left").drop("t_key")
    none = F.array().cast("array<struct<start:int,stop:int,action:string>>")
    # a term that a base span covers is taken out with it
    spans = F.concat(*PATTERNS)
    free = F.filter(F.coalesce("term", none), lambda t: ~F.exists(spans, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    return out.withColumn("term", free)


def _listed(kinds: tuple[str, ...]) -> Column:
    def name(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))

    return F.concat_ws(",", F.concat(*[name(k) for k in kinds]))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with base spans replaced by their kind, revealing terms
    generalised to ``[WORD]`` or removed; other columns as they are."""
    marks = find(docs, id_col, text_col)

    def cuts(kind: str, put: Callable[[Column], Column]) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), put(s).alias("put")))

    plain = [cuts(k, lambda s, put=f"[{k.upper()}]": F.lit(put)) for k in PATTERNS]
    told = cuts("term", lambda s: F.when(s["action"] == "remove", F.lit("")).otherwise(F.lit("[WORD]")))
    marks = marks.select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), F.array_sort(F.concat(*plain, told)).alias("cuts")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    both = rows.join(marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        inner = F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], gap, s["put"]).alias("out"))
        return F.when(s["start"] >= acc["at"], inner).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    clean = F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text")))
    return both.select(F.col("row").withField(text_col, F.when(F.size("cuts") > 0, clean).otherwise(F.col("row")[text_col])).alias("row")).select("row.*")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    base = tuple(PATTERNS)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))
