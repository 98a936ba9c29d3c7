"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
that every address it matches must hold (runs of [a-z0-9] bounded by other
characters). Tokens are counted over the table's distinct addresses, each rule
is filed under its rarest token, the tokens of an address fetch the rules filed
under them, and only those run their regular expression. Listed host/path rules
come before free patterns; the longest listed rule wins.

DataFrame functions only. Rules are a given list; their table is broadcast only
up to ``BROADCAST_RULES`` rules and joined by a shuffle beyond. Verdicts are
found once per distinct address, so a repeated address costs one row.

Defined cases: a null address or one without ``://`` has empty host and path,
fits no rule and is allowed. Rows repeating a page id are judged each. Empty
input gives an empty result. Extra columns are ignored. A rule without a usable token is
tried on every address.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import table

BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains and a path prefix. The last token counts only if it is bounded."""
    tokens = re.findall("[a-z0-9]+", host)
    parts = re.findall("[a-z0-9]+", path.lower())
    if path and path[-1:].isalnum():
        parts = parts[:-1]
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens + parts), True)


def word_pattern(verdict: str, word: str) -> Rule:
    """A whole word in the host."""
    return Rule(f"host-word:{word}", verdict, rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|$)", (word,), False)


_SEPARATOR = r"(?:[^a-z0-9._%-]|$)"


def parse_rule(line: str) -> Rule | None:
    """A rule of a filter list, or None for blank lines, comments (``!``) and headings (``[``).

    ``*`` stands for any characters, ``^`` for a separator (not one of ``a-z0-9._%-``) or the end, ``||`` before the pattern for
    the start of the host or of one of its labels, ``|`` before or behind it for the address's start or end,
    ``@@`` for an allowed address. Letters match in either case. The index tokens come from
    the pattern: its literal runs of ``[a-z0-9]`` that no matching address can continue.
    """
    text = line.strip()
    if not text or text[0] in "![":
        return None
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    host, start = body.startswith("||"), body.startswith("|")
    body = body[2:] if host else body[1:] if start else body
    end = body.endswith("|")
    body = re.sub(r"\*+", "*", body[:-1] if end else body).lower()
    if not body.strip("*"):
        return None
    regex = "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c) for c in body)
    before = r"^(?:[^/]*\.)?" if host else "^" if start else ""
    tokens = []
    for m in re.finditer("[a-z0-9]+", body):
        opened = host or start if m.start() == 0 else body[m.start() - 1] != "*"
        closed = end if m.end() == len(body) else body[m.end()] != "*"
        if opened and closed:
            tokens.append(m[0])
    return Rule(text, verdict, f"(?is){before}{regex}{'$' if end else ''}", tuple(dict.fromkeys(tokens)), False)


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """The distinct rules of a filter list."""
    return list({r.name: r for r in map(parse_rule, lines) if r is not None}.values())


#: The contract's list, then patterns of unwanted hosts.
RULES = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
    *(word_pattern("block", w) for w in ("casino", "bets", "poker", "adserver", "porn", "viagra")),
    Rule("host-word:ads-track", "block", r"^(?:[^/]*[^a-z0-9/])?ads-track(?:er|ing)?(?:[^a-z0-9]|$)", ("ads",), False),
)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return _ascii_lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.name, r.verdict, r.regex, list(r.tokens) or [""], r.listed) for r in rules]
    return spark.createDataFrame(rows, "name string, verdict string, regex string, tokens array<string>, listed boolean")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (listed ones only), verdict, pattern (the free pattern that decided)."""
    spark = pages.sparkSession
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    key = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = parts(F.col("__url"))
    urls = pages.select(key.alias("__url")).distinct().select("__url", F.concat(host, path).alias("subject"))
    tokens = F.array_distinct(F.split(_ascii_lower(F.col("subject")), "[^a-z0-9]+"))
    if any(not r.tokens for r in rules):
        tokens = F.array_union(tokens, F.array(F.lit("")))
    found = urls.select("__url", "subject", F.explode(tokens).alias("token"))

    wanted = _rules_frame(spark, rules).withColumn("token", F.explode("tokens"))
    seen = found.join(small(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = wanted.join(seen, "token", "left").groupBy("name", "verdict", "regex", "listed").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    hits = found.join(small(rarest), "token").filter("subject rlike regex")
    best = F.struct("listed", F.when(F.col("listed"), F.length("name")).otherwise(0).alias("long"), "name", "verdict")
    verdicts = hits.groupBy("__url").agg(F.max(best).alias("hit"))

    host, path = parts(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"), key.alias("__url"))
    listed = F.col("hit.listed")
    return base.join(verdicts, "__url", "left").select(
        F.col("__id").alias(id_col), "host", "path", F.when(listed, F.col("hit.name")).alias("rule"),
        F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"), F.when(~listed, F.col("hit.name")).alias("pattern"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 l(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
 w(word) AS (VALUES ('casino'), ('bets'), ('poker'), ('adserver'), ('porn'), ('viagra'), ('ads-track'), ('ads-tracker'), ('ads-tracking')),
 m AS (SELECT p.page_id, max(struct_pack(n := length(l.host || l.path), rule := l.host || l.path, verdict := l.verdict)) AS hit
       FROM p JOIN l ON (p.host = l.host OR ends_with(p.host, '.' || l.host)) AND starts_with(p.path, l.path) GROUP BY p.page_id),
 x AS (SELECT p.page_id, max('host-word:' || CASE WHEN w.word LIKE 'ads-%' THEN 'ads-track' ELSE w.word END) AS pattern
       FROM p JOIN w ON regexp_matches(p.host, '(^|[^a-z0-9])' || w.word || '([^a-z0-9]|$)') GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.hit.rule AS rule, coalesce(m.hit.verdict, CASE WHEN x.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN m.page_id IS NULL THEN x.pattern END AS pattern
FROM p LEFT JOIN m USING (page_id) LEFT JOIN x USING (page_id)
"""
