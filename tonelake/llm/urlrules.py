"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions alone.

A rule is a host, a path prefix and a verdict, compiled to a regular expression over host and path. Its literal tokens
are the runs of letters and digits of that pattern that end at a separator on either side; of these the one that the
fewest URLs of the table have becomes its key. A URL's tokens fetch the rules keyed by them (rules without a literal
token are fetched by every URL), and only those run their expressions. Of the rules that fit the longest wins; equal
lengths: the smaller text. Where none fits the verdict is ``default``.

Up to MOST_LITERAL rules the index is a literal in the plan and nothing is shuffled. Beyond, distinct URLs' tokens are
joined with the index, broadcast up to MOST_BROADCAST rules and shuffled otherwise.

A null URL, or one without '://', has empty host and path, fits no rule and gets the default. Repeated rows each get
their verdict. Other columns are kept, but for those named host, path, rule or verdict; an empty table or an empty rule list is fine.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import table, unused

MOST_LITERAL = 2000
MOST_BROADCAST = 200_000
_SEPARATOR = r"[^\p{L}\p{N}]+"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host and path, of which only the path has slashes."""
        return rf"(?s)^([^/]*\.)?{re.escape(self.host)}{re.escape(self.path) or "(?=/|$)"}"

    @property
    def tokens(self) -> list[str]:
        """Those that every URL the rule fits has whole: the path's last one isn't, unless a separator ends it."""
        host, path = re.split(r"[\W_]+", self.host), re.split(r"[\W_]+", self.path)
        return [t for t in [*host, *path[:-1]] if t]


#: The rules of the registered query.
RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def host(url: str) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keyed(subjects: DataFrame, rules: Sequence[Rule]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token, '' for those without one; counts tokens over all of ``_tokens``."""
    literal = sorted({t for r in rules for t in r.tokens})
    have: dict[str, int] = {}
    if literal:
        of = F.explode(F.array_intersect("_tokens", F.array(*[F.lit(t) for t in literal])))
        have = {r["t"]: r["count"] for r in subjects.select(of.alias("t")).groupBy("t").count().collect()}  # a row per rule token
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (have.get(t, 0), t), default=""), []).append(i)
    return index


def judged(df: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict."""
    df = df.drop(*[c for c in ("rule", "verdict") if c != url]).withColumns({"host": host(url), "path": path(url)})
    tokens_, subject_, rules_, first_ = unused(df.columns, "_tokens", "_subject", "_rules", "_first")
    subject = F.concat("host", "path")
    tokens = F.array_distinct(F.split(subject, _SEPARATOR))
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    ranked = sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.verdict))  # the first that fits wins
    index = keyed(df.select(tokens.alias("_tokens")), ranked)
    if len(ranked) <= MOST_LITERAL:
        by = F.create_map(*[x for t, of in index.items() if t for x in (F.lit(t), F.array(*map(F.lit, of)))]) if set(index) - {""} else None
        always = F.array(*map(F.lit, index.get("", []))).cast("array<int>")
        none = F.array().cast("array<int>")
        got = F.flatten(F.transform(tokens_, lambda t: F.coalesce(by[t], none))) if by is not None else none
        df = df.withColumns({tokens_: tokens, subject_: subject}).withColumn(rules_, F.array_sort(F.array_distinct(F.concat(got, always))))
        patterns = F.array(*[F.lit(r.pattern) for r in ranked])
        fits = F.filter(rules_, lambda i: F.rlike(F.col(subject_), patterns[i]))
        df = df.withColumn(first_, F.coalesce(F.get(fits, 0), F.lit(-1))).drop(tokens_, subject_, rules_)
        names = {c: F.get(F.array(*[F.lit(getattr(r, c)) for r in ranked]), F.col(first_)) for c in ("text", "verdict")}
        return df.withColumns({"rule": names["text"], "verdict": F.coalesce(names["verdict"], F.lit(default))}).drop(first_)
    at = df.sparkSession.createDataFrame([(t, i, ranked[i].pattern, ranked[i].text, ranked[i].verdict) for t, of in index.items() for i in of], "t string, i int, pattern string, rule string, found string")
    at = F.broadcast(at) if len(ranked) <= MOST_BROADCAST else at
    urls = df.select("host", "path").distinct()
    found = urls.withColumn("t", F.explode(F.array_distinct(F.concat(tokens, F.array(F.lit("")))))).join(at, "t").where(F.expr("rlike(concat(host, path), pattern)"))
    h_, p_, text_, verdict_ = unused([*df.columns, "rule", "verdict"], "_host", "_path", "_text", "_found")
    first = found.groupBy(F.col("host").alias(h_), F.col("path").alias(p_)).agg(F.min(F.struct("i", "rule", "found")).alias("m")).select(h_, p_, F.col("m.rule").alias(text_), F.col("m.found").alias(verdict_))
    judged_ = df.join(first, (F.col("host") == F.col(h_)) & (F.col("path") == F.col(p_)), "left")
    return judged_.select(*df.columns, F.col(text_).alias("rule"), F.coalesce(F.col(verdict_), F.lit(default)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


ORACLE = """
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, q, verdict)),
f AS (SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST, h || q) AS n
    FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
