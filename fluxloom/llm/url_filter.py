"""URL allow and block lists in a trie over reversed host labels and path segments.

A rule is a host and a path. It fits a url whose host is the rule's or a subdomain of it and whose path starts with
the rule's. Of the rules that fit, the one with the most host labels wins, then the one with the longest path; a rule
given twice keeps its block entry. A url that no rule fits gets the default verdict.

The trie is broadcast. Rules whose text exceeds ``broadcast_bytes`` are joined instead: each host's suffixes meet the
rules by an equi-join and the longest fitting rule is kept, with the same results.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the default unless a rule has
an empty host and path; a host that ends in a dot has an empty last label, which no rule without that dot fits; ports and user names belong to the host as written; repeated rows are judged each; an empty
table gives an empty result; columns named like those added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.llm.words import LOWER, UPPER
from fluxloom.runtime import table


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The fixed rules of the query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


class _Paths:
    """Rules of one host: full segments lead down, the rest of a rule's path is a prefix of the segment after them."""

    __slots__ = ("down", "longest_tail", "tails")

    def __init__(self):
        self.down: dict[str, _Paths] = {}
        self.tails: dict[str, tuple[str, str]] = {}
        self.longest_tail = 0

    def add(self, path: str, entry: tuple[str, str]) -> None:
        node = self
        *full, tail = path.split("/")
        for segment in full:
            node = node.down.setdefault(segment, _Paths())
        if node.tails.get(tail, ("", "allow"))[1] != "block":
            node.tails[tail] = entry
            node.longest_tail = max(node.longest_tail, len(tail))

    def longest(self, path: str) -> tuple[str, str] | None:
        node, found = self, None
        for segment in path.split("/"):
            for n in range(min(len(segment), node.longest_tail), -1, -1) if node.tails else ():
                if (entry := node.tails.get(segment[:n])) is not None:
                    found = entry
                    break
            node = node.down.get(segment)
            if node is None:
                break
        return found


class UrlTrie:
    """Host labels from the last to the first; each node may hold the paths of the rules that end there."""

    def __init__(self, rules: Iterable[UrlRule]):
        self.root: list = [{}, None]
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = _Paths()
            node[1].add(rule.path, (rule.text, rule.verdict))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        node, found = self.root, None
        if not host and node[1] is not None:
            found = node[1].longest(path)
        for label in reversed(host.split(".")) if host else ():
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                found = node[1].longest(path) or found
        return found


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], url_col: str = "url", default: str = "allow", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    added = ("host", "path", "rule", "verdict")
    row = F.struct(*[pages[c] for c in pages.columns if c not in added or c == url_col]).alias("_row")
    rows = pages.select(row, host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    kept = [F.col("_row")[c].alias(c) for c in pages.columns if c not in added]
    if sum(len(r.text.encode()) + 64 for r in rules) > broadcast_bytes:
        return _judge_by_join(rows, rules, default).select(*kept, *added)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        look = trie.value.judge
        found = [look(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return rows.withColumn("told", judged("host", "path")).select(*kept, "host", "path", "told.rule", "told.verdict")


def _judge_by_join(rows: DataFrame, rules: Sequence[UrlRule], default: str) -> DataFrame:
    """The same verdicts for rule lists too large to broadcast.

    Only distinct (host, path) pairs are matched; each gives one key for each suffix of its host.
    """
    spark = rows.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # a host that ends in a dot has an empty last label; the empty rule host fits the empty host only
    suffixes = F.filter(suffixes, lambda x: (x != "") | (F.col("host") == ""))
    keys = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    fits = keys.join(listed, "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = W.partitionBy("host", "path").orderBy(F.length("rule_host").desc(), F.length("rule_path").desc(), F.col("rule_verdict").desc())
    best = fits.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.concat("rule_host", "rule_path").alias("_rule"), "rule_verdict")
    joined = rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return joined.withColumns({"rule": F.col("_rule"), "verdict": F.coalesce("rule_verdict", F.lit(default))}).drop("_h", "_p", "_rule", "rule_verdict")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), judged AS (
  SELECT p.*, (SELECT struct_pack(rule := rule_host || rule_path, verdict := verdict) FROM rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    ORDER BY length(rule_host) DESC, length(rule_path) DESC LIMIT 1) AS j
  FROM parts p
)
SELECT page_id, host, path, j.rule AS rule, coalesce(j.verdict, 'allow') AS verdict FROM judged
"""
