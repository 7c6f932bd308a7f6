"""Allow and block rules on URLs, judged by a trie.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case. Path: from there up to ``?``, ``#`` or the end. A null URL, or one without
``://``, has an empty host and path and meets no rule.

A rule fits its host and all subdomains if the URL's path starts with the
rule's. The rule with more host labels wins, then the one with the longer path;
between an allow and a block rule for the same place, block wins. A URL that no
rule fits gets the default verdict and a null rule.

Repeated rows are judged alike, one row each. Only the key columns and the URL
are read, so other columns of any name do no harm. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import LOWER, UPPER, ascii_lower

ALLOW, BLOCK = "allow", "block"

# The rules are sent to every executor, and each task builds the trie from
# them. Larger rule sets are joined instead.
MOST_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, place: str) -> Rule:
        """``Rule.of("block", "example.com/en/")``"""
        host, slash, rest = place.partition("/")
        host = host.translate(str.maketrans(UPPER, LOWER))
        if not host or verdict not in (ALLOW, BLOCK):
            raise ValueError(f"not a rule: {verdict} {place}")
        return cls(verdict, host, slash + rest)

    @property
    def place(self) -> str:
        return self.host + self.path


@dataclass
class PathNode:
    """Reached by whole path segments; ``tails`` are the unfinished last ones."""

    segments: dict[str, PathNode] = field(default_factory=dict)
    tails: dict[str, Rule] = field(default_factory=dict)


@dataclass
class HostNode:
    """Reached by host labels from the right."""

    labels: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode = field(default_factory=PathNode)


def build_trie(rules: Iterable[Rule]) -> HostNode:
    root = HostNode()
    for rule in rules:
        host = root
        for label in reversed(rule.host.split(".")):
            host = host.labels.setdefault(label, HostNode())
        *whole, tail = rule.path.split("/")
        node = host.paths
        for segment in whole:
            node = node.segments.setdefault(segment, PathNode())
        held = node.tails.get(tail)
        if held is None or rule.verdict == BLOCK:
            node.tails[tail] = rule
    return root


def longest_on_path(node: PathNode, path: str) -> Rule | None:
    best = None
    *whole, last = path.split("/")
    for depth, segment in enumerate([*whole, last]):
        fitting = [tail for tail in node.tails if segment.startswith(tail)]
        if fitting:
            best = node.tails[max(fitting, key=len)]
        if depth == len(whole) or segment not in node.segments:
            break
        node = node.segments[segment]
    return best


def longest_match(root: HostNode, host: str, path: str) -> Rule | None:
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        best = longest_on_path(node.paths, path) or best
    return best


def host_and_path(df: DataFrame, keys: Sequence[str], url: str) -> DataFrame:
    """The key columns, ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return df.select(
        *[F.col(k) for k in keys],
        ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def judge(
    df: DataFrame,
    rules: Sequence[Rule],
    keys: Sequence[str],
    url: str = "url",
    default: str = ALLOW,
    most_broadcast_rules: int = MOST_BROADCAST_RULES,
) -> DataFrame:
    """Key columns, host, path, rule and verdict of every row."""
    if len(rules) > most_broadcast_rules:
        return judge_by_join(df, rules, keys, url, default)
    listed = [(r.verdict, r.host, r.path) for r in rules]
    sent = df.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = build_trie(Rule(*rule) for rule in sent.value)
        for hosts, paths in parts:
            found = [longest_match(trie, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(
                {
                    "rule": [r.place if r else None for r in found],
                    "verdict": [r.verdict if r else default for r in found],
                },
                dtype=object,
            )

    placed = host_and_path(df, keys, url)
    return placed.withColumn("_judged", judged("host", "path")).select(
        *placed.columns, "_judged.rule", "_judged.verdict"
    )


def judge_by_join(
    df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], url: str = "url", default: str = ALLOW
) -> DataFrame:
    """The same verdicts for rule sets too large to send to every executor.

    Each distinct place meets the rules of its host's few suffixes.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame(
        [(r.host, r.path, r.verdict, r.place) for r in rules],
        "_rule_host string, _rule_path string, verdict string, rule string",
    )
    placed = host_and_path(df, keys, url)
    places = placed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = places.select(
        "host",
        "path",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
            )
        ).alias("_drop", "_rule_host"),
    )
    rank = Window.partitionBy("host", "path").orderBy(
        "_drop", F.length("_rule_path").desc(), F.col("verdict").desc()
    )
    best = (
        suffixes.join(listed, "_rule_host")
        .where(F.col("path").startswith(F.col("_rule_path")))
        .withColumn("_rank", F.row_number().over(rank))
        .where("_rank = 1")
        .select("host", "path", "rule", "verdict")
    )
    return placed.join(best, ["host", "path"], "left").select(
        *placed.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
