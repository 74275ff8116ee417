"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix; ``*`` in the path stands for any run of
characters.  Each rule is filed under one literal token that every url it fits
must contain: the one that fewest rules hold.  A url's tokens fetch candidate
rules from that index, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, record

#: Up to so many rules the index is a literal inside the plan; beyond, it is a joined table.
INLINE_RULES = 256
WORD = "[^A-Za-z0-9]+"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        literal = [re.sub(r"([^A-Za-z0-9])", r"\\\1", p) for p in self.path.split("*")]
        return r"(?s)^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9])", r"\\\1", self.host) + ".*".join(literal)

    def tokens(self) -> list[str]:
        """Tokens that stand whole in any url the rule fits: a cut-off word at the end of the path or beside ``*`` may go on."""
        whole = re.split(WORD, re.sub(r"[A-Za-z0-9]*\*[A-Za-z0-9]*", "*", re.sub(r"[A-Za-z0-9]+$", "", self.path)))
        return [t for t in [*re.split(WORD, self.host), *whole] if t]


def index(rules: list[Rule]) -> list[tuple[str, Rule]]:
    """``(token, rule)``: each rule under its rarest token; of equally rare ones the longest, then the first by spelling."""
    held = Counter(t for r in rules for t in set(r.tokens()))
    return [(min(r.tokens(), key=lambda t: (held[t], -len(t), t), default=""), r) for r in rules]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(address: Column) -> Column:
    """Distinct tokens, and the empty one, which fetches rules that have no literal token."""
    return F.array_union(F.array(F.lit("")), F.split(address, WORD))


def _entry(regex, length, text, verdict):
    """Ordered so that the largest is the rule that wins: longest text, then longest host (as the regex's), then spelling."""
    return F.struct(length.alias("length"), text.alias("rule"), verdict.alias("verdict"), regex.alias("regex"))


def _best_inline(address: Column, filed: list[tuple[str, Rule]]) -> Column:
    by_token: dict[str, list[Column]] = {}
    for token, r in filed:
        by_token.setdefault(token, []).append(_entry(F.lit(r.regex()), F.lit(len(r.text)), F.lit(r.text), F.lit(r.verdict)))
    table = F.create_map(*[x for t, rules in by_token.items() for x in (F.lit(t), F.array(*rules))])
    known = F.array(*[F.lit(t) for t in by_token])
    fetched = F.flatten(F.transform(F.array_intersect(url_tokens(address), known), lambda t: F.element_at(table, t)))
    return F.array_max(F.filter(fetched, lambda r: F.regexp_like(address, r["regex"])))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url") -> DataFrame:
    """``rec`` (the whole row), ``host``, ``path``, ``rule``, ``verdict`` for every row.

    A null url, or one without ``://``, has empty host and path and gets the
    default verdict.  A rule fits its host and the host's subdomains; the
    longest that fits wins, ties going to the later spelling.  Repeated rows are
    judged alike; an empty table gives an empty result; other columns stay in
    ``rec``.  With no rules every row gets the default.
    """
    url = F.col(f"`{url_col}`")
    base = pages.select(record(pages).alias("rec"), host_of(url).alias("host"), path_of(url).alias("path"))
    address = F.concat("host", "path")
    filed = index(rules)
    if not filed:
        found = base.withColumn("best", F.lit(None).cast("struct<rule:string,verdict:string>"))
    elif len(filed) <= INLINE_RULES:
        found = base.withColumn("best", _best_inline(address, filed))
    else:
        found = _best_joined(base, address, filed)
    return found.select("rec", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _best_joined(base: DataFrame, address: Column, filed: list[tuple[str, Rule]]) -> DataFrame:
    """For long rule lists: distinct addresses meet the index in an equi-join on the token."""
    spark = base.sparkSession
    table = spark.createDataFrame([(t, r.regex(), len(r.text), r.text, r.verdict) for t, r in filed], "token string, regex string, length int, rule string, verdict string")
    distinct = base.select(address.alias("address")).distinct()
    hits = distinct.select("address", F.explode(url_tokens(F.col("address"))).alias("token")).join(table, "token").where("regexp_like(address, regex)")
    best = hits.groupBy("address").agg(F.max(F.struct("length", "rule", "verdict")).alias("best"))
    return base.withColumn("address", address).join(best, "address", "left").drop("address")
