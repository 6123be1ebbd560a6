"""URL block and allow rules by a sort-merge range join.

The key of a host is its labels reversed, each ended by a dot ("a.b.net": "net.b.a."), so a host and all its subdomains are one
interval of sorted keys: those that begin with the rule's key. The paths that begin with a rule's path are an interval of sorted
paths in the same way. Intervals of prefixes nest or are apart, so sorted rules with a pointer from each to the one around it are
the stack of rules that are active at any place. Rows are sorted by key and path within their task and merged with the sorted
rule keys in one sweep; where the key changes, the stack of active rule hosts is renewed, the narrowest on top, and in each the narrowest
path interval around the row's path is found by a binary search. The first from the top that has one wins, which is the longest rule:
more host labels first, then the longer path.

The rules are a driver-side list. A sweep broadcasts at most RULES_AT_ONCE of them (some 100 MB at worst); a longer list takes
several sweeps, each of which keeps the longer of its own winner and the one before. No rows are shuffled, so a hot host is
no hot key.

Results for odd inputs: a null url, or one without "://", has an empty host and path, no rule and the default verdict; an empty
path begins with no rule's path; equal rules: the one listed first; no rules: all rows get the default; repeated rows keep a row
each; urls of any length are judged whole; an empty table gives no rows. Only the id and url columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES_AT_ONCE = 500_000
#: Host key, path, the rule as it was given, verdict.
Rule = tuple[str, str, str, str]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


class Nested:
    """Sorted prefixes with a value each, and for each the place of the nearest prefix that it begins with (-1: none)."""

    def __init__(self, values: dict[str, object]):
        self.prefixes = sorted(values)
        self.values = [values[p] for p in self.prefixes]
        self.around, stack = [], []
        for k, p in enumerate(self.prefixes):
            while stack and not p.startswith(self.prefixes[stack[-1]]):
                stack.pop()
            self.around.append(stack[-1] if stack else -1)
            stack.append(k)

    def last(self, text: str, low: int = 0) -> int:
        """How many prefixes are not after text; low: of which so many are known not to be."""
        return bisect_right(self.prefixes, text, low)

    def active(self, text: str, before: int) -> Iterator:
        """The values of all prefixes that text begins with, the longest first. before: last(text)."""
        k = before - 1
        while k >= 0:
            if text.startswith(self.prefixes[k]):
                yield self.values[k]
            k = self.around[k]


def nested(rules: Sequence[Rule]) -> Nested:
    """Rules by host key, and under each by path; of equal rules the first."""
    hosts: dict[str, dict[str, Rule]] = {}
    for rule in rules:
        if rule[0]:
            hosts.setdefault(rule[0], {}).setdefault(rule[1], rule)
    return Nested({key: Nested(paths) for key, paths in hosts.items()})


class Sweep:
    """The rule of each row of a task, in the order of keys."""

    def __init__(self, rules: Nested):
        self.rules, self.at, self.key, self.stack = rules, 0, None, []

    def rule(self, key: str, path: str) -> Rule | None:
        if key != self.key:
            self.at = self.rules.last(key, self.at)
            self.key, self.stack = key, list(self.rules.active(key, self.at))
        return next((rule for paths in self.stack for rule in paths.active(path, paths.last(path))), None)


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", at_once: int = RULES_AT_ONCE) -> DataFrame:
    """id, host, path, rule, verdict of every url. rules: (verdict, "host/path")."""
    split = [(verdict, *rule.partition("/")) for verdict, rule in rules]
    parsed = sorted(((host_key(host.lower()), slash + path, f"{host}{slash}{path}", verdict) for verdict, host, slash, path in split), key=lambda r: r[:2])
    url = F.col(url_col).cast("string")
    rows = urls.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    rows = rows.withColumns({"key": F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(labels, "."), F.lit("."))), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "rank": F.lit(-1).cast("long")})
    rows = rows.sortWithinPartitions("key", "path")
    for k in range(0, len(parsed), at_once):
        shared = urls.sparkSession.sparkContext.broadcast(nested(parsed[k : k + at_once]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sweep = Sweep(shared.value)  # one for all batches of a task
            for batch in batches:
                best = map(sweep.rule, batch["key"].tolist(), batch["path"].tolist())
                old = zip(batch["rule"].tolist(), batch["verdict"].tolist(), batch["rank"].tolist())
                new = [o if b is None or (r := b[0].count(".") << 32 | len(b[1])) <= o[2] else (b[2], b[3], r) for b, o in zip(best, old)]
                yield batch.assign(rule=[r[0] for r in new], verdict=[r[1] for r in new], rank=[r[2] for r in new])

        rows = rows.mapInPandas(run, rows.schema)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
