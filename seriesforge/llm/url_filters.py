"""URL filters: pattern rules indexed by their rarest literal token.

Rules are regular expressions with the literal tokens that every match must contain.  Each rule
is filed under the one of its tokens that the fewest URLs of the corpus have (ties: the longer,
then the smaller token); rules without a token are always candidates.  A URL's tokens fetch
candidate rules, and only those run their regular expressions.

A host and path rule fits its host and all subdomains if the path starts with the rule's.  Of
the rules that fit, the longest wins (ties: the longer host, then the smaller rule).

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no rule
and gets the default verdict, as does any URL that no rule fits; hosts and paths may hold any
other character, line feeds too; repeated rows are judged each; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import map_batches

ALLOW, BLOCK = "allow", "block"
#: Rules are shipped to the executors as one broadcast value of at most this many characters; larger sets are split.
RULE_SET_CHARS = 50_000_000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """For a URL's host and path with a slash between, which no host has."""
        return r"\A(?:[^/]*\.)?" + re.escape(self.host) + "/" + re.escape(self.path)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens of every URL that fits: those of the host, and of the path but for a cut one at its end."""
        path = _TOKEN.findall(self.path)
        if path and _TOKEN.search(self.path[-1:]):
            path = path[:-1]
        return [t for t in dict.fromkeys(_TOKEN.findall(self.host) + path) if t]


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, pattern, 1), upper, lower), F.regexp_extract(url, pattern, 2)


def token_frequencies(parts: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all of them."""
    found = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "host", "path"), F.lit(f"({_TOKEN.pattern})"), 1))
    wanted = parts.sparkSession.createDataFrame([(t,) for t in tokens], "token string")  # as many as the rules have
    counts = parts.select(F.explode(found).alias("token")).groupBy("token").count().join(wanted, "token", "left_semi")
    return {r["token"]: r["count"] for r in counts.collect()}


class RuleIndex:
    def __init__(self, rules: Sequence[Rule], frequencies: dict[str, int]):
        self.always: list[Rule] = []
        self.by_token: dict[str, list[Rule]] = {}
        self._compiled: dict[Rule, re.Pattern] = {}
        for rule in rules:
            if tokens := rule.tokens:
                rarest = min(tokens, key=lambda t: (frequencies.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(rule)
            else:
                self.always.append(rule)

    def judge(self, host: str, path: str) -> Rule | None:
        if not host and not path:
            return None
        text, best = f"{host}/{path}", None
        tokens = set(_TOKEN.findall(text))
        for rule in [*self.always, *(r for t in tokens & self.by_token.keys() for r in self.by_token[t])]:
            order = (-len(rule.name), -len(rule.host), rule.name, rule.verdict)
            if best is None or order < best[0]:
                if (pattern := self._compiled.get(rule)) is None:
                    pattern = self._compiled[rule] = re.compile(rule.pattern)
                if pattern.match(text):
                    best = order, rule
        return best and best[1]


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = ALLOW, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rules = list(dict.fromkeys(rules))
    shards, size = [[]], 0
    for rule in rules:
        if size > RULE_SET_CHARS:
            shards.append([])
            size = 0
        shards[-1].append(rule)
        size += len(rule.name)
    frequencies = token_frequencies(parts, sorted({t for r in rules for t in r.tokens}))
    out = parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "rule_host": F.lit(0)})
    for shard in shards:
        out = _apply(out, RuleIndex(shard, frequencies))
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _apply(parts: DataFrame, index: RuleIndex) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for host, path, rule, verdict, rule_host in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rule", "verdict", "rule_host"))):
                found = index.judge(host, path)
                if found and (rule is None or (-len(found.name), -len(found.host), found.name, found.verdict) < (-len(rule), -rule_host, rule, verdict)):
                    rule, verdict, rule_host = found.name, found.verdict, len(found.host)
                rows.append((rule, verdict, rule_host))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], batch.schema.names)

    return map_batches(parts, run, parts.schema)
