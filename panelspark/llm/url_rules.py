"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and path rule or a pattern (regular expression). Every rule names literal tokens (runs of
letters and digits) that a fitting URL must contain whole; it is filed under the token that the fewest URLs
contain, counted over the whole table. A URL's tokens fetch the rules filed under them, and only those are
tested. Rules without a certain token are tested always.

Cases: a null URL, or one without "://", has an empty host and path, fits no host rule and is tested by
patterns on its text; repeated rows get equal results; an empty table gives none. Other columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile("[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ADDRESS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


@dataclass(frozen=True)
class HostRule:
    """Fits its host and subdomains where the path begins with the rule's."""
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> set[str]:
        # the path is a prefix, so its last run counts only if something ends it
        return set(TOKEN.findall(self.host.translate(LOWER))) | set(re.findall("[a-z0-9]+(?=[^a-z0-9])", self.path.translate(LOWER)))

    def fits(self, host: str, path: str, url: str) -> bool:
        return path.startswith(self.path) and (host == self.host or host.endswith("." + self.host))


@dataclass(frozen=True)
class PatternRule:
    """Fits a URL (A-Z lower-cased) where `regex` is found; `literals` are tokens it can't do without."""
    verdict: str
    regex: str
    literals: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.regex

    def tokens(self) -> set[str]:
        return set(self.literals)

    def fits(self, host: str, path: str, url: str) -> bool:
        return re.search(self.regex, url) is not None


def split_url(url: str | None) -> tuple[str, str]:
    m = ADDRESS.search(url) if url else None
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def token_counts(df: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """URLs that contain each of the rules' tokens: one aggregate, at most one row per token."""
    found = F.array_distinct(F.split(F.lower(F.col(url)), "[^a-z0-9]+"))
    rows = (df.select(F.explode(F.array_intersect(found, F.array(*map(F.lit, tokens)))).alias("t"))
            .groupBy("t").count().collect())
    return {r["t"]: r["count"] for r in rows}


def build_index(rules: list, counts: dict[str, int]) -> tuple[dict[str, list], list]:
    index: dict[str, list] = {}
    always = []
    for r in rules:
        if t := r.tokens():
            index.setdefault(min(t, key=lambda x: (counts.get(x, 0), x)), []).append(r)
        else:
            always.append(r)
    return index, always


def judge(url: str | None, index: dict[str, list], always: list, default: str) -> tuple:
    host, path = split_url(url)
    low = (url or "").translate(LOWER)
    near = {r for t in set(TOKEN.findall(low)) for r in index.get(t, ())} | set(always)
    fit = [r for r in near if r.fits(host, path, low)]
    rule = max((r for r in fit if isinstance(r, HostRule)), key=lambda r: (len(r.name), r.name), default=None)
    pattern = max((r for r in fit if isinstance(r, PatternRule)), key=lambda r: (len(r.name), r.name), default=None)
    verdict = rule.verdict if rule else pattern.verdict if pattern else default
    return host, path, rule.name if rule else None, pattern.name if pattern else None, verdict


def filter_urls(df: DataFrame, rules: list, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `df`: the id, host, path, rule (longest fitting host rule), pattern, verdict."""
    tokens = sorted({t for r in rules for t in r.tokens()})
    index, always = build_index(rules, token_counts(df, url, tokens) if tokens else {})

    def run(batches):
        for b in batches:
            out = [judge(u, index, always, default) for u in b.column("_url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(c, pa.string()) for c in zip(*out))],
                                             names=["_id", "host", "path", "rule", "pattern", "verdict"])

    kind = df.schema[page_id].dataType.simpleString()
    return (df.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"))
            .mapInArrow(run, f"_id {kind}, host string, path string, rule string, pattern string, verdict string")
            .select(F.col("_id").alias(page_id), "host", "path", "rule", "verdict", "pattern"))
