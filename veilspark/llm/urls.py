"""URL rules indexed by their rarest literal token, in DataFrame operations only.

A rule is a regular expression over host and path with some literal tokens that every url it fits must hold.
It is filed under the one that fewest urls hold; a rule without such tokens is run for every url. A url's tokens fetch the rules filed under them, and only those
run their expressions. The index is a literal of the plan: an array of hash slots, so a token costs one look-up
however many rules there are, and nothing is shuffled. Rules are held by the driver and so bounded by it.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """name is what is reported and, by its length, ranked; tokens start with h: (a host label) or p: (a word of the path).

    The pattern must fit no url without all of the tokens; no tokens are right for any pattern, but cost a run for each url.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains where the path starts with `path`; an empty one also fits an empty path.

    The last word of the path is no token: a longer one may start with it.
    """
    tail = re.split(r"[^A-Za-z0-9]+", path)[:-1]
    tokens = [f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in tail if x]
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{_quoted(host)}" + (_quoted(path) if path else "(?:/|$)"), tuple(dict.fromkeys(tokens)))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.regexp_extract_all(path, F.lit(f"({WORD})"), F.lit(1)), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words))


def rarest_tokens(urls: DataFrame, tokens: Column, rules: list[Rule]) -> dict[str, str]:
    """name -> the rule's token that fewest urls hold; of equals the longest, then the first. Rules without tokens have no entry."""
    wanted = sorted({t for r in rules for t in r.tokens})
    held = F.array_intersect(tokens, F.from_json(F.lit(json.dumps(wanted)), "array<string>"))
    count = {r[0]: r[1] for r in urls.select(F.explode(held).alias("t")).groupBy("t").count().collect()}  # the rules' tokens at most
    return {r.name: min(r.tokens, key=lambda t: (count.get(t, 0), -len(t), t)) for r in rules if r.tokens}


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (columns of pages by those names are replaced).

    Of the rules that fit, the one with the longest name wins, among equals the first by name; without one, rule is
    null and the verdict is `otherwise`. Null urls have an empty host and path. Equal rows are judged alike; an
    empty table gives an empty one, an empty list of rules `otherwise` throughout.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    base = pages.select("*", host.alias("__host"), path.alias("__path"))
    tokens = _tokens(F.col("__host"), F.col("__path"))
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    filed: dict[str, list[int]] = {}
    if ranked:
        rare = rarest_tokens(base, tokens, ranked)
        for i, r in enumerate(ranked):
            if r.name in rare:
                filed.setdefault(rare[r.name], []).append(i)
    width = 1 << max(1, (2 * len(filed)).bit_length())
    slots: list[list[dict]] = [[] for _ in range(width)]
    for t, at in filed.items():
        slots[zlib.crc32(t.encode()) % width].append({"t": t, "at": at})
    index = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t string, at array<int>>>>")
    table = F.from_json(F.lit(json.dumps([{"n": r.name, "v": r.verdict, "p": r.pattern} for r in ranked])), "array<struct<n string, v string, p string>>")

    def fetch(token: Column) -> Column:
        slot = F.element_at(index, (F.crc32(token.cast("binary")) % width + 1).cast("int"))
        return F.flatten(F.transform(F.filter(slot, lambda e: e["t"] == token), lambda e: e["at"]))

    subject = F.concat("__host", "__path")
    always = F.from_json(F.lit(json.dumps([i for i, r in enumerate(ranked) if not r.tokens])), "array<int>")
    fits = F.filter(F.array_distinct(F.concat(F.flatten(F.transform(tokens, fetch)), always)), lambda i: F.regexp_like(subject, F.element_at(table, i + 1)["p"]))
    best = F.element_at(table, F.array_min(fits) + 1) if ranked else F.lit(None).cast("struct<n string, v string, p string>")
    judged = base.withColumn("__best", best)
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(*rest, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.n").alias("rule"), F.coalesce("__best.v", F.lit(otherwise)).alias("verdict"))
