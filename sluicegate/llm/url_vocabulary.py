"""URL filter: explicit host and path rules, then a weighted vocabulary.

An Aho-Corasick automaton finds every term of the vocabulary in one pass over a URL. A hit
counts only between boundaries: what stands before and after it is no ASCII letter or
digit. One strict term rejects a URL, and so do several different soft ones.

Defined results: a URL that is NULL, empty or without `://` has an empty host and path and
fits no rule; its vocabulary verdict is that of its characters (NULL: allow). Very long
URLs are read whole; of rules that fit the longest wins, and no two are equally long for one
URL but for equal ones. Repeated rows are judged alike; an empty frame gives an empty frame. Other columns of the frame
are left out, so that no name can clash. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.tables import widened

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(LOWER + "0123456789")

# Terms of the default vocabulary: lower case, matched between boundaries.
STRICT = (
    "casino", "casinos", "camgirl", "camgirls", "escort", "escorts", "hentai", "malware", "phishing", "porn",
    "porno", "sexcam", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "adult", "ads", "bet", "bets", "betting", "bonus", "bonuses", "cheap", "click", "coupon", "crack", "dating",
    "deal", "deals", "farm", "free", "girls", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "pill",
    "pills", "poker", "popup", "prize", "promo", "serial", "sex", "slot", "slots", "torrent", "track", "tracker",
    "win", "winner",
)
MIN_SOFT = 2


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host with all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, NULL without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:  # a term in both lists is strict
        found.add_word(term, (term, True))
    if len(found):
        found.make_automaton()
    return found


def hits(found: ahocorasick.Automaton, url: str | None) -> tuple[int, list[str]]:
    """The number of strict hits and the different soft terms, sorted."""
    if not url or not len(found):
        return 0, []
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
    strict, soft = 0, set()
    for end, (term, is_strict) in found.iter(text):
        before, after = end - len(term), end + 1
        if (before >= 0 and text[before] in _WORD) or (after < len(text) and text[after] in _WORD):
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, sorted(soft)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    key: str = "page_id",
    url: str = "url",
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    min_soft: int = MIN_SOFT,
) -> DataFrame:
    """One row per page: key, url, host, path, rule, verdict, strict_hits, soft_terms.

    `verdict` is that of the longest fitting rule, else `block` for a URL with a strict
    hit or `min_soft` different soft terms, else `allow`.
    """
    strict, soft = tuple(strict), tuple(soft)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for batch in batches:
            rows = [hits(found, u) for u in batch.column(1).to_pylist()]
            columns = [
                *batch.columns,
                pa.array([n for n, _ in rows], pa.int32()),
                pa.array([terms for _, terms in rows], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "url", "strict_hits", "soft_terms"])

    narrow = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"))
    counted = narrow.mapInArrow(count, widened(narrow, strict_hits="int", soft_terms="array<string>"))
    parsed = counted.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).fillna(
        "", ["host", "path"]
    )
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("strict_hits") > 0) | (F.size("soft_terms") >= min_soft), "block").otherwise("allow")
    return parsed.select(
        F.col("key").alias(key),
        "url",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(said, own).alias("verdict"),
        "strict_hits",
        "soft_terms",
    )
