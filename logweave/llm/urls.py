"""URL filters: rules for hosts and paths, and a block list behind a blocked Bloom filter.

The filter is a table with one row per block of 256 bits. Each listed URL sets eight bits of one block; blocks are
put together with ``bit_or``. The number of blocks is bounded, so the filter can be broadcast
whatever the length of the list, and only URLs with all their bits set go on to an exact hash join, which
removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4  # 64-bit words of a block
MOST_BLOCKS = 1 << 20  # about 60 MB as a broadcast


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a closing slash, query without tracking; null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)="))
    asked = F.array_join(kept, "&")
    return F.when(host != "", F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each word of its block, two a word."""
    spread = F.xxhash64(F.lit("bits"), key)
    place = [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(2 * WORDS)]
    bit = [F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in place]
    return [bit[2 * w].bitwiseOR(bit[2 * w + 1]) for w in range(WORDS)]


def blocked_bloom(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter: block, w0, w1, ... with at most ``blocks`` rows."""
    masks = [m.alias(f"w{w}") for w, m in enumerate(_masks(F.col(column)))]
    rows = keys.filter(F.col(column).isNotNull()).select(_block(F.col(column), blocks).alias("block"), *masks)
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def blocks_for(count: int, most: int = MOST_BLOCKS) -> int:
    """A power of two with about 16 keys a block (a few false hits in a thousand), ``most`` at most."""
    return min(most, 1 << max(0, (count // 16).bit_length()))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row of ``pages``: page_id, host, path, rule, verdict, in_list.

    ``listed`` has the blocked ``url``s; URLs are compared in canonical form. A rule's verdict goes before
    the list's; without either a URL is allowed. Null URLs, and those without ``://``, have empty host and path and are
    allowed. Repeated rows are judged each; an empty list blocks nothing. Other columns are not read.
    """
    names = listed.select(canonical(F.col("url")).alias("listed_url")).filter("listed_url is not null").distinct()
    blocks = blocks_for(names.count())
    bloom = F.broadcast(blocked_bloom(names, "listed_url", blocks))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical_url"))
    rule, ruling = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruling": ruling, "block": _block(F.col("canonical_url"), blocks)}).join(bloom, "block", "left")
    hits = [F.col(f"w{w}").bitwiseAND(m) == m for w, m in enumerate(_masks(F.col("canonical_url")))]
    possible = F.col("canonical_url").isNotNull() & F.coalesce(hits[0] & hits[1] & hits[2] & hits[3], F.lit(False))
    sure = rows.filter(~possible).withColumn("in_list", F.lit(False))
    asked = rows.filter(possible).join(names.hint("shuffle_hash"), F.col("canonical_url") == F.col("listed_url"), "left")
    both = sure.unionByName(asked.withColumn("in_list", F.col("listed_url").isNotNull()).drop("listed_url"))
    verdict = F.coalesce("ruling", F.when(F.col("in_list"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "in_list")


# The rules of the registered query, and what makes a host's pages listed there.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
LISTED_HOSTS = "(spam|pills|casino|adult|free-)"

_CANONICAL = """
  CASE WHEN host <> '' THEN concat(regexp_replace(host, '^www\\.', ''), regexp_replace(path, '/+$', ''),
    CASE WHEN q <> '' THEN concat('?', q) ELSE '' END) END"""

ORACLE = rf"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS u FROM pages
), b AS (
  SELECT page_id, coalesce(translate(regexp_extract(u, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path,
         array_to_string(list_filter(string_split(coalesce(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), ''), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)=')), '&') AS q
  FROM a
), c AS (
  SELECT *, {_CANONICAL} AS canonical,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM b
), l AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, '{LISTED_HOSTS}'))
SELECT page_id, host, path, rule, l.canonical IS NOT NULL AS in_list,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN l USING (canonical)
"""
