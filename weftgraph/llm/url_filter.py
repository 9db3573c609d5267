"""URL filter: listed canonical URLs (host, path) judge a host, its subdomains and all longer paths.

A URL has few canonical keys that a list can hold: the ends of its host at label borders, and the starts of its path
at the lengths that the list has. A blocked Bloom filter over the listed keys (one 256-bit block a key, 4 bits in it)
passes possible hits; an exact hash join then removes the filter's false positives. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns

#: Most blocks of the filter; beyond them it only lets more keys through to the exact join. 40 bytes each.
MOST_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 16
WORDS = 4

#: Fixed values of the query's contract: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives the empty string."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(host: Column, path: Column, blocks: int) -> list[Column]:
    """block, and for each of its words the mask of the key's bit there."""
    h = F.xxhash64(host, path)
    block = F.pmod(h, F.lit(blocks)).cast("int").alias("block")
    g = F.xxhash64(path, host, F.lit(7))
    return [block, *[F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(g, 6 * i), F.lit(64)).cast("int")).alias(f"m{i}") for i in range(WORDS)]]


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of at most `blocks` rows."""
    bits = _bits(F.col("host"), F.col("path"), blocks)
    return rules.select(*bits).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict in a struct column `judged`, beside all columns in `row`.

    rules: host, path, verdict; the longest fitting rule (host and path together, then the longer host, then the text)
    decides, others give `default`. A null url, or one without ://, has an empty host and path. Repeated rows each come
    back; of rules with one host and path the least verdict counts; rules with a null host or path fit nothing.
    """
    rules = columns(rules, "host", "path", "verdict").where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    size = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * KEYS_PER_BLOCK < (size["n"] or 0):
        blocks *= 2
    seen = pages.select(F.struct("*").alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    if not size["n"]:
        return seen.select("row", F.struct("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).alias("judged"))
    # only the lengths and label counts that the list has are tried; a path has as few as the list's lengths
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(size["labels"]))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    lengths = F.filter(F.array(*[F.lit(x) for x in sorted(size["lengths"])]), lambda x: x <= F.length("path"))
    urls = seen.select("host", "path").distinct()  # a host or url with many rows is judged once
    keys = urls.select("host", "path", F.explode(suffixes).alias("key_host"), lengths.alias("lengths")).select("host", "path", "key_host", F.explode("lengths").alias("n"))
    keys = keys.select("host", "path", "key_host", F.col("path").substr(F.lit(1), F.col("n")).alias("key_path"))
    probe = keys.select("*", *_bits(F.col("key_host"), F.col("key_path"), blocks))
    maybe = probe.join(F.broadcast(bloom_filter(rules, blocks)), "block")  # at most MOST_BLOCKS rows
    for i in range(WORDS):
        maybe = maybe.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0)
    listed = rules.select(F.col("host").alias("key_host"), F.col("path").alias("key_path"), "verdict")
    hits = maybe.select("host", "path", "key_host", "key_path").join(listed, ["key_host", "key_path"])
    rank = F.struct(F.length(F.concat("key_host", "key_path")), F.length("key_host"), F.concat("key_host", "key_path").alias("rule"), "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = seen.join(best, ["host", "path"], "left")
    return out.select("row", F.struct("host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")).alias("judged"))


#: The same for RULES, in SQL.
ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1) AS rule,
  coalesce((SELECT rv FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1), 'allow') AS verdict
FROM p"""
