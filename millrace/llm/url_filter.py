"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule is a canonical URL, host and path prefix written together (``net/de/``), with a verdict. It fits its
host and all subdomains, if the path starts with the rule's. Each URL is expanded to the canonical keys that
could be listed: its label-aligned host suffixes, as deep as the deepest rule, with the path prefixes of the
lengths that occur in the list. The Bloom filter, a table of 256-bit blocks of four words, passes the keys
that may be listed; an equi-join on the key then removes the false positives, and the longest rule wins.

The filter's size is fixed by ``blocks`` alone (32 bytes each), whatever the list holds, so it is broadcast
safely; a list too long for it costs false positives, never a wrong verdict.

Defined results:

* null URL, or one without ``://``: host and path empty, no rule, the default verdict;
* repeated rows each keep their row and verdict; null page ids too;
* no rule fits: rule null, default verdict (``allow``);
* ties: two rules of one URL can't have the same length unless they are the same key; of a key listed
  twice, the smaller verdict (``allow``) holds;
* an empty table gives an empty result; columns besides id and URL are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower

#: Lists of up to so many bytes of keys are broadcast in the exact join; longer ones are shuffled.
BROADCAST_BYTES = 8_000_000
WORDS = 4


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit in each of a block's words, from a second hash: six bits of it for each word."""
    second = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def build_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """The blocked Bloom filter of ``rules.key``: block, w0..w3; at most ``blocks`` rows."""
    words = [b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))]
    return rules.select(_block(F.col("key"), blocks).alias("block"), *words).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def canonical_rules(rules: DataFrame) -> DataFrame:
    """host, path, verdict to key, verdict; one row per key."""
    return rules.select(F.concat("host", "path").alias("key"), "host", "path", "verdict").groupBy("key").agg(F.min("verdict").alias("verdict"), F.min("host").alias("host"), F.min("path").alias("path"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", blocks: int = 1 << 16, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``rules``: host, path, verdict."""
    listed = canonical_rules(rules)
    shape = listed.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.collect_set(F.length("path")), F.array().cast("array<int>")).alias("lengths"),
        F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("bytes"),
    ).first()
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    # Every key that could be listed: suffixes of up to the deepest rule's labels, prefixes of listed lengths.
    depth = F.least(F.size(F.split("host", r"\.")), F.lit(shape["labels"]))
    suffixes = F.transform(F.sequence(F.lit(1), depth), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(prefixes), lambda p: F.concat(s, p))))
    candidates = (
        parsed.where((F.col("host") != "") & F.lit(shape["labels"] > 0 and bool(shape["lengths"])))
        .select("page_id", "url", F.explode(F.array_distinct(keys)).alias("key"))
        .withColumn("block", _block(F.col("key"), blocks))
    )
    bloom = F.broadcast(build_filter(listed, blocks))
    may = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        may = may & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    possible = candidates.join(bloom, "block").where(may).select("page_id", "url", "key")

    exact = listed.select("key", F.col("verdict").alias("said"))
    exact = F.broadcast(exact) if shape["bytes"] <= BROADCAST_BYTES else exact.hint("shuffle_hash")
    hits = (
        possible.join(exact, "key")
        .groupBy("page_id", "url")
        .agg(F.max(F.struct(F.length("key").alias("n"), "key", "said")).alias("best"))
        .select(F.col("page_id").alias("hit_id"), F.col("url").alias("hit_url"), F.col("best.key").alias("rule"), F.col("best.said").alias("said"))
    )
    on = F.col("page_id").eqNullSafe(F.col("hit_id")) & (F.col("url") == F.col("hit_url"))
    return parsed.join(hits, on, "left").select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
