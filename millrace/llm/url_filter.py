"""URL filters: a blocked Bloom filter, then an exact hash join.

Listed URLs are canonical: a host in lower case and the beginning of a path. An
entry fits its host and all subdomains, for URLs whose path starts with the
entry's; the longest entry that fits decides. A URL asks for every pair of a
suffix of its host (at a dot, or the whole) and a prefix of its path of a length
that the list has.

The filter has blocks of 64 bits: one part of a key's hash picks the block, and
three others pick bits in it, so that a key is tested in one place. It is an
array of bounded size; keys that it passes go to a join with the list, which
removes what it passed wrongly. Everything runs in built-in expressions.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case.
Path: from there up to `?`, `#` or the end. A null URL, or one without `://`,
has neither (both empty) and fits no entry. Rows that are equal stay as many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
# Blocks of the filter, at most; a longer list passes more keys to the join.
MAX_BLOCKS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1)).cast("int")


def _mask(h: Column) -> Column:
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(h, s).bitwiseAND(F.lit(63)).cast("int"))
            for s in (0, 6, 12)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def blocked_bloom(listed: DataFrame) -> tuple[Column, int]:
    """The filter of (host, path) keys, as an array of one long per block, and their number."""
    n = listed.count()
    wanted = max(1, n * BITS_PER_KEY // 64)
    blocks = min(MAX_BLOCKS, 1 << math.ceil(math.log2(wanted)) if wanted > 1 else 1)
    h = _hash(F.col("host"), F.col("path"))
    filled = listed.groupBy(_block(h, blocks).alias("block")).agg(F.bit_or(_mask(h)).alias("bits"))
    bits = {r["block"]: r["bits"] for r in filled.collect()}
    return F.array(*[F.lit(bits.get(i, 0)).cast("long") for i in range(blocks)]), blocks


def _may_be_listed(bloom: Column, blocks: int, key: Column) -> Column:
    h = _hash(key["host"], key["path"])
    mask = _mask(h)
    return F.get(bloom, _block(h, blocks)).bitwiseAND(mask) == mask


def judge(pages: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Per row: page_id, url, host, path, rule, verdict.

    `listed` has columns host, path, verdict, one row per (host, path). `rule` is
    the host and path of the entry that decides, null if none fits; then the
    verdict is `otherwise`: a URL that the filter and the list do not know.
    """
    listed = listed.select("host", "path", "verdict")
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())
    bloom, blocks = blocked_bloom(listed)

    url = F.col("url")
    # Equal rows are judged once; their number is kept.
    rows = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("_n"))
    labels = F.split("host", r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    paths = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]),
        lambda p: p.isNotNull(),
    ) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(
        hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), p.alias("path")))))
    asked = (
        rows.select("page_id", "url", "_n", host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("_keys", F.when(F.col("host") != "", F.filter(
            keys, lambda k: _may_be_listed(bloom, blocks, k))))
        .withColumn("_key", F.explode_outer("_keys"))
        # A row that asks for nothing joins on a value of its own: no list has
        # a host with a space, and such rows do not meet in one task.
        .withColumn("_host", F.coalesce(F.col("_key.host"), F.concat(
            F.lit(" "), F.xxhash64("page_id", "url").cast("string"))))
        .withColumn("_path", F.coalesce(F.col("_key.path"), F.lit("")))
        .drop("_keys", "_key")
    )
    entries = listed.select(F.col("host").alias("_host"), F.col("path").alias("_path"),
                            F.col("verdict").alias("_verdict"))
    rule = F.concat("_host", "_path")
    met = asked.join(entries, ["_host", "_path"], "left")
    best = met.groupBy("page_id", "url", "host", "path", "_n").agg(
        F.max(F.when(F.col("_verdict").isNotNull(), F.struct(
            F.length(rule).alias("size"), rule.alias("rule"), F.col("_verdict").alias("verdict"),
        ))).alias("_best"))
    return best.select(
        "page_id", "url", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(otherwise)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"),
    ).drop("_copy")
