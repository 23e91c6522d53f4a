"""URL rules behind a blocked Bloom filter. DataFrame operations only.

The listed canonical URLs are keys host + path prefix. A page has one candidate key for each suffix
of its host (at label borders) and each listed prefix length. A split-block Bloom filter of the
listed keys (blocks of 512 bits, one bit in each of eight words) passes possible hits; an exact hash
join with the list then removes its false positives, and the longest listed key decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Bits of the filter for a listed key; blocks at most (2 MB), beyond which only its false positives grow.
BITS_PER_KEY = 16
MAX_BLOCKS = 32_768
WORDS = 8
#: Odd multipliers, one for each word of a block; they are the fixed ones of the Parquet format's split-block filter.
MULTIPLIERS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Lists of up to so many rows are broadcast to the exact join; longer ones are shuffled.
BROADCAST_RULES = 100_000
#: (action, host, path): the production list.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_SHIFT = 1 << 24


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    made = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules]
    empty = F.array().cast("array<struct<action:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(F.array(*made) if made else empty))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _block_and_bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block, and the number of its bit in each word of the block."""
    h = F.xxhash64(key)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(h, 32) % blocks, [F.shiftright((low * F.lit(m & 0x7FFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int") for m in MULTIPLIERS]


def bloom_words(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """One row, words: the filter's blocks one after another, WORDS longs each. keys: key. Also the number of blocks."""
    blocks = min(MAX_BLOCKS, 1 << math.ceil(math.log2(max(1, n_keys * BITS_PER_KEY / (64 * WORDS)))))
    block, bits = _block_and_bits(F.col("key"), blocks)
    set_bits = keys.select(block.alias("block"), *[_bit(b).alias(f"w{i}") for i, b in enumerate(bits)])
    held = set_bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    every = keys.sparkSession.range(blocks).select(F.col("id").alias("block")).join(held, "block", "left")
    row = F.struct("block", F.array(*[F.coalesce(f"w{i}", F.lit(0)).cast("long") for i in range(WORDS)]).alias("w"))
    return every.agg(F.flatten(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["w"])).alias("words")), blocks


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number)


def might_contain(words: Column, key: Column, blocks: int) -> Column:
    block, bits = _block_and_bits(key, blocks)
    found = F.lit(True)
    for i, b in enumerate(bits):
        found = found & (F.get(words, (block * WORDS + i).cast("int")).bitwiseAND(_bit(b)) != 0)
    return found


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, possible (candidate keys that passed the Bloom filter).

    A rule fits its host and all subdomains where the path starts with the rule's. The longest rule
    wins; of equally long ones that with the longer host; of rules listed twice with both actions,
    block. Where none fits, rule is null and verdict is default: the URL isn't listed. A null url or
    one without :// has an empty host and path, and no rule. Repeated rows are judged each. Rules
    with null fields are ignored. Other columns don't matter; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rules = rules_table(spark) if rules is None else rules
    listed = rules.where("host is not null and path is not null and action is not null").select(F.concat(ascii_lower(F.col("host")), "path").alias("key"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), (F.col("action") == "block").cast("long").alias("blocks"))
    listed = listed.groupBy("key", "host_len", "path_len").agg(F.max("blocks").alias("blocks"))
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("path_len")).alias("lengths")).first()  # lengths: as many as a URL is long
    bloom, blocks = bloom_words(listed.select("key"), facts["n"])

    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    prefixes = F.array(*[F.lit(n) for n in facts["lengths"]]) if facts["lengths"] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(prefixes, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("key"), F.length(s).alias("host_len"), F.length(p).alias("path_len")))))
    possible = F.filter(keys, lambda k: might_contain(F.col("words"), k["key"], blocks))
    parts = parts.withColumn("words", bloom.scalar())  # one literal for the whole query, not a join
    hits = parts.withColumn("hits", F.when(F.col("host") != "", possible).otherwise(F.array().cast("array<struct<key:string,host_len:int,path_len:int>>")))
    rows = hits.withColumn("possible", F.size("hits")).withColumn("hit", F.explode_outer("hits")).select("page_id", "url", "host", "path", "possible", F.col("hit.key").alias("key"), F.col("hit.host_len").alias("host_len"), F.col("hit.path_len").alias("path_len"))
    exact = F.broadcast(listed) if facts["n"] <= BROADCAST_RULES else listed
    met = rows.join(exact, ["key", "host_len", "path_len"], "left")
    # the longest, then the longer host, then block: one long, so that copies combine before the shuffle
    code = F.when(F.col("blocks").isNotNull(), (F.col("host_len") + F.col("path_len")).cast("long") * F.lit(2 * _SHIFT) + F.col("host_len") * F.lit(2) + F.col("blocks"))
    best = met.groupBy("page_id", "url", "host", "path", "possible").agg(F.max(code).alias("code"), F.count(F.lit(1)).alias("n"))
    best = best.withColumn("copies", (F.col("n") / F.greatest(F.col("possible"), F.lit(1))).cast("int"))
    host_len = (F.floor(F.col("code") / 2) % _SHIFT).cast("int")
    whole = F.floor(F.col("code") / (2 * _SHIFT)).cast("int")
    rule = F.when(F.col("code").isNotNull(), F.concat(F.substring("host", F.length("host") - host_len + 1, host_len), F.substring("path", F.lit(1), whole - host_len)))
    verdict = F.when(F.col("code").isNull(), F.lit(default)).when(F.col("code") % 2 == 1, F.lit("block")).otherwise(F.lit("allow"))
    judged = best.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "possible", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return judged.drop("copy")
