"""Exact deduplication through an extendible-hash index on shared files. DataFrame operations only.

Insertion: each text is hashed to 64 bits. Texts whose hash no other row has are entries at once; the
rest are grouped by hash and whole text, so copies are found by comparing bytes (first within each map
task, then in the reducer) and different texts of one hash chain. Directory: slots are the leading bits
of the hash, as many as the directory is deep. It doubles while a bucket that can be split holds more
than bucket_rows entries, and a bucket is split no further than it needs: its slots share a prefix.
Owner tasks hold ranges of (bucket, hash), number the chains and write them to the shared folder.
Lookup: a document's hash gives its slot, the directory the bucket, and in the bucket's chain of that
hash the digest tells the entry. What the directory doesn't lead to isn't found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, heavy_split, skew_safe_lookup, write_table
from .url_filter import bloom_words, might_contain

#: Entries of one bucket.
BUCKET_ROWS = 16_384
#: A directory of up to so many slots (of 24 bytes) is broadcast; a deeper one is joined by shuffle.
BROADCAST_SLOTS = 100_000
HASH_BITS = 64


@dataclass(frozen=True)
class Index:
    """entries: bucket, local_depth, h, chain (place among equal hashes), text_sha256, keep_id, group_size. directory: slot, bucket, local_depth, rows (documents). rows: documents; repeated: texts of two rows or more."""

    entries: DataFrame
    directory: DataFrame
    depth: int
    slots: int
    rows: int
    repeated: int
    hash_bits: int


def text_hash(text: Column, hash_bits: int = HASH_BITS) -> Column:
    """The leading hash_bits of the 64-bit hash of a text; null counts as empty."""
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    return h if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def insert_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = HASH_BITS) -> DataFrame:
    """One row for each different text: h, text_sha256, keep_id, group_size. Null texts count as empty.

    A Bloom filter of the hashes that two rows or more have sends on the texts to be compared; a text
    whose hash is alone goes without its bytes.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("h", text_hash(F.col("_text"), hash_bits))
    shared = write_table(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("key")), "exact-shared")
    bloom, blocks = bloom_words(shared, shared.count())
    rows = rows.withColumn("_words", bloom.scalar())
    maybe = might_contain(F.col("_words"), F.col("h"), blocks)
    rows = rows.select("_id", "h", F.when(maybe, F.col("_text")).alias("_compared"), F.when(~maybe, digest(F.col("_text"))).alias("_alone"))
    entries = rows.groupBy("h", "_compared", "_alone").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = write_table(entries.select("h", F.coalesce("_alone", digest(F.col("_compared"))).alias("text_sha256"), "keep_id", "group_size"), "exact-entries")
    drop_table(shared)
    return entries


def directory(entries: DataFrame, n_entries: int, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth, rows) for every slot in use, and the directory's depth.

    It begins with the slots that even buckets would need and doubles (one bit more) while a slot
    holds more than bucket_rows entries of two hashes or more; entries of one hash are a chain, which
    no depth can split. A slot's bucket is its shortest prefix that holds bucket_rows entries at most.
    """
    depth = max(1, math.ceil(math.log2(max(1, n_entries) / bucket_rows)))
    while True:
        slot = F.shiftrightunsigned("h", 64 - depth)
        cells = write_table(entries.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high")), "exact-cells")
        if depth == 62 or cells.where((F.col("n") > bucket_rows) & (F.col("low") != F.col("high"))).isEmpty():
            break
        drop_table(cells)
        depth += 1
    levels = cells.select("slot", "n", "rows", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    levels = levels.withColumn("bucket", (F.expr(f"shiftright(slot, {depth} - d)")).cast("long"))
    full = levels.groupBy("d", "bucket").agg(F.sum("n").alias("held"))
    fits = levels.join(full, ["d", "bucket"]).where((F.col("held") <= bucket_rows) | (F.col("d") == depth))
    least = fits.groupBy("slot").agg(F.min("d").alias("local_depth"), F.first("rows").alias("rows"))
    out = least.select("slot", F.expr(f"shiftleft(shiftright(slot, {depth} - local_depth), {depth} - local_depth)").alias("bucket"), "local_depth", "rows")
    out = write_table(out, "exact-directory")
    drop_table(cells)
    return out, depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, hash_bits: int = HASH_BITS) -> Index:
    """The index of all texts of docs, on files in the shared folder (see Index)."""
    entries = insert_entries(docs, id_col, text_col, hash_bits)
    n = entries.count()
    slots, depth = directory(entries, n, bucket_rows)
    n_slots = slots.count()
    owned = entries.withColumn("slot", F.shiftrightunsigned("h", 64 - depth)).join(_small(slots.drop("rows"), n_slots), "slot").repartitionByRange("bucket", "h")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")) - 1
    index = write_table(owned.select("bucket", "local_depth", "h", chain.alias("chain"), "text_sha256", "keep_id", "group_size"), "exact-index")
    drop_table(entries)
    facts = index.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("rows"), F.count(F.when(F.col("group_size") > 1, True)).alias("repeated")).first()
    return Index(index, slots, depth, n_slots, facts["rows"], facts["repeated"], hash_bits)


def _small(slots: DataFrame, n_slots: int) -> DataFrame:
    return F.broadcast(slots) if n_slots <= BROADCAST_SLOTS else slots


def _to_buckets(rows: DataFrame, index: Index) -> DataFrame:
    """rows (with h) and the bucket that the directory leads to, null where it leads nowhere."""
    rows = rows.withColumn("slot", F.shiftrightunsigned("h", 64 - index.depth))
    if index.slots <= BROADCAST_SLOTS:
        return rows.join(F.broadcast(index.directory.select("slot", "bucket")), "slot", "left").drop("slot")
    return skew_safe_lookup(rows, index.directory.select("slot", "bucket", "rows"), ["slot"], "rows", index.rows).drop("slot", "rows")


def lookup(probe: DataFrame, index: Index) -> DataFrame:
    """probe (with h and text_sha256) and each row's entry: bucket, keep_id, group_size; null where there is none."""
    found = index.entries.select("bucket", "h", "text_sha256", "keep_id", "group_size")
    return skew_safe_lookup(_to_buckets(probe, index), found, ["bucket", "h", "text_sha256"], "group_size", index.rows)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, hash_bits: int = HASH_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null texts count as empty. A null id is
    smaller than any other; where all ids of a group are null, keep_id is null and all its rows are
    kept. Rows that repeat one id and text are copies of one document: all of them are marked kept
    when that id stays (dedup_rows() leaves one). Texts are read whole, however long. Other columns of
    docs are ignored whatever their names; an empty table gives an empty result. Index and directory
    stay in the shared folder, as the result reads them.
    """
    index = build_index(docs, id_col, text_col, bucket_rows, hash_bits)
    probe = docs.select(text_hash(F.col(text_col), hash_bits).alias("h"), digest(F.col(text_col)).alias("text_sha256"), F.col(id_col).alias("doc_id"))
    return lookup(probe, index).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, hash_bits: int = HASH_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each different text.

    Null, empty and very long texts, null ids, empty tables and columns of any other name are as in
    exact_dedup(); of rows that repeat one id and text one stays. A row whose text is alone stays where
    it is: only rows that a Bloom filter takes for copies are moved to meet their entries, and of a
    text with a thousandth of all rows or more only those with the entry's id.
    """
    index = build_index(docs, id_col, text_col, bucket_rows, hash_bits)
    copied = index.entries.where("group_size > 1")
    bloom, blocks = bloom_words(copied.select(F.col("h").alias("key")), index.repeated)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_hash(F.col(text_col), hash_bits).alias("h"), bloom.scalar().alias("words"))
    maybe = might_contain(F.col("words"), F.col("h"), blocks)
    alone = named.where(~maybe).select("row.*")
    met = _to_buckets(named.where(maybe).select("row", "id", "h", digest(F.col(f"row.`{text_col}`")).alias("text_sha256")), index)
    keys = ["bucket", "h", "text_sha256"]
    heavy, light = (t.select(*keys, F.struct("keep_id").alias(name)) for t, name in zip(heavy_split(copied, "group_size", index.rows), ("hot", "cold"), strict=True))
    met = met.join(F.broadcast(heavy), keys, "left").where(F.col("hot").isNull() | F.col("hot.keep_id").eqNullSafe(F.col("id")))
    met = met.join(light, keys, "left").where(F.col("cold").isNull() | F.col("cold.keep_id").eqNullSafe(F.col("id")))
    return alone.union(met.dropDuplicates(keys).select("row.*"))
