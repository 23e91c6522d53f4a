"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is dealt by hash to blocks, as many as twice the root of its rows; the mix has as many
shards as the root of its size. The mix is a number of draws from each source: whole passes over all its
blocks in permuted order, then some of its blocks once more, the last of them with those of its and
the next blocks' documents that together fill what is left of the target. The draws are split among shards exactly: a node of the
tree holds a quota of draws of each source and a range of shards, and gives its left half a
multivariate-hypergeometric share, from a seed of its own. So a task finds the quotas of its shards by
walking down from the root, and no one holds the whole tree. Each leaf is a shard with a whole quota of
every source; it receives disjoint runs of permuted blocks, and the rows within a shard are shuffled
locally. Sizes are words.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, map_arrow, skew_safe_lookup, write_table

#: A source of n rows has ROOT_BLOCKS * sqrt(n) blocks; a mix of w words has sqrt(w / ROOT_WORDS) shards.
ROOT_BLOCKS = 2.0
ROOT_WORDS = 2500
#: Rows on either side of a source's last block that single documents are chosen from, about.
POOL_ROWS = 256
#: No document is taken more than so many times.
MAX_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: More sources, or blocks, than this are joined by shuffle instead of by broadcast.
BROADCAST_SOURCES = 10_000
BROADCAST_BLOCKS = 50_000
#: Draws that a task of the tree writes, about.
TASK_DRAWS = 65_536
_DRAWS = "array<struct<pass:int,shard:int>>"


def targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Words to take from each source: shares of the whole by weight, at most max_repeats times the source, the excess reshared by weight until none is above."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        weight = sum(weights[i] for i in active)
        share = {i: left * weights[i] / weight for i in active}
        over = [i for i in active if share[i] > max_repeats * sizes[i]]
        if not over:
            for i in active:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(over)]
    return out


def leaves(quotas: np.ndarray, shards: int, seed: int = 0, first: int = 0, past: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, draws of each source before it, its draws) for the shards from first to past.

    Only nodes above these shards are visited. Draws add up to quotas over all shards, and shards
    differ by a few draws at most.
    """
    past = shards if past is None else past
    none = np.zeros(len(quotas), np.int64)
    stack = [(0, shards, none, np.asarray(quotas, dtype=np.int64))]
    while stack:
        at, count, before, have = stack.pop()
        if at >= past or at + count <= first:
            continue
        if count == 1:
            yield at, before, have
            continue
        half = count // 2
        draws = int(have.sum()) * half // count
        rng = np.random.Generator(np.random.PCG64([seed, at, count]))
        left = rng.multivariate_hypergeometric(have, draws, method="marginals") if len(have) else have
        stack += [(at + half, count - half, before + left, have - left), (at, half, before, left)]


def fill(sizes: list[int], need: float) -> list[int]:
    """Places of sizes, in order, whose sum comes near need: each that still fits, then the one change (one more, or one for another) that helps most."""
    taken, left = [], need
    for i, n in enumerate(sizes):
        if n <= left:
            taken.append(i)
            left -= n
    chosen = set(taken)
    others = sorted((n, i) for i, n in enumerate(sizes) if i not in chosen)
    best = (abs(left), -1, -1)
    for gone in [-1, *taken]:
        want = left + (sizes[gone] if gone >= 0 else 0)
        at = bisect_left(others, (want, -1))
        for n, i in others[max(0, at - 1) : at + 1]:
            best = min(best, (abs(want - n), gone, i))
        if gone >= 0:
            best = min(best, (abs(want), gone, -1))
    _, gone, new = best
    chosen.discard(gone)
    return sorted(chosen | ({new} if new >= 0 else set()))


def _coprime(n: int, seed: int) -> int:
    a = 1 + seed % max(1, n)
    while math.gcd(a, n) != 1:
        a += 1
    return a


@dataclass(frozen=True)
class MixPlan:
    """sources: key, s, source_size, target, n, blocks. blocks: s, block, draws, passes, pooled (only picks get the draw after the passes). picks: s, block, nth. rows: documents."""

    sources: DataFrame
    blocks: DataFrame
    picks: DataFrame
    n_sources: int
    n_blocks: int
    rows: int


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _with_source(rows: DataFrame, sources: DataFrame, n_sources: int, total: int) -> DataFrame:
    """rows (key, h) with their source's columns and their block."""
    if n_sources <= BROADCAST_SOURCES:
        found = rows.join(F.broadcast(sources.drop("n")), "key")
    else:
        found = skew_safe_lookup(rows, sources, ["key"], "n", total).drop("n")
    return found.withColumn("block", F.pmod("h", "blocks")).drop("key", "blocks")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_rows: int | None = None, shard_words: int | None = None, max_repeats: int = MAX_REPEATS) -> tuple[MixPlan, DataFrame]:
    """The plan of a mix, and the sizes it was made from: doc_id, key, size, h. block_rows and shard_words put fixed sizes in place of the roots."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), _source_key(F.col(source_col)).alias("key"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), _hash(id_col, text_col).alias("h"))
    sized = write_table(sized, "mix-sizes")
    # one row per source, which is a catalogue of data sets and not data
    found = sized.groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["key"] == "-", r["key"]))
    goal = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], max_repeats)
    rows, facts = [], []
    for i, (r, t) in enumerate(zip(found, goal, strict=True)):
        blocks = max(1, math.ceil(r["n"] / block_rows if block_rows else ROOT_BLOCKS * math.sqrt(r["n"])))
        passes = min(max_repeats, int(t // r["words"])) if r["words"] else 0
        salt = zlib.crc32(f"{seed}:{i}".encode())
        rows.append((r["key"], i, r["words"], t, r["n"], blocks))
        facts.append((i, blocks, passes, t - passes * r["words"], _coprime(blocks, salt), salt % blocks))
    sources = spark.createDataFrame(rows, "key string, s int, source_size long, target double, n long, blocks long")
    facts_table = spark.createDataFrame(facts, "s int, blocks long, passes int, part double, mul long, add long")
    total, n_blocks = sum(r["n"] for r in found), sum(f[1] for f in facts)
    placed = _with_source(sized, sources, len(rows), total)

    sums = placed.groupBy("s", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("held"))
    sums = sums.join(F.broadcast(facts_table) if len(rows) <= BROADCAST_SOURCES else facts_table, "s")
    sums = sums.withColumn("place", F.pmod(F.col("block") * F.col("mul") + F.col("add"), F.col("blocks")))
    own, order = Window.partitionBy("s"), Window.partitionBy("s").orderBy("place")  # a source's blocks are few: the root of its rows
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "block", "place", "passes", "part", "words", "held", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("at"), (F.row_number().over(order) - 1).alias("rank"), F.count(F.lit(1)).over(own).alias("used"))
    last = F.max(F.when((F.col("part") >= 0.5) & (F.col("start") <= F.col("part")), F.struct("at", "held"))).over(own)
    sums = sums.withColumn("last", last)
    pooled = F.col("last").isNotNull() & (F.col("at") < F.col("last.at") + F.col("last.held") + POOL_ROWS) & (F.col("at") + F.col("held") > F.col("last.at") - POOL_ROWS)
    again = F.coalesce(F.col("at") <= F.col("last.at"), F.lit(False))
    sums = sums.withColumn("pooled", pooled).withColumn("again", again).withColumn("edge", F.coalesce(F.col("at") == F.col("last.at"), F.lit(False)))
    base = F.min(F.when(F.col("pooled"), F.col("start"))).over(own)
    block = write_table(sums.select("s", "block", "rank", "used", "passes", "pooled", "again", "edge", (F.col("part") - base).alias("need")), "mix-blocks")

    pool = placed.select("s", "block", "doc_id", "size", "h").join(block.where("pooled").select("s", "block", "rank", "need"), ["s", "block"])
    pool = _numbered(pool, ["doc_id"]).select("s", "block", "nth", "size", "rank", "need", F.xxhash64(F.lit(seed), "h", "nth").alias("order"))
    picks = write_table(pool.groupBy("s").applyInPandas(_chosen, "s int, block long, nth int"), "mix-picks")

    per = block.groupBy("s").agg(F.sum(F.col("passes") + F.col("again").cast("int")).alias("draws")).collect()
    quotas = np.zeros(len(rows), np.int64)
    for r in per:
        quotas[r["s"]] = r["draws"]
    words = sum(goal)
    shards = max(1, min(math.ceil(words / shard_words if shard_words else math.sqrt(words / ROOT_WORDS)), int(quotas.sum())))
    dealt = draws_of_shards(spark, quotas, shards, seed)
    drawn = block.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).where((F.col("pass") < F.col("passes")) | F.col("again"))
    drawn = drawn.select("s", (F.col("pass").cast("long") * F.col("used") + F.col("rank")).alias("draw"), "block", "pass")
    sent = drawn.join(dealt, ["s", "draw"]).groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))  # max_repeats + 1 at most
    block = block.join(sent, ["s", "block"], "left").withColumn("draws", F.coalesce("draws", F.array().cast(_DRAWS)))
    edge = F.max(F.when(F.col("edge"), F.element_at("draws", -1))).over(own)  # documents of later blocks go along with the last block
    late = F.col("pooled") & ~F.col("again")
    block = block.select("s", "block", "passes", "pooled", F.when(late, F.concat("draws", F.array(edge))).otherwise(F.col("draws")).alias("draws"))
    block = write_table(block, "mix-draws")
    return MixPlan(sources, block, picks, len(rows), n_blocks, total), sized


def _numbered(rows: DataFrame, ids: list[str]) -> DataFrame:
    """rows with nth, their place in their block by hash; rows that tie have one id and text, and it doesn't matter which is which."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("s", "block").orderBy("h", *ids)))


def _chosen(pool):
    """The documents of one source's pool that fill what its draws of blocks leave of the target; the pool has a block's rows and 2 * POOL_ROWS, about."""
    pool = pool.sort_values(["rank", "order", "nth"])
    taken = fill(pool["size"].tolist(), float(pool["need"].iloc[0]))
    return pool.iloc[taken][["s", "block", "nth"]]


def draws_of_shards(spark, quotas: np.ndarray, shards: int, seed: int = 0) -> DataFrame:
    """(s, draw, shard) for every draw. Tasks hold ranges of shards and walk the tree for them."""
    shared = spark.sparkContext.broadcast(np.asarray(quotas, dtype=np.int64))  # one number for each source
    tasks = max(1, min(shards, math.ceil(int(shared.value.sum()) / TASK_DRAWS)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quota = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            s, draw, shard, held = [], [], [], 0
            for leaf, before, have in leaves(quota, shards, seed, int(ids[0]), int(ids[-1]) + 1):
                n = int(have.sum())
                own = np.repeat(np.arange(len(quota), dtype=np.int32), have)
                s.append(own)
                draw.append(np.arange(n) - np.repeat(np.cumsum(have) - have, have) + before[own])
                shard.append(np.full(n, leaf, np.int32))
                held += n
                if held >= TASK_DRAWS:
                    yield _columns(s, draw, shard)
                    s, draw, shard, held = [], [], [], 0
            if held:
                yield _columns(s, draw, shard)

    return map_arrow(spark.range(0, shards, 1, tasks), walk, "s int, draw long, shard int")


def _columns(*parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["s", "draw", "shard"])


def _with_draws(rows: DataFrame, plan: MixPlan, ids: list[str]) -> DataFrame:
    """rows (s, block, h and more) with draws (array of (pass, shard))."""
    blocks = F.broadcast(plan.blocks) if plan.n_blocks <= BROADCAST_BLOCKS else plan.blocks
    met = rows.join(blocks, ["s", "block"])
    whole = met.where(~F.col("pooled"))
    single = _numbered(met.where(F.col("pooled")), ids).join(plan.picks.withColumn("picked", F.lit(True)), ["s", "block", "nth"], "left")
    single = single.withColumn("draws", F.when(F.col("picked"), F.col("draws")).otherwise(F.filter("draws", lambda d: d["pass"] < F.col("passes"))))
    return whole.drop("passes", "pooled", "h").unionByName(single.drop("passes", "pooled", "h", "nth", "picked"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_rows: int | None = None, shard_words: int | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, draws (array of (pass, shard)).

    taken = size * number of draws. Sources are ordered by code point, null last, and weigh weights,
    repeated as needed. A source's taken words come as near its target as the documents about its last
    block allow. Null texts and texts without words have size 0 and may be drawn or not; a source of
    size 0 has target 0. Repeated rows count each. Reruns agree: places depend on ids, texts and seed
    alone. Texts are read whole, however long; other columns are ignored whatever their names; an empty
    table gives an empty result.
    """
    plan, sized = plan_mix(docs, weights, seed, id_col, source_col, text_col, block_rows, shard_words, max_repeats)
    placed = _with_source(sized, plan.sources, plan.n_sources, plan.rows)
    out = _with_draws(placed, plan, ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def draw_rows(docs: DataFrame, plan: MixPlan, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the plan draws it, with their columns and _shard; by shard, shuffled within it.

    Rows find their block by their own id, text and source, so rows that repeat an id get each its
    own draws. Null, empty and long texts and null sources are as in mix_sources(); columns of docs may
    have any name but _shard; an empty table gives an empty result.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), _source_key(F.col(source_col)).alias("key"), _hash(id_col, text_col).alias("h"))
    placed = _with_source(named, plan.sources, plan.n_sources, plan.rows).select("s", "block", "h", "row", "id", F.xxhash64(F.lit(seed), "h").alias("order"))
    drawn = _with_draws(placed, plan, ["id"]).withColumn("draw", F.explode("draws"))
    drawn = drawn.select("row", F.col("draw.shard").alias("_shard"), F.xxhash64("order", "draw.pass").alias("order"))
    return drawn.repartition("_shard").sortWithinPartitions("_shard", "order").select("row.*", "_shard")
