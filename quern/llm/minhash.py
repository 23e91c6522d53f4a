"""Near-duplicates by b-bit MinHash.

Signatures: the minima of PERMUTATIONS hash functions over a document's set of shingles. Bands of
rows of whole minima generate candidates; beside them only the BITS low bits of the minima are kept,
packed into longs, and counting equal lanes gives the similarity once chance agreement (one in
2 ** BITS) is taken out. Candidates that this estimate can't rule out are confirmed on full sets.

Documents with equal sets form one class, and all work is on classes. A band bucket never emits all
its pairs: first each member meets the bucket's pivot. Confirmed links join components, which settles
almost every bucket. In those that still hold more than one component, the members outside the
largest one are compared, in blocks and by packed signature, with the members of other components, and
the pairs that pass are confirmed too. So every pair of a bucket is either in one component already
or has been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_arrow, skew_safe_join, skew_safe_lookup, write_table
from .components import connected_components, joined_components
from .url_filter import bloom_words, might_contain

#: Bands of rows; a pair at similarity 0.8 shares no band once in 8 million.
BANDS, ROWS = 40, 5
PERMUTATIONS = BANDS * ROWS
#: Low bits kept of a minimum, and packed minima: six longs of 32 lanes.
BITS = 2
LANES = 192
LONGS = LANES * BITS // 64
#: Links need PERCENT / 100 similarity; an estimate six standard errors lower rules a pair out.
PERCENT = 80
LEAST_ESTIMATE = 0.60
#: Members of a confirmation block and of a comparison block, about.
CONFIRM_ROWS = 64
COMPARE_ROWS = 256
#: Elements of the sets that are compared at once, on either side, about; words whose hashes a worker remembers.
CHUNK_ELEMENTS = 500_000
REMEMBERED = 200_000

_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = (_RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct 2-word shingles; A-Z are lowered, words end at space and bytes 9 to 13; one word alone is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(_mix(h[:-1] * _A + h[1:] * _B)) if len(h) > 1 else _mix(h)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(1, min(PERMUTATIONS, (1 << 19) // len(x)))
    out = np.empty(PERMUTATIONS, np.uint32)
    for i in range(0, PERMUTATIONS, step):
        part = slice(i, i + step)
        out[part] = (x[None, :] * _MUL[part, None] + _ADD[part, None]).min(axis=1)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    h = _BAND.copy()
    for i in range(ROWS):
        h = _mix(h ^ (rows[:, i] * _B))
    return h.view(np.int64)


def pack_bits(low: np.ndarray) -> np.ndarray:
    lanes = (low[:LANES] & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, 64 // BITS)
    return np.bitwise_or.reduce(lanes << np.arange(0, 64, BITS, dtype=np.uint64), axis=1).view(np.int64)


def estimate(equal: np.ndarray | Column):
    """Similarity from the number of equal lanes, without those equal by chance."""
    chance = 1 / (1 << BITS)
    return (equal / LANES - chance) / (1 - chance)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            n, prints, bands, packed = [], [], [], []
            for text in part.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                if len(s):
                    low = minima(s)
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(low))
                    packed.append(pack_bits(low))
                else:
                    prints.append(None)
                    bands.append(None)
                    packed.append(None)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, lists), pa.array(packed, lists)], ["doc_id", "n", "print", "bands", "packed"])


def _equal_lanes(a: str, b: str) -> Column:
    """Lanes of 2 bits that are equal in two packed signatures."""
    total = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        differ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total + F.bit_count(differ)
    return F.lit(LANES) - total


def _passing(pairs: DataFrame, n_pairs: int, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and estimate don't rule out. A pivot meets its many pairs by a skew-safe lookup."""
    asked = pairs.groupBy(F.col("a").alias("doc_id")).agg(F.count(F.lit(1)).alias("asked"))
    left = classes.join(asked, "doc_id").select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("packed").alias("pa"), "asked")
    right = classes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("packed").alias("pb"))
    met = skew_safe_lookup(pairs, left, ["a"], "asked", n_pairs).join(right, "b")
    met = met.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    return met.where(estimate(_equal_lanes("pa", "pb")) >= LEAST_ESTIMATE).select("a", "b").distinct()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by a and block, a's own text before those of its candidates."""
    key, own = None, None
    for batch in batches:
        out = []
        for a, block, candidate, b, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
            if not candidate:
                if key != (a, block):
                    key, own = (a, block), []
                own.append(shingle_set(text.as_py()))
            elif key == (a, block):
                s = shingle_set(text.as_py())
                for x in own:
                    if 100 * min(len(s), len(x)) >= PERCENT * max(len(s), len(x)):
                        both = len(np.intersect1d(x, s, assume_unique=True))
                        if 100 * both >= PERCENT * (len(x) + len(s) - both):
                            out.append((a, b))
                            break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], batch.schema.field(0).type), pa.array([p[1] for p in out], batch.schema.field(0).type)], ["a", "b"])


def _confirmed(pairs: DataFrame, n_pairs: int, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Each block of a's candidates gets a copy of a's text."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = skew_safe_lookup(pairs, sizes, ["a"], "n", n_pairs).withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CONFIRM_ROWS)).cast("int"))
    asked = dealt.select("a", "block", F.lit(True).alias("candidate"), F.col("b").alias("id"))
    asked = asked.union(dealt.select("a", "block").distinct().select("a", "block", F.lit(False), F.col("a")))
    rows = asked.join(texts, "id").select("a", "block", "candidate", F.col("id").alias("b"), "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "candidate")
    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(rows, _confirm, f"a {kind}, b {kind}").distinct()


class _Forest:
    """Union-find over whatever is asked for."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _dealt(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows (key, cls, comp), n_rows of them, in pairs of blocks: ob, mb, member and those columns.

    Within a key, the members outside its largest component are the outsiders. Each block of
    outsiders meets each block of all members, so every pair across components meets, and a row is
    copied once for each opposite block, not for each opposite row.
    """
    counts = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy(key).agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    main = main.select(key, "main", F.ceil(F.col("all") / COMPARE_ROWS).cast("int").alias("all_blocks"), F.ceil((F.col("all") - F.col("most")) / COMPARE_ROWS).cast("int").alias("out_blocks"), "all").where("out_blocks > 0")
    met = skew_safe_lookup(rows, main, [key], "all", n_rows).where("main is not null")
    spread = F.xxhash64("cls")
    outside = met.where("comp <> main").select(key, F.pmod(spread, F.col("out_blocks")).cast("int").alias("ob"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("mb"), F.lit(False).alias("member"), "cls", "comp")
    inside = met.select(key, F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("ob"), F.pmod(spread, F.col("all_blocks")).cast("int").alias("mb"), F.lit(True).alias("member"), "cls", "comp")
    return outside.union(inside)


def _near_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and pair of blocks, the outsiders first. Gives pairs of components that the estimate can't tell apart, a spanning forest for each pair of blocks."""
    key, comps, sizes, packed, waiting, seen = None, None, None, None, [], _Forest()
    mask = np.uint64(0x5555555555555555)
    for batch in batches:
        cols = batch.columns
        where = list(zip(*(cols[i].to_pylist() for i in range(3)), strict=True))
        member = cols[3].to_numpy(zero_copy_only=False)
        comp, n = (cols[i].to_numpy(zero_copy_only=False) for i in (5, 6))
        sig = cols[7].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, LONGS)
        found = []
        for i, w in enumerate(where):
            if w != key:
                key, waiting, packed, seen = w, [], None, _Forest()
            if not member[i]:
                waiting.append((comp[i], n[i], sig[i].copy()))
                continue
            if not waiting:
                continue
            if packed is None:
                comps, sizes = (np.array([x[k] for x in waiting]) for k in range(2))
                packed = np.array([x[2] for x in waiting])
            x = packed ^ sig[i]
            equal = LANES - np.bitwise_count((x | (x >> np.uint64(1))) & mask).sum(axis=1).astype(np.int64)
            ok = (estimate(equal) >= LEAST_ESTIMATE) & (comps != comp[i]) & (100 * np.minimum(sizes, n[i]) >= PERCENT * np.maximum(sizes, n[i]))
            found += [(int(c), int(comp[i])) for c in np.unique(comps[ok]) if seen.join(int(c), int(comp[i]))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every set in left with every set in right, by products of 0-1 matrices over slices of the shared elements."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[at]
    owner, at = owner[use], number[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(at, (start, start + width))
        held = np.zeros((len(sets), width), np.float32)
        held[owner[i:j], at[i:j] - start] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out.astype(np.int64)


def _chunks(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Runs of rows whose sets hold CHUNK_ELEMENTS at most (one set may hold more)."""
    chunk, held = [], 0
    for row in rows:
        if chunk and held + len(row[2]) > CHUNK_ELEMENTS:
            yield chunk
            chunk, held = [], 0
        chunk.append(row)
        held += len(row[2])
    if chunk:
        yield chunk


def _links_of_blocks(outsiders: list[tuple[int, int, np.ndarray]], members: list[tuple[int, int, np.ndarray]], forest: _Forest) -> list[tuple[int, int]]:
    links = []
    for left in _chunks(outsiders):
        both = intersections([x[2] for x in left], [x[2] for x in members])
        n_out, n_in = (np.array([len(x[2]) for x in side]) for side in (left, members))
        c_out, c_in = (np.array([x[1] for x in side]) for side in (left, members))
        linked = (100 * both >= PERCENT * (n_out[:, None] + n_in[None, :] - both)) & (c_out[:, None] != c_in[None, :])
        links += [(left[i][0], members[j][0]) for i, j in np.argwhere(linked) if forest.join(int(c_out[i]), int(c_in[j]))]
    return links


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by family and pair of blocks, the outsiders first. Gives confirmed links across components, a spanning forest for each pair of blocks. Sets are compared in chunks of CHUNK_ELEMENTS."""
    key, outsiders, members, held, forest = None, [], [], 0, _Forest()
    found: list[tuple[int, int]] = []
    for batch in batches:
        for *where, member, cls, comp, text in zip(*(c.to_pylist() for c in batch.columns[:6]), batch.column(6), strict=True):
            if where != key:
                found += _links_of_blocks(outsiders, members, forest) if members else []
                key, outsiders, members, held, forest = where, [], [], 0, _Forest()
            row = (cls, comp, shingle_set(text.as_py()))
            if not member:
                outsiders.append(row)
            elif outsiders:
                if members and held + len(row[2]) > CHUNK_ELEMENTS:
                    found += _links_of_blocks(outsiders, members, forest)
                    members, held = [], 0
                members.append(row)
                held += len(row[2])
        if found:
            yield _pairs_batch(found)
            found = []
    if members and (found := _links_of_blocks(outsiders, members, forest)):
        yield _pairs_batch(found)


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _across(live: DataFrame, n_live: int, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between different components whose members share a bucket.

    Components with a pair in one bucket that the estimate can't rule out form a family; families are
    compared on full sets, outsiders with members, in blocks.
    """
    known = live.where("members > 2").join(labels, live["cls"] == labels["node"], "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    signed = _dealt(known, "key", n_live).join(classes.select(F.col("doc_id").alias("cls"), "n", "packed"), "cls").select("key", "ob", "mb", "member", "cls", "comp", "n", "packed")
    signed = signed.repartition("key", "ob", "mb").sortWithinPartitions("key", "ob", "mb", "member")
    near = write_table(map_arrow(signed, _near_components, "a long, b long").distinct(), "minhash-near")
    families = connected_components(near).select(F.col("node").alias("comp"), F.col("comp").alias("family"))
    rows = live.select("cls").distinct().join(labels, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("comp", "cls").alias("comp")).join(families, "comp").select("family", "cls", "comp")
    rows = write_table(rows, "minhash-families")
    full = _dealt(rows, "family", rows.count()).join(texts, F.col("cls") == F.col("id")).select("family", "ob", "mb", "member", "cls", "comp", "text")
    full = full.repartition("family", "ob", "mb").sortWithinPartitions("family", "ob", "mb", "member")
    more = write_table(map_arrow(full, _exact_links, "a long, b long").distinct(), "minhash-across")
    for done in (near, families, rows):
        drop_table(done)
    return more


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Two documents are linked when the sets of their 2-word shingles have a similarity of PERCENT / 100
    or more. Null and empty texts and texts without words have no shingle and no link: component_id
    is their own id. Rows that repeat an id count as one document, linked by any of their texts. A
    null id is no document's smallest; where all ids of equal sets are null component_id is null. Ids
    are integers. Other columns don't matter; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = write_table(map_arrow(rows, _signatures, "doc_id long, n long, print binary, bands array<long>, packed array<long>"), "minhash-signatures")
    groups = write_table(signed.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "minhash-classes")
    reps = groups.select("print", F.col("rep").alias("doc_id"))
    classes = write_table(signed.join(reps, ["print", "doc_id"], "left_semi").select("doc_id", "n", "bands", "packed"), "minhash-reps")

    banded = classes.select(F.explode("bands").alias("key"), F.col("doc_id").alias("cls"))
    buckets = write_table(banded.groupBy("key").agg(F.min("cls").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1"), "minhash-buckets")
    live = write_table(skew_safe_join(banded, buckets, "key", "members", classes.count() * BANDS), "minhash-live")
    drop_table(buckets)
    stars = write_table(live.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct(), "minhash-stars")
    first = write_table(_passing(stars, stars.count(), classes), "minhash-pairs")

    wanted = live.select("cls").distinct()
    facts = wanted.agg(F.count(F.lit(1)).alias("n")).first()
    bloom, blocks = bloom_words(wanted.select(F.col("cls").cast("string").alias("key")), facts["n"])
    near = rows.withColumn("_words", bloom.scalar()).where(might_contain(F.col("_words"), F.col("doc_id").cast("string"), blocks)).drop("_words")
    texts = write_table(near.join(wanted, near["doc_id"] == wanted["cls"], "left_semi").select(F.col("doc_id").alias("id"), "text"), "minhash-texts")

    links = write_table(_confirmed(first, first.count(), texts), "minhash-links")
    labels = connected_components(links)
    more = _across(live, live.count(), labels, classes, texts)
    if not more.isEmpty():
        labels = joined_components(labels, more)
    for done in (classes, live, stars, first, texts, links, more):
        drop_table(done)
    table = groups.join(labels, groups["rep"] == labels["node"], "left").select("print", F.coalesce("comp", "rep").alias("component_id"), "copies")
    total = signed.count()
    found = skew_safe_lookup(signed.where("print is not null").select("print", "doc_id", "n"), table, ["print"], "copies", total)
    found = found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("print is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: the document with the smallest id of each group.

    Null, empty and long texts, null ids, repeated rows and empty tables are as in near_duplicates(); a
    row with a null id stays. Columns may have any name.
    """
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_q_gone")).where("_q_gone is not null").distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_q_gone"], "left_anti")
