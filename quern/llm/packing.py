"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Best fit only looks at lengths, and pieces of one length are interchangeable. So the plan is made
from the histogram of lengths (as many rows as the capacity has tokens, whatever the corpus): lengths
go down, and a segment tree over remaining capacities finds the tightest open sequence in logarithmic
time. All pieces of a length that go to sequences with the same room are placed in one step, exactly
as best-fit decreasing would place them one by one. The plan maps ranks within a length to runs of
sequences; each piece then looks up its own rank.
"""

from __future__ import annotations

import json
import random
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, write_table

CAPACITY = 1024
#: Written after each document.
END_ID = 2
#: How byte-level BPE splits a text before merging. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ("", " ", "It's  a\n\n test,\t\u00e9t\u00e9 12 345!", "  two\r\n \u00a0 \u4f60\u597d\U0001f600 x<|endoftext|>y", "aaaaaaaaaaaaaaaa____----  ")


class Vocabulary:
    """Token ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    Where the file is plain byte-level BPE (see plain_byte_bpe), its vocabulary and special tokens go
    to tiktoken, which gives the same ids as the tokenizers library in a quarter of its time; each
    worker also compares both on PROBES and on words put together from the vocabulary when it loads the
    file, and keeps to the tokenizers library if they differ. Texts that tiktoken can't encode, as
    with a million white-space characters in a row, go to the tokenizers library too, which is
    loaded again then: a worker holds one of both.
    """

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        self.path = path
        self._slow = None
        self.fast = _tiktoken_of(path)
        if self.fast is not None and any(self.encode(t) != self.encode_slowly(t) for t in [*PROBES, *_made_up(self.fast)]):
            self.fast = None
        if self.fast is not None:
            self._slow = None

    @property
    def tokenizer(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode_slowly(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None:
            return self.encode_slowly(text)
        try:
            return array("I", self.fast.encode(text, allowed_special="all", disallowed_special=())).tobytes()
        except ValueError:  # its splitting expression ran out of stack
            return self.encode_slowly(text)


def plain_byte_bpe(file: dict) -> bool:
    """Whether a tokenizer file says byte-level BPE and nothing besides: no normaliser, the usual splitting, special tokens that match as they are, and merges in the order of the ids they make."""
    model, before = file.get("model") or {}, file.get("pre_tokenizer") or {}
    if file.get("normalizer") or model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get(k) for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    special = {t["content"] for t in file.get("added_tokens", [])}
    return None not in made and all(x < y for x, y in zip(made, made[1:], strict=False)) and len(made) + 256 == sum(w not in special for w in vocab)


def _made_up(encoding) -> list[str]:
    """Words put together from pieces of the vocabulary, the same each time: they try merges that run across pieces."""
    rng = random.Random(11)
    pieces = [encoding.decode_single_token_bytes(rng.randrange(encoding.n_vocab - 1)) for _ in range(4_000)]
    return [b"".join(pieces[i : i + 8]).decode("utf-8", "replace") for i in range(0, len(pieces), 8)]


def _tiktoken_of(path: str):
    """None where the file isn't plain byte-level BPE."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if not plain_byte_bpe(file):
        return None
    special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    try:
        ranks = {bytes(byte_of[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    except (KeyError, TypeError, ValueError):
        return None


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Of a document of n tokens; only documents above the capacity are cut, and their first piece takes the remainder."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, and part and place (place among the pieces of that length of its partition)."""
    end = array("I", [end_id]).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, words = TaskContext.get().partitionId(), [0] * (capacity + 1), Vocabulary.load(vocabulary)
        for batch in batches:
            which, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = words.encode(text.as_py() or "") + end
                start = 0
                for piece, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    which.append(i)
                    rows.append((piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n]))
                    seen[n] += 1
                    start += n
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long")


class RoomTree:
    """A segment tree over remaining capacities: how many runs of open sequences have just that room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` that an open sequence has."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, number, first sequence, offset) for runs of pieces and sequences, and the number of sequences."""
    tree, runs = RoomTree(capacity), [deque() for _ in range(capacity + 1)]
    plan, opened = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            runs[room].append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = opened, -(-left // per)
                opened += n
            else:
                first, n = runs[room].popleft()
                tree.add(room, -1)
                per = room // length
            # a sequence is filled with `per` pieces before best fit turns to the next one
            full = min(n, left // per)
            for k in range(per if full else 0):
                plan.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * per
            leave(room - per * length, first, full)
            if full < n and left < per:
                for k in range(left):
                    plan.append((length, rank, 1, first + full, capacity - room + k * length))
                    rank += 1
                if left:
                    leave(room - left * length, first + full, 1)
                    full += 1
                    left = 0
            leave(room, first + full, n - full)
    return plan, opened


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is one piece, the end id. Long texts are cut, never dropped.
    Repeated rows are packed each. Other columns don't matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = write_table(tokenise(docs, vocabulary, capacity, end_id, id_col, text_col), "pack-pieces")
    cells = write_table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, _ = best_fit_decreasing(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the cells grow with the input's partitions: never broadcast, however small their files look
    ranked = pieces.join(cells.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)  # a few runs for each pair of lengths at most, whatever the corpus
    return map_arrow(ranked, _placer(shared), f"doc_id {ranked.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _placer(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        wide = np.int64(1) << 48
        starts = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = np.searchsorted(starts, length * wide + rank, side="right") - 1
            sequence, offset = plan[run, 3] + rank - plan[run, 1], plan[run, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place
