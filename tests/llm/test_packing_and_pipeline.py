import json
import random
import zlib
from array import array

import public_tokenizers
import pytest

import corpus_pipeline
from quern.llm.common import drop_since, read_table, release_memory, written
from quern.llm.mixing import targets
from quern.llm.packing import RoomTree, Vocabulary, best_fit_decreasing, pack, piece_lengths, plain_byte_bpe
from quern.llm.quality import fit_on
from quern.llm.queries import tokenizer_path

from .helpers import WORD, awkward, documents

PATH = tokenizer_path()


def one_by_one(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


def test_plan_against_one_by_one():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([1, 7, 16, 40, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        plan, opened = best_fit_decreasing(counts, capacity)
        held, ranks = {}, {}
        for length, rank, n, first, offset in plan:
            for i in range(n):
                held.setdefault(first + i, []).append((offset, length))
                ranks.setdefault(length, []).append(rank + i)
        assert all(sorted(ranks[k]) == list(range(v)) for k, v in counts.items())
        rooms = []
        for pieces in held.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            rooms.append(capacity - at)
        assert len(rooms) == opened and sorted(rooms) == one_by_one(counts, capacity)


def test_plan_does_not_grow_with_the_corpus():
    rng = random.Random(1)
    counts = {n: rng.randint(0, 50) for n in range(1, 1025)}
    small, _ = best_fit_decreasing({k: v for k, v in counts.items() if v})
    large, opened = best_fit_decreasing({k: v * 1_000_000 for k, v in counts.items() if v})
    assert len(large) < 3 * len(small) + 1000
    assert opened <= 1.03 * sum(k * v * 1_000_000 for k, v in counts.items()) / 1024


def test_room_tree():
    rng, tree, open_ = random.Random(2), RoomTree(100), {}
    for _ in range(2000):
        room = rng.randint(1, 100)
        if rng.random() < 0.5 and open_.get(room):
            open_[room] -= 1
            tree.add(room, -1)
        else:
            open_[room] = open_.get(room, 0) + 1
            tree.add(room, 1)
        least = rng.randint(1, 100)
        assert tree.tightest(least) == min((r for r, n in open_.items() if n and r >= least), default=None)


TEXTS = ["", " ", "It's  a\n\n test,\tété 12 345!", "  two\r\n   你好\U0001f600 x<|endoftext|>y", "a" * 500 + "_" * 70, "\x1c\x85   b", "don't I'll we've", "tail  "]


def test_ids_are_those_of_the_tokenizer_file():
    from tokenizers import Tokenizer

    known, own = Tokenizer.from_file(PATH), Vocabulary.load(PATH)
    assert own.fast is not None
    for text in TEXTS + [t or "" for _, t in awkward()]:
        assert own.encode(text) == array("I", known.encode(text, add_special_tokens=False).ids).tobytes()
    other = Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and other.encode("a b") == other.encode_slowly("a b")


def test_only_plain_byte_bpe_goes_to_the_fast_library():
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    assert plain_byte_bpe(json.loads(text))
    for change in (
        lambda f: f.update(normalizer={"type": "NFC"}),
        lambda f: f["pre_tokenizer"].update(add_prefix_space=True),
        lambda f: f["pre_tokenizer"].update(use_regex=False),
        lambda f: f["model"].update(ignore_merges=True),
        lambda f: f["model"].update(dropout=0.1),
        lambda f: f["added_tokens"][0].update(lstrip=True),
        lambda f: f["model"]["merges"].reverse(),
        lambda f: f["model"]["merges"].pop(),
    ):
        file = json.loads(text)
        change(file)
        assert not plain_byte_bpe(file)


def check_packing(rows, out, capacity):
    own = Vocabulary.load(PATH)
    want = []
    for i, text in rows:
        ids = own.encode(text or "") + array("I", [2]).tobytes()
        start = 0
        for piece, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
            want.append((i, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            start += n
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = {}
    for *_, n, _ in want:
        lengths[n] = lengths.get(n, 0) + 1
    assert len(held) == len(one_by_one(lengths, capacity))


@pytest.mark.parametrize("capacity", [1024, 64])
def test_pack(spark, capacity):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(TEXTS * 5)]
    check_packing(rows, pack(documents(spark, rows, extra=True).repartition(3), PATH, capacity=capacity).collect(), capacity)
    assert pack(documents(spark, []), PATH).count() == 0


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    from .test_models import labelled

    folder = str(tmp_path_factory.mktemp("tables"))
    rows = labelled(300, 7)
    base = [(i, t, f"s{i % 4}" if i % 3 else None) for i, t, *_ in rows]
    copies = [(1000 + i, t, "s0") for i, t, _ in base[:60]] + [(2000 + i, t + " tail", "s1") for i, t, _ in base[60:120]]
    documents(spark, base + copies + [(5000, None, None), (5001, "", "s9"), (5002, None, None)]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, small, tmp_path):
    from .test_minhash import plain

    docs = read_table(spark, small, "documents")
    columns, held = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{k}")
        held.append((name, docs, docs := spark.read.parquet(f"{tmp_path}/{k}")))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    pairs = {name: ([(r["doc_id"], r["text"]) for r in a.collect()], b.collect()) for name, a, b in held}
    before, after = pairs["quality"]
    assert {r["doc_id"] for r in after} < {i for i, _ in before} and len(after) > 0.5 * len(before)
    before, after = pairs["exact"]
    last = {}
    for i, t in before:
        last[t or ""] = max(i, last.get(t or "", -1))
    assert sorted(r["doc_id"] for r in after) == sorted(last.values())
    before, after = pairs["near"]
    assert sorted(r["doc_id"] for r in after) == [i for i, _, _, kept in plain(before) if kept]
    before, after = pairs["mix"]
    ids = [r["doc_id"] for r in after]
    assert set(ids) <= {i for i, _ in before} and max(map(ids.count, set(ids))) <= 3
    before, after = pairs["packing"]
    check_packing(before, after, 1024)


def test_stages_give_native_memory_back(spark, small, monkeypatch):
    assert release_memory(spark)  # the tests' JVM has the command
    asked = []
    monkeypatch.setattr(corpus_pipeline, "release_memory", asked.append)
    stages = dict(corpus_pipeline.STAGES)
    stages["exact"](spark, read_table(spark, small, "documents").limit(3), small)
    assert asked == [spark, spark]
    assert all(hasattr(stage, "__wrapped__") for stage in stages.values())


def test_run(spark, small):
    """run() against its stages done plainly: model scores, a dictionary of texts, all pairs, targets by hand, and one piece after the other."""
    from .test_minhash import plain

    docs = read_table(spark, small, "documents")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    model = fit_on(docs, read_table(spark, small, "labels"))
    good = [r for r, s in zip(rows, model.scores([t for _, t, _ in rows]), strict=True) if s >= 0.5]
    last = {}
    for i, t, _ in good:
        last[t or ""] = max(i, last.get(t or "", -1))
    single = [r for r in good if last[r[1] or ""] == r[0]]
    stays = {i for i, _, _, kept in plain([r[:2] for r in single]) if kept}
    near = [r for r in single if r[0] in stays]

    out = corpus_pipeline.run(spark, small).collect()
    copies = {}
    for r in out:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + (r["piece"] == 0)
    assert set(copies) <= {i for i, *_ in near} and max(copies.values()) <= 3
    size = {i: len(WORD.findall(t or "")) for i, t, _ in near}
    names = sorted({s for *_, s in near}, key=lambda s: (s is None, s or ""))
    goal = targets([sum(size[i] for i, _, s in near if s == n) for n in names], [(1.0, 2.0, 3.0)[k % 3] for k in range(len(names))])
    for n, want in zip(names, goal, strict=True):
        own = [i for i, _, s in near if s == n]
        assert abs(sum(size[i] * copies.get(i, 0) for i in own) - want) <= max(map(size.get, own))
    check_packing([(i, t) for i, t, _ in near for _ in range(copies.get(i, 0))], out, 1024)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_run_leaves_only_what_its_result_reads(spark, small):
    mark = written()
    out = corpus_pipeline.run(spark, small)
    assert written() - mark <= 4  # the last stage's input and its tables
    assert out.count() > 0
    drop_since(spark, mark)
    assert written() == mark


@pytest.mark.parametrize("text", [" " * 1_000_001 + "x", "a" + "\t" * 1_000_001 + "b", "\n" * 1_200_000])
def test_very_long_white_space(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert list(array("I", Vocabulary.load(PATH).encode(text))) == ids


def test_pack_very_long_white_space(spark):
    rows = [(1, "one"), (2, " " * 1_000_001 + "x"), (3, "two")]
    got = pack(documents(spark, rows), PATH).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {i: len(Vocabulary.load(PATH).encode_slowly(t)) // 4 + 1 for i, t in rows}
