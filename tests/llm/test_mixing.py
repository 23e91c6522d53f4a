import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm.mixing import draw_rows, draws_of_shards, fill, leaves, mix_sources, plan_mix, targets

from .helpers import WORD, awkward, documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(1.0, 2.0, 3.0)[i % 3] for i in range(len(sizes))]
    t = targets(sizes, weights)
    assert sum(t) == pytest.approx(sum(sizes))
    free = [(x / w) for x, w, s in zip(t, weights, sizes, strict=True) if x < 3 * s - 1e-9]
    assert all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))  # those below their limit share by weight
    assert all(x / w <= (free[0] if free else float("inf")) + 1e-6 for x, w in zip(t, weights, strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=8), st.integers(1, 37), st.integers(0, 5))
def test_splitting_tree(quotas, shards, seed):
    found = list(leaves(quotas, shards, seed))
    assert [k for k, _, _ in found] == list(range(shards))
    t = np.array([have for _, _, have in found])
    assert (t >= 0).all() and list(t.sum(axis=0)) == quotas
    rows = t.sum(axis=1)
    assert rows.max() - rows.min() <= max(1, int(np.ceil(np.log2(shards + 1))))
    assert (np.array([before for _, before, _ in found]) == np.cumsum(t, axis=0) - t).all()
    part = list(leaves(quotas, shards, seed, shards // 3, shards // 3 + 2))  # a task that holds some of the shards sees what the others see
    for k, before, have in part:
        assert list(before) == list(found[k][1]) and list(have) == list(found[k][2])


def many(n=900):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else ["a", "b", None, "Z"][i % 4]
        rows.append((i, " ".join(["w"] * (1 + i * 7 % 61)), source))
    return rows


def test_mix_meets_targets(spark):
    rows = many()
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    got = mix_sources(documents(spark, rows, extra=True), block_rows=16, shard_words=2000).collect()
    assert {r["doc_id"]: r["size"] for r in got} == size
    names = ["Z", "a", "b", "hot", None]
    sums = [sum(size[i] for i, _, s in rows if s == n) for n in names]
    want = dict(zip(names, targets(sums, [1.0, 2.0, 3.0, 1.0, 2.0]), strict=True))
    source = {i: s for i, _, s in rows}
    for n, total in zip(names, sums, strict=True):
        mine = [r for r in got if source[r["doc_id"]] == n]
        assert {r["source_size"] for r in mine} == {total} and {r["target"] for r in mine} == {want[n]}
        assert abs(sum(r["taken"] for r in mine) - want[n]) <= 61
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["taken"] == r["size"] * len(r["draws"]) for r in got)
    shards = {}
    for r in got:
        for d in r["draws"]:
            shards[d["shard"]] = shards.get(d["shard"], 0) + r["size"]
    assert len(shards) > 5 and max(shards.values()) < 3 * min(shards.values())
    assert len({d["pass"] for r in got for d in r["draws"]}) > 1


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark, many(300))
    a = mix_sources(docs, block_rows=16, shard_words=500).orderBy("doc_id").collect()
    assert a == mix_sources(docs.repartition(7), block_rows=16, shard_words=500).orderBy("doc_id").collect()


@given(st.lists(st.integers(0, 400), max_size=30), st.floats(0, 3000))
def test_fill_comes_near(sizes, need):
    taken = fill(sizes, need)
    assert len(set(taken)) == len(taken) and all(0 <= i < len(sizes) for i in taken)
    left, total = need, 0
    for n in sizes:  # never worse than taking what fits
        if n <= left:
            left -= n
    assert abs(need - sum(sizes[i] for i in taken)) <= left + 1e-9
    if sum(sizes) >= need and 1 in sizes and need >= 1:
        assert abs(need - sum(sizes[i] for i in taken)) <= max(sizes)


def test_a_hundred_thousand_shards(spark):
    quotas = [150_000, 7, 90_000, 0, 60_001]
    got = draws_of_shards(spark, np.array(quotas), 100_000).toPandas()
    assert [int((got["s"] == i).sum()) for i in range(5)] == quotas
    for i, q in enumerate(quotas):
        assert sorted(got.loc[got["s"] == i, "draw"]) == list(range(q))
    held = got.groupby("shard").size()
    assert len(held) == 100_000 and held.max() - held.min() <= 17


def test_small_tables_have_several_shards_and_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mix_sources(docs).withColumn("source", F.lit("")).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, goal = {}, {}
    for r in got:
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        goal[source[r["doc_id"]]] = r["target"]
    assert len({d["shard"] for r in got for d in r["draws"]}) > 8
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in goal), {s: (taken[s], goal[s]) for s in goal}
    shards = {}
    for r in got:
        for d in r["draws"]:
            shards.setdefault(d["shard"], set()).add(source[r["doc_id"]])
    assert min(map(len, shards.values())) >= 3  # the tree gives each shard a share of many sources


def test_drawn_rows(spark):
    docs = documents(spark, many(120), extra=True)
    plan, _ = plan_mix(docs, block_rows=8, shard_words=300)
    out = draw_rows(docs, plan)
    assert out.columns == [*docs.columns, "_shard"]
    rows = out.collect()
    count = {}
    for r in rows:
        count[r["doc_id"], r["_shard"]] = count.get((r["doc_id"], r["_shard"]), 0) + 1
    want = {}
    for r in mix_sources(docs, block_rows=8, shard_words=300).collect():
        for d in r["draws"]:
            want[r["doc_id"], d["shard"]] = want.get((r["doc_id"], d["shard"]), 0) + 1
    assert count == want
    ids = [r["doc_id"] for r in rows if r["_shard"] == rows[0]["_shard"]]
    assert len(ids) > 5 and ids != sorted(ids)  # shuffled within the shard


def test_rows_of_one_id_get_their_own_draws(spark):
    rows = [(7, " ".join([f"w{k}"] * (k % 13 + 1)), "a") for k in range(60)] + [(8, "same words here", "b")] * 40 + [(i, "x y z", None) for i in range(100, 140)]
    docs = documents(spark, rows)
    plan, _ = plan_mix(docs, block_rows=4)
    drawn = {}
    for r in draw_rows(docs, plan).collect():
        drawn[r["doc_id"], r["text"]] = drawn.get((r["doc_id"], r["text"]), 0) + 1
    words = {}
    for r in mix_sources(docs, block_rows=4).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for (i, t), n in drawn.items():
        got[i] = got.get(i, 0) + n * len(t.split())
    assert got == {i: n for i, n in words.items() if n}
    assert all(n <= 3 for (i, t), n in drawn.items() if i == 7) and drawn[8, "same words here"] <= 120


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    docs = documents(spark, many(300))
    a = mix_sources(docs, block_rows=16, shard_words=500).orderBy("doc_id").collect()
    monkeypatch.setattr("quern.llm.mixing.BROADCAST_SOURCES", 1)
    monkeypatch.setattr("quern.llm.mixing.BROADCAST_BLOCKS", 1)
    assert a == mix_sources(docs, block_rows=16, shard_words=500).orderBy("doc_id").collect()


def test_awkward_rows(spark):
    got = mix_sources(documents(spark, awkward(), extra=True)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in awkward())
    assert all(r["size"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 12))
    assert mix_sources(documents(spark, [])).count() == 0
    assert [r["target"] for r in mix_sources(documents(spark, [(1, None), (None, " ")])).collect()] == [0.0, 0.0]
