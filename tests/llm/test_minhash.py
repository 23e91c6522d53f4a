import itertools
import random

import numpy as np
import pytest

from quern.llm.components import connected_components
from quern.llm.minhash import LANES, LONGS, distinct_rows, estimate, intersections, minima, near_duplicates, pack_bits, shingle_set

from .helpers import awkward, corpus, documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()


def plain(rows):
    sets, up = {}, {}
    for i, t, *_ in rows:
        sets.setdefault(i, []).append(shingles(t))
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(i, s) for i, v in sets.items() for s in v if s], 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(shingles(t)), root(i), root(i) == i) for i, t, *_ in rows)


@pytest.mark.parametrize("rows", [awkward(), corpus(400)])
def test_against_all_pairs(spark, rows):
    got = near_duplicates(documents(spark, rows, extra=True))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_drifting_family(spark):
    """Neighbours are linked and ends are not, so no pivot sees all; and strangers of 0.7 stay apart."""
    rng = random.Random(5)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(w)))
    for i in range(150, 300):
        v = w[:]
        for _ in range(20):
            v[rng.randrange(200)] = f"x{i}y{rng.random()}"
        rows.append((i, " ".join(v)))
    assert sorted(map(tuple, near_duplicates(documents(spark, rows)).collect())) == plain(rows)


def test_empty_null_ids_and_pipeline_rows(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    got = near_duplicates(documents(spark, [(None, "a b c"), (None, None), (4, "a b c")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 4), (4, 4)]
    docs = documents(spark, corpus(80), extra=True)
    kept = distinct_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, k in plain(corpus(80)) if k]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    seen = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (800, 100, 100))
        x, y = (pack_bits(minima(np.concatenate([both, z]))).view(np.uint64) for z in (a, b))
        d = x ^ y
        equal = LANES - int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
        seen.append(estimate(equal))
    assert LONGS * 32 == LANES and abs(np.mean(seen) - 0.8) < 0.02 and 0.015 < np.std(seen) < 0.06


def test_intersections_in_slices():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(25)]
    got = intersections(sets[:10], sets[10:], width=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]


def test_shingles_of_one_word_and_spaces():
    assert len(shingle_set("A")) == 1 and (shingle_set("A") == shingle_set(" a\t")).all()
    assert len(shingle_set("a\x0bb\x0cc")) == 2 and len(shingle_set("a b\x1cc")) == 1
    assert len(shingle_set("É é")) == 1 and not (shingle_set("É") == shingle_set("é")).all()


def test_components_of_a_long_path(spark):
    ids = list(range(1, 60))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in ids} | {100: 100, 101: 100}
