import random
import zlib

import numpy as np
import pytest

from quern.llm.labelled import fit_logistic, fold_of, labelled_sample, sigmoid
from quern.llm.quality import fit_quality, good_rows, score_quality
from quern.llm.toxicity import ToxicityModel, fit_toxicity, label_model, mine_lexicon, score_toxicity

from .helpers import awkward, documents

VOWELS, OTHERS = "aeiou", "bcdfglmnprst"


def word(rng):
    return "".join(rng.choice(OTHERS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4)))


def labelled(n=900, seed=1):
    """(doc_id, text, quality, toxic): bad texts shout, repeat or decorate; toxic ones hold two of ten insults or of a stem's forms."""
    rng = random.Random(seed)
    insults = ["grumbak", "zorfle", "snivet", "plonker"]
    rows = []
    for i in range(n):
        words = [word(rng) for _ in range(rng.randint(30, 200))]
        quality, toxic = int(rng.random() > 0.25), int(rng.random() < 0.2)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice([*insults, "wroxx" + word(rng)]))
        if not quality:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w for w in words for _ in range(8)] if kind == 1 else [w + rng.choice(["$$$", "%%%", "&&&"]) for w in words]
        rows.append((i, " ".join(words), quality, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled()
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    return rows, documents(spark, [(i, t) for i, t, *_ in rows], extra=True), labels


@pytest.mark.parametrize(("score", "label", "folds", "held"), [(score_quality, 2, 3, 1), (score_toxicity, 3, 5, 0)])
def test_held_out_accuracy(tables, score, label, folds, held):
    rows, docs, labels = tables
    truth = {r[0]: r[label] for r in rows}
    got = score(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.93


def test_held_out_labels_do_not_matter(spark, tables):
    rows, docs, labels = tables
    texts, y = labelled_sample(docs, labels, "quality", 3, 1)
    flipped = labels.withColumn("quality", (fold_of(labels["doc_id"], 3) == 1).cast("int") * (1 - labels["quality"]) + (fold_of(labels["doc_id"], 3) != 1).cast("int") * labels["quality"])
    again, z = labelled_sample(docs, flipped, "quality", 3, 1)
    assert texts == again and (y == z).all()
    assert len(labelled_sample(docs, labels, "quality", 3, 1, rows=50)[0]) == 50
    some, _ = labelled_sample(docs, labels, "quality", 3, 1, total=20_000)
    assert set(some) < set(texts) and 15_000 < sum(map(len, some)) <= 20_000


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_awkward_rows_and_labels(spark, tables, score):
    _, _, labels = tables
    none = labels.limit(0)
    got = score(documents(spark, awkward(), extra=True), none).collect()
    assert len(got) == len(awkward()) and all(r["score"] == 0.5 if score is score_quality else r["score"] < 0.1 and not r["predicted"] for r in got)
    odd = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 1, 1), (5, 0, 0), (999, 1, 0)], labels.schema)
    assert score(documents(spark, awkward()), odd).count() == len(awkward())
    assert score(documents(spark, []), labels).count() == 0


def test_equal_texts_get_equal_scores(spark, tables):
    rows, _, labels = tables
    docs = documents(spark, [(i, rows[i % 7][1]) for i in range(50_000, 50_049)] + [(i, t) for i, t, *_ in rows])
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, labels).collect()}
    assert all(got[i] == got[i % 7] for i in range(50_000, 50_049))


def test_good_rows_keep_columns(tables):
    rows, docs, _ = tables
    model = fit_quality([t for _, t, *_ in rows], np.array([q for *_, q, _ in rows], float))
    kept = good_rows(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum((i in ids) == bool(q) for i, _, q, _ in rows) / len(rows) > 0.95


def test_lexicon_and_model():
    rows = labelled(600, 2)
    texts, y = [t for _, t, *_ in rows], np.array([t for *_, t in rows], float)
    lexicon = [t for t, _ in mine_lexicon(texts, y)]
    assert any(t.rstrip("*") and "grumbak".startswith(t.rstrip("*")) for t in lexicon) and any(t.startswith("wrox") for t in lexicon)
    assert fit_toxicity(texts, y).scores([None, "", "you grumbak and wroxxanother zorfle"])[2] > 0.9


def test_nothing_to_mine_gives_a_low_prior():
    plain = [" ".join(word(random.Random(i)) for _ in range(60)) for i in range(60)]
    y = np.array([i % 10 == 0 for i in range(60)], float)  # labels that go with nothing
    for model in (fit_toxicity([], np.zeros(0)), fit_toxicity(plain, np.zeros(60)), fit_toxicity(plain, y)):
        none, one, more = model.scores(["a plain text", "a stupid text", "stupid idiot, you worthless moron"])
        assert none < 0.2 and none <= one < more and more > 0.5
        assert sum(s >= 0.5 for s in model.scores(plain)) <= 6


def test_several_hits_say_what_one_does_not():
    """Words with a toxic beginning stand once in clean texts too; only several of them speak, and only in short texts."""
    rng = random.Random(8)
    texts, y = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        words = [word(rng) for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(3, 6) if toxic else rng.random() < 0.25):
            words.insert(rng.randrange(len(words)), "zzorp" + word(rng))
        if not toxic and i % 12 == 0:
            words += [word(rng) for _ in range(1500)] + ["zzorp" + word(rng) for _ in range(2)]
        texts.append(" ".join(words))
        y.append(float(toxic))
    y = np.array(y)
    model = fit_toxicity(texts[:600], y[:600])
    hits, facts, _ = model.read_all(texts[600:])
    any_term = (hits >= model._least).any(axis=1)
    predicted = model.scores(texts[600:]) >= 0.5
    assert any(k == 2 for _, k in model.mined) and (predicted != any_term).any()
    assert (predicted == y[600:]).mean() > (any_term == y[600:]).mean() + 0.04


def whole_table(sf, label, folds, held):
    """Texts and labels of the sample's fold and of the held-out fold, straight from the files."""
    duckdb = pytest.importorskip("duckdb")
    rows = duckdb.sql(f"SELECT doc_id, text, {label} FROM '/root/testdata/{sf}/documents.parquet' JOIN '/root/testdata/{sf}/labels.parquet' USING (doc_id) WHERE {label} IS NOT NULL ORDER BY doc_id").fetchall()
    out = [zlib.crc32(str(i).encode()) % folds == held for i, *_ in rows]
    parts = [[r for r, o in zip(rows, out, strict=True) if o is side] for side in (False, True)]
    return [x for rs in parts for x in ([t or "" for _, t, _ in rs], np.array([float(y) for *_, y in rs]))]


def test_quality_of_the_held_out_fold():
    texts, y, other, truth = whole_table("sf0.1", "quality", 3, 1)
    model = fit_quality(texts, y)
    predicted = model.scores(other) >= 0.5
    assert (predicted == truth).mean() >= 0.97 and predicted[truth == 1].mean() >= 0.99
    sizes = model.sizes(other)
    alone = sizes[:, 1] > sizes[:, 0]  # the bare sign of the difference
    assert (alone == truth).mean() > 0.9


def test_toxicity_of_the_held_out_fold():
    texts, y, other, truth = whole_table("sf0.1", "toxic", 5, 0)
    model = fit_toxicity(texts, y)
    predicted = model.scores(other) >= 0.5
    hits, _, _ = model.read_all(other)
    any_term = (hits >= model._least).any(axis=1)
    assert predicted[truth == 1].mean() >= 0.9 and truth[predicted].mean() >= 0.9
    assert (predicted != any_term).any() and (predicted == truth).mean() > (any_term == truth).mean()


def test_toxicity_of_the_smallest_table():
    texts, y, other, truth = whole_table("sf0.001", "toxic", 5, 0)
    predicted = fit_toxicity(texts, y).scores(other) >= 0.5
    assert (predicted == truth).mean() > 0.9


def test_label_model_recovers_accuracies_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    accuracy = np.array([0.95, 0.85, 0.8, 0.9, 0.75])
    votes = np.where(rng.random((3000, 5)) < accuracy, y[:, None], ~y[:, None]).astype(int)
    votes[rng.random((3000, 5)) < 0.2] = -1
    copied = np.repeat(np.where(rng.random(3000) < 0.6, y, ~y).astype(int)[:, None], 4, axis=1)
    q, right, weight = label_model(np.column_stack([votes, copied]))
    assert ((q > 0.5) == y).mean() > 0.93
    assert np.abs(right[:5] - accuracy).max() < 0.08
    assert weight[5:].max() < 0.5 < weight[:5].min()


def test_logistic():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < sigmoid(x @ [2.0, -1.0] + 0.5)).astype(float)
    assert np.abs(fit_logistic(x, y, ridge=1e-6) - [2.0, -1.0, 0.5]).max() < 0.25
    assert np.isfinite(fit_logistic(np.zeros((4, 1)), np.ones(4))).all()


def test_patterns_vote_and_tell_texts_without_terms_apart():
    texts = ["YOU ARE HERE NOW", "you are such a one", "what!!! is this", "an i d i o t of sorts", "some f**k here", "a plain text", "i am a bee, you know"]
    model = ToxicityModel([("grumbak", 1)])
    hits, facts, _ = model.read_all(texts)
    assert [int(f[1:].sum()) for f in facts] == [1, 1, 1, 1, 1, 0, 0] and not hits.any()
    votes = model.votes(hits, facts)
    assert [list(v).count(1) for v in votes] == [1, 1, 1, 1, 1, 0, 0]
    rows = labelled(600, 2)
    y = np.array([t for *_, t in rows], float)
    marked = [f"{t} what!!! f**k" if bad else t for (_, t, *_), bad in zip(rows, y, strict=True)]
    model = fit_toxicity(marked, y)
    assert {2, 4} <= set(model.patterns)
    plain, pattern = model.scores(["a plain text of words", "a plain text!!! f**k"])
    assert pattern > plain
