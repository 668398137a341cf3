import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, documents, prose
from tidemark.llm import quality, toxicity, workload
from tidemark.llm.learning import sigmoid

LABELS = "doc_id long, quality int, toxic int"
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,modulus,left,least", [("op9_quality_fm", "quality", 4, 2, 0.95), ("op10_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, modulus, left, least):
    rows = workload.QUERIES[name](spark, LARGER).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == left) for r in rows)
    assert all(r.predicted == (r.score >= (0.7 if label == "quality" else 0.5)) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= least


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = {"w0": 0.3, "w": rng.normal(size=9), "v": rng.normal(size=(9, 3))}
    index, x, start = np.array([0, 3, 5, 1, 8]), rng.normal(size=5), np.array([0, 3, 5])
    want = []
    for a, b in ((0, 3), (3, 5)):
        s = 0.3 + sum(model["w"][index[i]] * x[i] for i in range(a, b))
        s += sum(model["v"][index[i]] @ model["v"][index[j]] * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        want.append(s)
    assert np.allclose(quality.fm_score(model, index, x, start), want)


def _toxic_sample(rng):
    texts, y = [], []
    for i in range(400):
        bad, named = i % 2, rng.random() < (0.8 if i % 2 else 0.1)
        text = prose(rng, 15) + (" muslims" if named else "") + (f" {rng.choice(('scum', 'idiots'))}" if bad and rng.random() < 0.8 else "")
        texts.append(text + " " + prose(rng, 5))
        y.append(bad)
    return texts, y


def test_swapping_groups_changes_scores_less_under_the_penalty(spark):
    texts, y = _toxic_sample(random.Random(1))
    sample = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(y, texts))], "__id long, label int, text string")
    gap, neutral = {}, {}
    for penalty in (0.0, 50.0):
        model = toxicity.learned(sample, penalty)
        probe = [f"{t} muslims came" for t in texts[::2]]
        logit = lambda ts: np.log(1 / (1 / toxicity.score_texts(model, ts) - 1))  # noqa: B023, E731
        gap[penalty] = np.abs(logit(probe) - logit([toxicity.swapped(t) for t in probe])).mean()
        neutral[penalty] = toxicity.score_texts(model, ["muslims came by"])[0]
        assert toxicity.score_texts(model, ["scum"])[0] > toxicity.score_texts(model, ["the"])[0]
    assert gap[50.0] < 0.3 * gap[0.0] and neutral[50.0] < neutral[0.0]


def test_swapping_is_a_round_of_each_kind():
    assert toxicity.swapped("Women and men, black.") == "men and women, white."
    for kind in toxicity.IDENTITY:
        text = kind[0]
        for _ in kind:
            text = toxicity.swapped(text)
        assert text == kind[0]


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_awkward_tables(spark, scores):
    df = awkward(spark, random.Random(2))
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 0), (1, 1, 0)], LABELS)
    rows = scores(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    by_key = {r.doc_id: r.score for r in rows}
    assert by_key[1] == by_key[2]  # null and empty


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_without_labels_and_without_documents(spark, scores):
    none = spark.createDataFrame([], LABELS)
    rows = scores(documents(spark, [(1, "a b"), (2, "")]), none).collect()
    assert [round(r.score, 9) for r in rows] == [0.5, 0.5]
    assert scores(documents(spark, []), none).count() == 0


def test_good_documents_are_those_not_rejected(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    want = {r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_sigmoid_is_bounded():
    assert 0 < sigmoid(np.array([-1e9]))[0] < 1e-9 and sigmoid(np.array([1e9]))[0] <= 1
