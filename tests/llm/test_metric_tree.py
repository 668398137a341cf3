import math
import random

import numpy as np
import pytest

from tidemark.llm import metric_tree

VECTORS = "vec_id long, embedding array<float>, score string, cell string"


def _want(rows, k=20):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * float(np.float32(x))) for x in v]
            packed = np.array(w, "<i4").tobytes()
            whole[i] = min(whole.get(i, (packed, w)), (packed, w))
    out = []
    for q, (_, a) in whole.items():
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, (_, b) in whole.items() if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def _got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in metric_tree.largest_products(df, lambda i: i % 20 == 0, **options).collect())


def test_equals_brute_force_over_many_small_trees(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(700)]
    assert _got(spark, rows, pivots=3, tree_rows=60, queries_together=7, seeds=30) == _want(rows)


def test_copies_of_a_vector_and_ties(spark):
    rng = random.Random(2)
    one = [0.5, -0.25, 0.75]
    rows = [(i, one if i % 3 else [rng.choice((-0.5, 0.5)) for _ in range(3)]) for i in range(300)]
    assert _got(spark, rows, tree_rows=40) == _want(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (6, [-1.0, 0.5]), (6, [-1.0, 0.5]), (7, [3.0]), (8, [1.0, 2.0]), (8, [0.0, 0.0]), (20, []), (40, [9.0])]
    assert _got(spark, rows) == _want(rows)


def test_empty_and_alone(spark):
    assert _got(spark, []) == [] and _got(spark, [(0, [1.0])]) == []


def test_components_that_would_not_be_exact_are_refused(spark):
    with pytest.raises(Exception, match="2\\*\\*24"):
        _got(spark, [(0, [1e9]), (1, [1.0])])


def test_pages_hold_their_rows_within_the_radius():
    rng = np.random.default_rng(3)
    vectors = [rng.integers(-30, 30, 6).astype("<i4").tobytes() for _ in range(500)]
    x = np.frombuffer(b"".join(vectors), "<i4").reshape(500, 6).astype(float)
    longest = float((x * x).sum(axis=1).max())
    tree = metric_tree.build_tree(vectors, longest)
    lifted, routing = metric_tree._lifted(x[tree["order"]], longest), metric_tree._lifted(tree["routing"], longest)
    assert sorted(tree["order"]) == list(range(500))
    for p, (a, b) in enumerate(zip(tree["edge"][:-1], tree["edge"][1:])):
        apart = np.sqrt(((lifted[a:b] - routing[p]) ** 2).sum(axis=1))
        assert b - a <= metric_tree.PAGE_ROWS and np.allclose(apart, tree["parent"][a:b], atol=1e-5) and apart.max() <= tree["radius"][p] + 1e-5
