import random

from tests.llm.helpers import components
from tidemark.llm import graph


def _got(spark, edges):
    return {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}


def _want(edges):
    edges = [e for e in edges if None not in e and e[0] != e[1]]
    return components({x for e in edges for x in e}, edges)


def test_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1, None), (None, 2), (7, 7)]
    assert _got(spark, edges) == _want(edges)


def test_a_long_path_and_a_star(spark):
    names = list(range(200))
    random.Random(2).shuffle(names)
    edges = list(zip(names, names[1:])) + [(1000, 1000 + i) for i in range(1, 300)] + [(1000, 1001)]
    assert _got(spark, edges) == _want(edges)


def test_no_edges(spark):
    assert _got(spark, []) == {}
