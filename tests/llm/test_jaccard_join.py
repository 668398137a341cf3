import random

from tests.compare import difference
from tests.llm.helpers import awkward, components, documents, grams, jaccard, prose, words
from tidemark.llm import jaccard_join, minhash, workload


def _want(rows):
    texts = {}
    for key, text in rows:
        if words(text):
            texts.setdefault(b" ".join(words(text)), []).append(key)
    sets = {w: grams(w.decode()) for w in texts}
    names = list(texts)
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1:] if jaccard(sets[a], sets[b]) >= 0.8]
    class_of = components(names, links)
    least = {}
    for w in names:
        own = [k for k in texts[w] if k is not None]
        least[class_of[w]] = min([*own, least.get(class_of[w], 10**9)])
    out = []
    for key, text in rows:
        w = b" ".join(words(text))
        if w in texts:
            out.append((key, least[class_of[w]] if least[class_of[w]] < 10**9 else None, sum(w in x for x in links), len(texts[w])))
        else:
            out.append((key, key, 0, 1))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in jaccard_join.similar_documents(df).collect()), key=str)


def _family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        out.append(" ".join(w))
    return out


def test_equals_its_sql(spark, sf, con):
    assert difference(workload.QUERIES["op7_jaccard_join"](spark, sf), con, workload.ORACLES["op7_jaccard_join"]) is None


def test_large_family_over_many_units(spark):
    rng = random.Random(4)
    texts = _family(rng, prose(rng, 150), 300, 6) + [prose(rng, 40) for _ in range(50)] + ["One two", "one  TWO", "a"]
    rows = list(enumerate(texts))
    assert _got(documents(spark, rows)) == _want(rows)


def test_every_pair_of_a_cluster_meets_in_one_unit(spark):
    nodes = spark.createDataFrame([(bytes([i]), b"c" if i < 100 else b"d") for i in range(110)], "node binary, cluster binary")
    units = minhash.with_units(nodes, chunk=16).collect()
    met = {}
    for r in units:
        for u in r.units:
            met.setdefault((u.of, u.i, u.j), []).append((bytes(r.node), bytes(r.cluster), r.side))
    pairs = {}
    for (of, i, j), own in met.items():
        assert len(own) < 80
        for a in own:
            for b in own:
                if a[0] < b[0] and a[1] == b[1] and (of is None or i == j or a[2] != b[2]):
                    pairs[a[0], b[0]] = pairs.get((a[0], b[0]), 0) + 1
    assert set(pairs.values()) == {1} and len(pairs) == 100 * 99 // 2 + 10 * 9 // 2


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        n = minhash.bands_for(0.8, recall)
        assert 1 - (1 - 0.8**4) ** n >= recall > 1 - (1 - 0.8**4) ** (n - 1)


def test_jaccard_of_sets_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype("<u8") for _ in range(40)]
    got = minhash.similar_pairs(sets, 0.5)
    assert all(got[i, j] == (jaccard(set(a.tolist()), set(b.tolist())) >= 0.5) for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_awkward_table(spark):
    df = awkward(spark, random.Random(5))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert _got(df) == _want(rows)
    kept = jaccard_join.without_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, None}


def test_null_repeated_and_shared_keys(spark):
    rng = random.Random(6)
    base, other, clean, lone = (prose(rng, 150) for _ in range(4))
    near, far = _family(rng, base, 2, 3), [other, " ".join([*other.split()[:-1], "changed"])]
    rows = [(1, base), (None, near[0]), (2, near[1]), (2, clean), (None, far[0]), (None, far[0]), (None, far[1]),
            (3, lone), (3, lone), (3, lone), (4, ""), (4, ""), (None, None)]
    df = documents(spark, rows)
    assert _got(df) == _want(rows)
    kept = [(r.doc_id, r.text) for r in jaccard_join.without_near_copies(df).collect()]
    assert [t for _, t in kept if t in (far[0], far[1])] in ([far[0]], [far[1]])
    assert sorted(r for r in kept if r[1] not in far and r[0]) == sorted([(1, base), (2, clean), (3, lone), (4, ""), (4, "")])
    assert len(kept) == 7 and (None, None) in kept


def test_empty_table(spark):
    assert jaccard_join.similar_documents(documents(spark, [])).count() == 0
