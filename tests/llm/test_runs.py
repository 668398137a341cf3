import hashlib
import random
import zlib

import numpy as np

from tests.llm.helpers import awkward, documents, prose
from tidemark.llm import runs, workload


def _runs(w):
    """All runs by looking along every period."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = p
        while i < len(w):
            if w[i] != w[i - p]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i - p, j - i + p), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def _collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def _want(key, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = _runs(w)
    s, n, p = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (key, len(found), s, n, p, 1000 * n // p if p else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(_collapsed(w, found)).hexdigest())


def _random_words(rng, most):
    letters, out = rng.choice([2, 2, 3, 4]), []
    while len(out) < most:
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 11))]
        out += (unit * rng.randint(1, 8))[:rng.randint(1, 70)] if rng.random() < 0.5 else unit[:1]
    return out[:most]


def test_runs_equal_brute_force():
    rng = random.Random(1)
    total = 0
    for _ in range(1500):
        w = _random_words(rng, rng.randint(0, 120))
        want = _runs(w)
        assert runs.runs_of(np.array(w, np.int64)) == want, w
        total += len(want)
    assert total > 1000


def test_equal_hashes_of_other_words_are_no_run(monkeypatch):
    rng = random.Random(2)
    caught = runs._caught
    monkeypatch.setattr(runs, "_caught", lambda h, b: caught(h % np.uint64(5), b))
    for _ in range(200):
        w = _random_words(rng, rng.randint(0, 80))
        assert runs.runs_of(np.array(w, np.int64)) == _runs(w)


def test_long_texts_of_few_words():
    for w in (np.zeros(200_000, np.int64), (np.arange(100_000) // 50) % 2, np.arange(60_000) % 7000):
        found = runs.runs_of(w)
        assert found[0] == ((0, 200_000, 1) if w.max() == 0 else found[0])
        for s, n, p in found[:50]:
            own = w[s:s + n]
            assert (own[p:] == own[:-p]).all() and n >= max(6, 4 * p)
    assert runs.runs_of(np.arange(60_000) % 7000) == [(0, 60_000, 7000)]


def test_digest_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in _random_words(rng, rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, prose(rng, rng.randint(1, 300)).replace(" ", rng.choice([" ", "  ", "\n", "\t\x0b"]))) for i in range(100)]
    got = sorted((tuple(r) for r in runs.digest(documents(spark, rows)).collect()), key=str)
    assert got == sorted((_want(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 100


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in workload.QUERIES["op13_periodic_runs"](spark, sf).collect())
    assert len(got) == len(rows)
    short = {r[0] for r in rows if len((r[1] or "").split()) < 3000}
    assert [r for r in got if r[0] in short] == sorted(_want(*r) for r in rows if r[0] in short)


def test_real_outputs(spark):
    got = runs.periodic_runs(documents(spark, [(1, "a  b\nc " * 4 + "d"), (2, "x y"), (3, None)])).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in sorted(got)] == [(1, [(0, 12, 3)], "a b c d"), (2, [], "x y"), (3, [], "")]


def test_awkward_and_empty_tables(spark):
    df = awkward(spark, random.Random(8))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((tuple(r) for r in runs.digest(df).collect()), key=str)
    long = {k for k, t in rows if t and len(t) > 10_000}
    assert [r for r in got if r[0] not in long] == sorted((_want(*r) for r in rows if r[0] not in long), key=str) and len(got) == len(rows)
    assert runs.digest(documents(spark, [])).count() == 0
