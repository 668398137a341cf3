import random
from itertools import permutations

from tests.compare import difference
from tests.llm.helpers import awkward, documents, prose
from tidemark.llm import filter_audit, workload


def _failed(rows):
    least = {}
    for key, text in ((r[0], r[1] or "") for r in rows):
        if key is not None:
            least[text] = min(key, least.get(text, key))
    out = []
    for key, text, part in ((r[0], r[1] or "", r[2] or "") for r in rows):
        w = text.encode().split()
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text) + "E" * (key is not None and least[text] < key)
        out.append((key, part, set(fails)))
    return out


def _want(rows, labels):
    failed, out = _failed(rows), []
    for part in {p for _, p, _ in failed}:
        own = [(k, f) for k, p, f in failed if p == part]
        first = {f: 0 for f in "ABCDE"}
        for order in permutations("ABCDE"):
            for _, f in own:
                for letter in order:
                    if letter in f:
                        first[letter] += 1
                        break
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [k for k, f in own if letter in f and not f & before]
                out.append((part, "".join(order), step, sum(not f & (before | {letter}) for _, f in own), len(gone),
                            sum(letter in f and bool(f & before) for _, f in own), sum(f == {letter} for _, f in own),
                            sum(labels.get(k, (0, 0))[0] for k in gone), sum(labels.get(k, (0, 0))[1] for k in gone), first[letter]))
    return sorted(out)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, mask int")


def _same(spark, df, rows, labels, **options):
    got = filter_audit.audit(df, _labels(spark, [(*x, 1) for x in labels]), **options)
    said = {}
    for k, q, t in labels:
        a, b = said.get(k, (0, 0))
        said[k] = (max(a, int(q == 1)), max(b, int(t == 1)))
    said.pop(None, None)
    assert sorted(map(tuple, got.collect())) == _want(rows, said)


def _rows(rng, n):
    texts = [prose(rng, k) for k in (210, 250, 3)] + ["a b " * 150, "ONE Two " * 120, "x#y", "", None, prose(rng, 220) + " | *"]
    return [(rng.randint(0, n) if rng.random() < 0.95 else None, rng.choice(texts + [prose(rng, rng.randint(190, 210)) for _ in range(3)]), rng.choice(["a", "b", "", None]))
            for _ in range(n)]


def test_equals_its_sql(spark, sf, con):
    assert difference(workload.QUERIES["op11_filter_audit"](spark, sf), con, workload.ORACLES["op11_filter_audit"]) is None


def test_equals_brute_force_with_ties_nulls_and_copies(spark):
    rng = random.Random(3)
    rows = _rows(rng, 300)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in [*range(0, 300, 2), 4, 8, None]]
    _same(spark, documents(spark, rows), rows, labels)


def test_a_full_sketch_gives_the_same_rows(spark):
    rng = random.Random(4)
    rows = _rows(rng, 120)
    _same(spark, documents(spark, rows), rows, [(5, 1, 1)], most_cells=filter_audit.PAGE)


def test_the_sketch_clears_unique_texts_and_no_copy(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 20), "a") for i in range(2000)] + [(3000 + i, f"copy {i % 50}", "a") for i in range(100)]
    slim = documents(spark, rows).selectExpr("doc_id", "unhex(sha2(text, 256)) AS digest")
    test = filter_audit.may_repeat(spark, filter_audit.repeat_sketch(slim, filter_audit.cells_for(2100)))
    possible = {r[0] for r in slim.filter(test("digest")).collect()}
    assert possible >= set(range(3000, 3100)) and len(possible) < 140


def test_awkward_and_empty_tables(spark):
    df = awkward(spark, random.Random(6))
    _same(spark, df, [(r.doc_id, r.text, r.source) for r in df.collect()], [(5, 1, 0)])
    assert filter_audit.audit(documents(spark, []), _labels(spark, [])).count() == 0
