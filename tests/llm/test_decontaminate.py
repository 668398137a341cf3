import random

import pytest

from tests.llm.helpers import awkward, documents, normal, prose
from tidemark.llm import decontaminate as d

ITEMS = "item_id long, text string, start long"


def _edits_within(window, text):
    """Edits of the whole window against the part of the text that it fits best."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    items = [prose(rng, rng.randint(1, 40)) for _ in range(10)] + ["", "short", None]
    docs = []
    for _ in range(50):
        item = normal(rng.choice(items[:10]))
        a = rng.randint(0, max(0, len(item) - 60))
        cut = list(item[a:a + rng.randint(40, 140)])
        for _ in range(rng.randint(0, 8)):
            p = rng.randrange(len(cut))
            cut[p:p + 1] = rng.choice((["z"], ["q", cut[p]], []))
            cut = cut or ["x"]
        text = prose(rng, rng.randint(5, 50))
        p = rng.randint(0, len(text))
        docs.append(text[:p] + "".join(cut).upper().replace(" ", ",\n") + text[p:])
    return items, docs


@pytest.fixture(scope="module")
def want(cases):
    items, docs = cases
    index = d.Index(list(range(len(items))), [t or "" for t in items])
    out = set()
    for k, doc in enumerate(docs):
        text = normal(doc)
        for i, item in enumerate(index.ids):
            codes = "".join(map(chr, index.codes[i]))
            n = int(index.window[i])
            if any(_edits_within(codes[a:a + n], text) <= index.edits[i] for a in index.starts(i)):
                out.add((k, item))
    return out


@pytest.mark.parametrize("slice_chars", [d.SLICE_CHARS, 300])
def test_finds_what_brute_force_finds(spark, cases, want, slice_chars):
    items, docs = cases
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], ITEMS)
    table = documents(spark, list(enumerate(docs)))
    rows = d.leaks(table, benchmark, slice_chars=slice_chars).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 5
    kept = {r.doc_id for r in d.without_leaks(table, benchmark, slice_chars=slice_chars).collect()}
    assert kept == set(range(len(docs))) - {k for k, _ in want}


def test_spans_are_of_the_whole_text(spark):
    rng = random.Random(6)
    item, before = prose(rng, 40), "İé " + prose(rng, 30) + ". "
    text = before + item.upper() + " " + prose(rng, 20)
    benchmark = spark.createDataFrame([(1, item, 0)], ITEMS)
    row = d.leaks(documents(spark, [(9, text), (10, before)]), benchmark).collect()
    assert len(row) == 1 and row[0].edits == 0
    assert normal(text[row[0].start:row[0].end]) == normal(item)


def test_long_texts_are_searched_in_pieces(monkeypatch):
    monkeypatch.setattr(d, "TEXT_AT_ONCE", 500)
    rng = random.Random(7)
    item = prose(rng, 30)
    text = prose(rng, 400) + " " + item + " " + prose(rng, 400)
    assert [f[:2] for f in d.search(d.Index([0], [item]), ["", text, item])] == [(1, 0), (2, 0)]


@pytest.mark.parametrize("cut", range(5))
def test_a_hit_belongs_to_its_own_text_whatever_the_neighbours(spark, cut):
    rng = random.Random(9)
    item, clean = normal(prose(rng, 16))[:80], prose(rng, 30)
    assert len(item) == 80 and item[0] != " " != item[-1]
    index = d.Index([0], [item])
    for text in (item[cut:].strip(), item[:80 - cut].strip()):
        alone = [(1, *f[1:]) for f in d.search(index, [text])]
        assert alone == [(1, 0, 0, len(text), 80 - len(text))] or len(text) < 76 and not alone
        assert d.search(index, [clean, text, clean]) == alone
    benchmark = spark.createDataFrame([(1, item, 0)], ITEMS)
    table = documents(spark, [(1, clean), (2, item[cut:].strip()), (3, clean)]).coalesce(1)
    assert {r.doc_id for r in d.without_leaks(table, benchmark).collect()} == ({1, 3} if alone else {1, 2, 3})


def test_awkward_tables(spark):
    rng = random.Random(8)
    df = awkward(spark, rng)
    long = next(r.text for r in df.collect() if r.doc_id == 4)
    benchmark = spark.createDataFrame([(1, long[50_000:50_200], 0), (2, None, 0), (None, long[:150], 0), (3, "", 0), (1, long[50_000:50_200], 0)], ITEMS)
    got = sorted((r.doc_id, r.item_id or -1) for r in d.leaks(df, benchmark).collect())
    assert got == [(4, -1), (4, 1), (4, 1), (5, -1), (5, 1), (5, 1)]
    kept = d.without_leaks(df, benchmark)
    assert kept.columns == df.columns and kept.count() == df.count() - 2


def test_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, [(1, "a")])
    empty = spark.createDataFrame([], ITEMS)
    assert d.leaks(none, spark.createDataFrame([(1, "x" * 99, 0)], ITEMS)).count() == 0
    assert d.leaks(some, empty).count() == 0 and d.without_leaks(some, empty).count() == 1


def test_slices_are_bounded_however_often_items_repeat(spark):
    rng = random.Random(31)
    texts = [prose(rng, 40) for _ in range(12)]
    rows = [(i % 12, texts[i % 12]) for i in range(3000)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    items, n = d._slices(bench, "item_id", "text", 600)
    sizes = [sum(len(t) for _, t, _ in d._slice(items, k, n)) for k in range(n)]
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) <= 1200
    docs = documents(spark, [(1, "start " + texts[3] + " end"), (2, prose(rng, 50))])
    whole, sliced = (d.leaks(docs, bench, slice_chars=k).collect() for k in (10**6, 600))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, sliced)) and len(whole) == 250 and {r.doc_id for r in whole} == {1}
