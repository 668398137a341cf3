import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm.helpers import components, documents, grams, jaccard, normal, words
from tidemark.llm import mixing, quality
from tidemark.storage import materialise


def test_stages(spark, sf):
    assert [n for n, _ in p.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = materialise(out, "stage")
    assert p.STAGES[-1][1](spark, docs, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_run_equals_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = [r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()]
    sets = {i: grams(rows[i].text) for i in kept if words(rows[i].text)}
    class_of = components(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    kept = [i for i in kept if i not in class_of or class_of[i] == i]
    items = [normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # here passages are whole items without edits
    clean = [i for i in kept if not any(t in normal(rows[i].text) for t in items)]
    left = docs.filter(docs.doc_id.isin(clean))
    order = [r.doc_id for r in mixing.schedule(left).orderBy("slot", "place").collect()]
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in order:
        ids = [*tokenizer.encode(rows[i].text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in p.run(spark, sf).collect()) == sorted(want) and len(want) < len(rows)


@pytest.mark.parametrize("stored", [True, False])
def test_order_is_that_of_the_table(spark, stored):
    df = documents(spark, [(i, f"t{i}") for i in range(100)]).repartition(7, "doc_id")
    want = [r.doc_id for r in df.collect()]
    df = materialise(df, "ordered") if stored else df
    assert [r.doc_id for r in p.stored_order(df).orderBy("__at").collect()] == want


def test_stages_on_empty_tables(spark, sf):
    docs = documents(spark, [])
    for _, stage in p.STAGES[1:]:
        assert stage(spark, docs, sf).count() == 0
