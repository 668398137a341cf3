import random

from tests.compare import difference
from tests.llm.helpers import awkward, documents, prose
from tidemark.llm import paragraphs, workload


def test_equals_its_sql(spark, sf, con):
    assert difference(workload.QUERIES["op4_paragraph_dedup"](spark, sf), con, workload.ORACLES["op4_paragraph_dedup"]) is None


def test_copies_and_near_copies_across_documents(spark):
    rng = random.Random(1)
    passage = prose(rng, 120)
    near = passage.split()
    near[60] = "other"
    own = [prose(rng, 60) for _ in range(6)]
    rows = [(1, f"{own[0]}\n{passage}"), (2, f"{passage}\n{own[1]}\n{own[2]}"), (3, f"É{own[3]}\n{' '.join(near)}"), (4, own[4]), (5, "short\nshort")]
    df = documents(spark, rows)
    got = sorted((r.doc_id, r.paragraph, r.class_doc, r.class_paragraph, r.occurrences, r.removed) for r in paragraphs.repeated_paragraphs(df).collect())
    assert got == [(1, 1, 1, 1, 3, False), (2, 0, 1, 1, 3, True), (3, 1, 1, 1, 3, True)]
    for r in paragraphs.repeated_paragraphs(df).collect():
        text = dict(rows)[r.doc_id]
        assert text[r.start:r.end] == text.split("\n")[r.paragraph]
    kept = {r.doc_id: r.text for r in paragraphs.without_repeats(df).collect()}
    assert kept == {1: rows[0][1], 2: f"{own[1]}\n{own[2]}", 3: f"É{own[3]}", 4: own[4], 5: "short\nshort"}


def test_awkward_table(spark):
    df = awkward(spark, random.Random(2))
    got = sorted(((r.doc_id, r.class_doc, r.occurrences, r.removed) for r in paragraphs.repeated_paragraphs(df).collect()), key=str)
    assert got == [(4, 4, 2, False), (5, 4, 2, True)]
    kept = paragraphs.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert next(r.text for r in kept.collect() if r.doc_id == 5) == ""


def test_near_copies_in_rows_without_a_key(spark):
    rng = random.Random(3)
    base, other = prose(rng, 120), prose(rng, 120)
    near, far = (" ".join([*t.split()[:-1], "changed"]) for t in (base, other))
    df = documents(spark, [(1, base), (None, near), (None, other), (None, f"x\n{far}")])
    got = sorted(((r.doc_id, r.paragraph, r.class_doc, r.occurrences) for r in paragraphs.repeated_paragraphs(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, 2), (None, 0, 1, 2), (None, 0, None, 2), (None, 1, None, 2)], key=str)


def test_empty_table(spark):
    assert paragraphs.repeated_paragraphs(documents(spark, [])).count() == 0
