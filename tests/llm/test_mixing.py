import random

import numpy as np
import pytest

from tests.llm.helpers import awkward, documents
from tidemark.llm import mixing


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 1, "b": 1}, {"a": 500, "b": 3, "c": 97, None: 400}, {f"s{i}": i + 1 for i in range(30)}])
def test_blocks_run_in_their_windows_and_sources_stay_within_one_block(shares):
    slots, period = mixing.pfair_slots(shares), sum(shares.values())
    assert sorted(s for own in slots.values() for s in own) == list(range(period))
    for source, own in slots.items():
        n = shares[source]
        assert len(own) == n
        assert all(j * period // n <= s and s + 1 <= -(-(j + 1) * period // n) for j, s in enumerate(own))
        done = np.cumsum(np.isin(np.arange(period), own))
        assert (abs(done - np.arange(1, period + 1) * n / period) < 1).all()


def test_schedule_equals_a_simulation(spark):
    rng = random.Random(1)
    rows = [(i, "t", rng.choice(("a", "a", "a", "b", None))) for i in range(900)]
    shares = {"a": 5, "b": 2, None: 1}
    got = mixing.schedule(documents(spark, rows), shares, block_docs=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    blocks = {s: -(-sum(r[2] == s for r in rows) // 4) for s in shares}
    slots, want = mixing.pfair_slots(shares), set()
    for source, n in blocks.items():
        want |= {(source, j, j // shares[source] * 8 + slots[source][j % shares[source]]) for j in range(n)}
    assert {(r.source, r.block, r.slot) for r in got} == want
    assert all(r.release <= r.slot < r.deadline for r in got)
    for source in shares:
        own = sorted((r.block, r.place) for r in got if r.source == source)
        assert own == [(i // 4, i % 4) for i in range(len(own))]


def test_order_within_a_source_spans_buckets(spark):
    df = documents(spark, [(i, "t", "a") for i in range(1000)])
    ranks = [r["__rank"] for r in mixing.ranked(df, "source", "doc_id", bucket_rows=10).collect()]
    assert sorted(ranks) == list(range(1000))


def test_stored_order_is_the_mixed_order(spark):
    df = documents(spark, [(i, f"t{i}", f"s{i % 3}") for i in range(500)])
    plan = {r.doc_id: (r.slot, r.place) for r in mixing.schedule(df).collect()}
    out = mixing.in_mixed_order(df)
    assert out.columns == df.columns and [plan[r.doc_id] for r in out.collect()] == sorted(plan.values())


def test_tempered_shares():
    shares = mixing.tempered_shares({"a": 100, "b": 400, None: 0})
    assert sum(shares.values()) == 1000 and shares[None] >= 1 and 1.9 < shares["b"] / shares["a"] < 2.1


def test_awkward_table(spark):
    df = awkward(spark, random.Random(3))
    out = mixing.in_mixed_order(df)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert mixing.schedule(df).count() == df.count()


def test_empty_table_and_bad_shares(spark):
    assert mixing.schedule(documents(spark, [])).count() == 0
    assert mixing.in_mixed_order(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="shares"):
        mixing.schedule(documents(spark, [(1, "t", "a")]), {"b": 1})
