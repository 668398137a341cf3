import hashlib
import random
import re

import pytest

from tests.llm.helpers import awkward, documents
from tidemark.llm import pii, workload

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0


def _base(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in rule.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


PARTS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4.5.6.7.8", "300.1.1.1", "a@b.c_d@e.f", "+1 (555) 555-0100", "x@y", "001.02.003.0255",
         "+44 20 7946 0958", "é", "5500000000000004", "12 34", "a.b@c.d.e", "+1+2", "\U0001F600", "1 2  3", "0000000000.1.1.1"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = "0123456789 -.+@()aZ_%é\U0001F600"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(800)]
    out += [rng.choice(" .").join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    return [*out, None, "", "1" * 5000, "a" * 5000 + "@b" + ".c" * 5000, "1." * 2000, "+1" * 3000, "a" * 200_000]


def test_rules_equal_their_definition(spark, texts):
    rows = pii.personal_data(documents(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(x) for x in r.base] == _base(texts[r.doc_id]), texts[r.doc_id]
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans} and sorted(map(tuple, r.spans)) == [tuple(x) for x in r.spans]


def test_query_digests(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in workload.QUERIES["op6_personal_data"](spark, sf).collect():
        base = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(_written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert set(filter(None, _written(base).split(","))) <= set(r.spans.split(","))


def test_no_python_in_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (pii.with_candidates(docs, "doc_id", "text"), pii.digest(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_trees_add_spans_that_look_like_the_rules(spark):
    rng = random.Random(9)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"call {'+1 ' + number()} now") for i in range(400)] + [(1000 + i, f"see section {rng.randint(10, 99)}.{rng.randint(10, 99)}.{rng.randint(100, 999)} there") for i in range(200)]
    rows += [(5000, "call (212) 555-0147 now")]
    out = {r.doc_id: r for r in pii.personal_data(documents(spark, rows), precision=0.9).collect()}
    assert [tuple(x) for x in out[5000].spans] == [(5, 3, 19)] and not out[5000].base
    assert all(not out[1000 + i].spans for i in range(200))


def test_boosting_and_thresholds():
    rows = [(0, 1, 0, 0, 0, 0, 0, 0, 90, 100), (0, 2, 0, 0, 0, 0, 0, 0, 1, 100), (1, 1, 0, 0, 0, 0, 0, 0, 0, 50)]
    trees = pii.boost(rows)
    score = [sum(pii.tree_score(t, r) for t in trees) for r in rows]
    assert score[0] > 1 > -2 > score[1] and score[2] < -2
    least = pii.thresholds(rows, trees, 0.9)
    assert least[0] == score[0] and least[1:] == [float("inf")] * 3 and pii.boost([]) == []


def test_redaction(spark):
    rows = [(1, "mail é a@b.co or +1 (555) 555-0100."), (2, None), (2, None), (3, "4111 1111 1111 1111, 1.2.3.4")]
    out = sorted((r.doc_id, r.text) for r in pii.redacted(documents(spark, rows)).collect())
    assert out == [(1, "mail é [email] or [phone]."), (2, ""), (2, ""), (3, "[card], [ip]")]


def test_awkward_and_empty_tables(spark):
    df = awkward(spark, random.Random(4))
    out = pii.digest(df).collect()
    assert len(out) == df.count() and next(r for r in out if r.doc_id == 1).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.digest(documents(spark, [])).count() == 0
