import random
from collections import Counter

import pytest

from tests.compare import difference
from tests.llm.helpers import awkward, documents, prose
from tidemark.llm import line_rules, workload

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _base(key, text):
    text = text or ""
    split = lambda t: [w.decode() for w in t.encode().split()]
    w, lines = split(text), [x for x in text.split("\n") if split(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return (key, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def _same(df, rows):
    got = sorted((tuple(r[c] for c in BASE) for r in line_rules.cleaned(df).collect()), key=str)
    assert got == sorted((_base(*r) for r in rows), key=str)


@pytest.mark.parametrize("line, rule", [
    ("A plain sentence of some words.", None), ("He said \"no\"", None), ("Stop! Wait!", None), ("A | B", "punctuation"),
    ("no mark at the end", "punctuation"), ("Home | About | Contact | Help", "navigation"), ("» Read more »", "navigation"),
    ("Next", "navigation"), ("Next to the river stands a mill.", None), ("All rights reserved.", "boilerplate"),
    ("Licensed under the Apache License, Version 2.0.", "boilerplate"), ("Licensed under " + "long terms " * 20 + "as said.", None),
    ("BUY!! NOW!! HERE!!", "punctuation"), ("a$$$ b%%% c&&& d.", "punctuation"), ("Costs are 5 % of the whole sum here.", None),
])
def test_rules_of_a_line(spark, line, rule):
    got = spark.createDataFrame([(line,)], "x string").select(line_rules.failed_rule(line_rules.stripped(line_rules.F.col("x")))).first()[0]
    assert got == rule


def test_equals_its_sql(spark, sf, con):
    assert difference(workload.QUERIES["op12_line_rules"](spark, sf), con, workload.ORACLES["op12_line_rules"]) is None


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t", "\x0b", "#", "é", "\xa0", "a b a b "]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(400, "x y z " * 40), (401, "\n".join(["same line."] * 30)), (402, "a b c d e a b c")]
    _same(documents(spark, rows), rows)


def test_lines_go_first_then_documents(spark):
    rng = random.Random(3)
    good = "\n".join(prose(rng, 30) + "." for _ in range(4))
    menu = "\n".join(" | ".join(prose(rng, 12).split()) for _ in range(3))
    notice = "All rights reserved."
    got = {r.doc_id: r for r in line_rules.cleaned(documents(spark, [(1, good + "\n" + notice), (2, good), (3, prose(rng, 40) + ".\n" + menu), (4, "short."), (5, good + "\n\n" + good)])).collect()}
    assert got[1].cleaned == good and got[1].kept and got[1].lines_boilerplate == 1
    assert got[2].cleaned == good and got[2].kept and got[2].lost_chars == 0
    assert not got[3].kept and not got[3].base_failed and got[3].lines_navigation == 3
    assert got[4].base_failed and not got[4].kept
    assert got[5].cleaned == good + "\n\n" + good and got[5].base_failed


def test_no_python_in_the_plan(spark, sf):
    plan = workload.QUERIES["op12_line_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_awkward_and_empty_tables(spark):
    df = awkward(spark, random.Random(7))
    _same(df, [(r.doc_id, r.text) for r in df.collect()])
    assert line_rules.cleaned(documents(spark, [])).count() == 0
