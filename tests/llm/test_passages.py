import random

import numpy as np

from tests.llm.helpers import awkward, documents, prose
from tidemark.llm import paragraphs, passages


def _units(text):
    """(start, end, words) of each unit, word by word."""
    text, spans, at = text or "", [], 0
    while at < len(text):
        if text[at] in " \t\n\x0b\x0c\r":
            at += 1
            continue
        end = at
        while end < len(text) and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        spans.append((at, end))
        at = end
    out, own, said = [], [], []
    for i, (a, b) in enumerate(spans):
        own.append((a, b))
        size = [spans[i - k][1] - spans[i - k][0] if i >= k else None for k in range(3)]
        said.append(None not in size and (size[0] + 3 * size[1] + 2 * size[2]) % 5 == 0)
        if said[-1] and not any(said[-5:-1]):
            out += [own[k:k + 64] for k in range(0, len(own), 64)]
            own = []
    out += [own[k:k + 64] for k in range(0, len(own), 64)]
    own = []
    out += [own] if own else []
    return [(u[0][0], u[-1][1], tuple(text[a:b].lower() for a, b in u)) for u in out]


def _want(rows, least=20):
    places = {}
    for key, text in rows:
        for a, b, words in _units(text):
            places.setdefault(words, []).append((key is None, -1 if key is None else key, a))
    many = {w: p for w, p in places.items() if len({x[:2] for x in p}) > 1 or any(x[0] for x in p) and len(p) > 1}
    out = []
    for key, text in rows:
        spans = {False: [], True: []}
        for i, (a, b, words) in enumerate(_units(text)):
            if words in many:
                first = min(many[words])
                own = spans[(key is None, -1 if key is None else key, a) != first]
                if not (own and own[-1][-1][0] == i - 1):
                    own.append([])
                own[-1].append((i, a, b, len(words), None if first[0] else first[1], first[2], len(many[words])))
        for removed, stretches in spans.items():
            for s in stretches:
                if sum(u[3] for u in s) >= least:
                    best = max(s, key=lambda u: u[3])
                    out.append((key, s[0][1], s[-1][2], sum(u[3] for u in s), *best[4:], removed))
    return sorted(out, key=str)


def _same(df, rows):
    got = sorted((tuple(r) for r in passages.repeated_passages(df).collect()), key=str)
    assert got == _want(rows)
    return got


def _host(rng, passage, at, n):
    words = prose(rng, n).split()
    return " ".join([*words[:at], passage, *words[at:]])


def test_units_equal_those_cut_word_by_word():
    rng = random.Random(1)
    for _ in range(200):
        texts = [" ".join("x" * rng.randint(1, rng.choice([1, 9])) for _ in range(rng.randint(0, 200))) for _ in range(4)]
        lengths = np.array([len(w) for t in texts for w in t.split()], np.int64)
        first = np.array([i == 0 for t in texts for i, _ in enumerate(t.split())], bool)
        want, at = [], 0
        for t in texts:
            for _, _, words in _units(t):
                want.append(at)
                at += len(words)
        assert passages.unit_starts(lengths, first).tolist() == want


def test_passages_within_and_across_lines(spark):
    rng = random.Random(2)
    found = 0
    for n in (51, 60, 80, 120):
        rows, words = [], []
        for i in range(20):
            words.append(prose(rng, n).split())
            rows.append((4 * i, _host(rng, " ".join(words[-1]), rng.randint(0, 500), 500)))
            wrapped = "\n".join(" ".join(words[-1][k:k + 15]) for k in range(0, n, 15))
            rows.append((4 * i + 1, _host(rng, wrapped, rng.randint(0, 500), 500).upper()))
            rows.append((4 * i + 2, prose(rng, 500)))
        got = _same(documents(spark, rows), rows)
        hit = {r[0] for r in got}
        assert not any(k % 4 == 2 for k in hit)
        found += len(hit)
        text = dict(rows)
        for key, start, end, n_words, class_doc, _, occurrences, removed in got:
            assert removed == (key % 4 == 1) and class_doc == key - key % 4 and occurrences == 2
            own = text[key][start:end].lower().split()
            assert len(own) == n_words and sum(w in words[key // 4] for w in own) >= n_words - 8
    assert found >= 0.9 * 160


def test_nulls_repeated_rows_and_keys_with_several_texts(spark):
    rng = random.Random(3)
    p, q = prose(rng, 90), prose(rng, 70)
    rows = [(1, p), (1, p), (2, f"a b\n{p} c"), (None, q), (None, q), (3, None), (4, ""), (5, " \t\n"), (6, p.replace(" ", "\x0b")), (6, q), (7, f"é {q} \U0001F600")]
    _same(documents(spark, rows), rows)


def test_passages_are_cut_out(spark):
    rng = random.Random(4)
    p = prose(rng, 100)
    rows = [(1, _host(rng, p, 20, 40)), (2, _host(rng, p, 30, 60))]
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(documents(spark, rows)).collect()}
    assert left[1] == rows[0][1] and len(left[2].split()) < 160 - 60 and set(left[2].split()) <= set(rows[1][1].split()) | {""}


def test_awkward_and_empty_tables(spark):
    df = awkward(spark, random.Random(5))
    _same(df, [(r.doc_id, r.text) for r in df.collect()])
    assert passages.repeated_passages(documents(spark, [])).count() == 0
