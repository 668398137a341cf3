"""Small tables with everything that may be odd about one."""

from __future__ import annotations

import re

WORDS = "tion the and re ou er th ble with ha sh ing ed nd st".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


CLASHING = "part int, seq int, start int, block int, slot int, node int, score int, k int, unit int, path int, key int, text0 int"


def awkward(spark, rng):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns of clashing names."""
    long = prose(rng, 30_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\n ", None), (4, long, "a"), (5, long, "b"), (6, prose(rng, 60), None),
            (6, prose(rng, 60), "c"), (7, "x", ""), (7, "x", ""), (None, prose(rng, 50), "a"), (None, None, None), (8, "\U0001F600 é́ İ", "b")]
    df = documents(spark, rows)
    for column in CLASHING.split(", "):
        name, kind = column.split()
        df = df.selectExpr("*", f"cast(1 as {kind}) as {name}")
    return df


def words(text):
    return (text or "").lower().encode("utf-8").split()


def grams(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text or "")).lower()
