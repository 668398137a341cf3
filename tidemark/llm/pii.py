"""Personal data in texts: exact rules, and boosted trees over wider candidates. Column expressions only.

The rules find e-mail addresses, IP addresses, payment cards and phone numbers. Generators of high recall propose more
spans, which may overlap; features of their form and surroundings are small whole numbers, so that all candidates of a
table are a bounded number of distinct feature rows with counts. Trees are boosted on those counts, with the rules'
spans as the positive ones, and become one expression. A threshold for each kind, taken where candidates of such a score
were positive often enough, selects what is added.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

KINDS = ("email", "ip", "card", "phone")
#: The rules. Loops are possessive and begin only where a longest match can, which gives the same matches in linear time.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule or generator to find anything.
NEEDS = {"email": "@", "phone": "+"}
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?+(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])(?<![0-9]\.[0-9])[0-9]{0,2}+(?:(?:\.|\[\.\])[0-9]{1,3}+){3}+(?!\.?[0-9])",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20.-][0-9])(?:[\x20.-]?+[0-9]){12,18}+(?![\x20.-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20.-]\(?[0-9]{2,4}\)?){1,2}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
}
FORMS = {
    "email": ((r"@", 1), (r"\(", 2), (r"\[", 3)),
    "ip": ((r"\[", 2), (r"\.", 1)),
    "card": ((r"\.", 3), (r"-", 2), (r"\x20", 1)),
    "phone": ((r"\.", 3), (r"\(", 1), (r"-", 2)),
}
WORDS_BEFORE = (
    (r"(?i)(?:e-?mail|mail|contact)\W*$", 1), (r"(?i)(?:phone|tel|call|fax|mobile|cell)\W*$", 2),
    (r"(?i)(?:card|visa|credit|iban|payment)\W*$", 3), (r"(?i)(?:ip|host|address|server)\W*$", 4),
    (r"(?i)(?:version|release|section|isbn|order|invoice|id|no|number)\W*$", 5),
)
FEATURES = ("kind", "digits", "form", "before", "after", "words", "sound", "length")
ROUNDS = 40
RATE = 0.3
RIDGE = 1.0
PRECISION = 0.95
LEAST_POSITIVES = 20


def _matches(text: Column, pattern: str) -> Column:
    """Start, end and text of each match, leftmost and without overlaps; places in code points."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["p"])
        end = start + F.length(pair["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("s"), end.alias("e"), pair["m"].alias("t")))).alias("out"))

    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"))
    placed = F.aggregate(pairs, first, step, lambda state: state["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of a text pass Luhn's check."""
    digits = _digits(t)
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def _small_parts(t: Column) -> Column:
    """Whether all numbers between dots are at most 255."""
    def small(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+", "")
        return (number == "") | (F.length(number) <= 3) & (F.lpad(number, 3, "0") <= "255")

    return F.forall(F.split(t, r"\[?\.\]?"), small)


def _accepted(kind: str, t: Column) -> Column:
    if kind == "ip":
        return _small_parts(t)
    if kind == "card":
        return luhn(t)
    if kind == "phone":
        return F.length(_digits(t)).between(10, 15)
    return F.lit(True)


def _first_code(text: Column, cases: Sequence[tuple[str, int]]) -> Column:
    out = F.lit(0)
    for pattern, code in reversed(cases):
        out = F.when(F.regexp_like(text, F.lit(pattern)), code).otherwise(out)
    return out


def _side(c: Column) -> Column:
    """What a neighbouring character is: 0 none, 1 blank, 2 letter, 3 digit, 4 other."""
    return _first_code(c, ((r"^$", 0), (r"\s", 1), (r"\p{L}", 2), (r"[0-9]", 3), (r".", 4)))


def _sound(kind: str, t: Column) -> Column:
    if kind == "email":
        return F.regexp_like(t, F.lit(r"[A-Za-z]{2,}$")).cast("int")
    if kind == "ip":
        return _small_parts(t).cast("int")
    if kind == "card":
        return luhn(t).cast("int")
    return F.lit(0)  # the sign before a number is what the rule goes by, so a candidate without it is told by the rest


def _range(n: Column, edges: Sequence[int]) -> Column:
    """How many of the edges a number reaches."""
    out = F.lit(0)
    for edge in edges:
        out = out + (n >= edge).cast("int")
    return out


def with_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``base`` and ``candidates``: spans as (s, e, k), candidates with their features and whether they are base."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.select(F.col(key).alias("id"), own.alias("x"))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    for kinds, name in ((RULES, "r"), (GENERATORS, "g")):
        columns = {}
        for kind in KINDS:
            found = _matches(F.col("x"), kinds[kind])
            if name == "r" and kind in NEEDS:
                found = F.when(F.contains(F.col("x"), F.lit(NEEDS[kind])), found).otherwise(none)
            if name == "g" and kind == "email":
                found = F.when(F.regexp_like(F.col("x"), F.lit(r"@|\(at\)|\[at\]")), found).otherwise(none)
            columns[f"{name}_{kind}"] = found
        df = df.withColumns(columns)

    def accepted(kind: str, k: int) -> Column:
        good = F.filter(f"r_{kind}", lambda m: _accepted(kind, m["t"]))
        return F.transform(good, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e")))

    spans = [accepted(kind, k) for k, kind in enumerate(KINDS)]
    df = df.withColumn("base", F.array_sort(F.concat(*spans)))

    def features(kind: str, k: int):
        def of(m: Column) -> Column:
            t, base = m["t"], F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"))
            start = F.greatest(m["s"] - 20, F.lit(0))
            before = F.substring(F.col("x"), start + 1, m["s"] - start)
            return F.struct(
                m["s"].alias("s"), m["e"].alias("e"), F.lit(k).alias("kind"),
                _range(F.length(_digits(t)), (1, 4, 7, 10, 13, 16, 20)).alias("digits"), _first_code(t, FORMS[kind]).alias("form"),
                _side(F.substring(before, -1, 1)).alias("before"), _side(F.substring(F.col("x"), m["e"] + 1, F.lit(1))).alias("after"),
                _first_code(before, WORDS_BEFORE).alias("words"), _sound(kind, t).alias("sound"),
                _range(F.length(t), (8, 12, 20, 32)).alias("length"), F.array_contains("base", base).alias("positive"),
            )
        return of

    found = F.concat(*(F.transform(f"g_{kind}", features(kind, k)) for k, kind in enumerate(KINDS)))
    return df.select("id", "base", found.alias("candidates"))


def boost(rows: list[tuple], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Trees of two levels on rows of (features..., positives, all). Each is (feature, value, leaf or split, leaf or split).

    A split sends the rows whose feature is the value to its first branch. Leaves are Newton steps of the log loss.
    """
    if not rows:
        return []
    n = len(FEATURES)
    values = sorted({(f, r[f]) for r in rows for f in range(n)})
    where = {v: [i for i, r in enumerate(rows) if r[v[0]] == v[1]] for v in values}
    score = [0.0] * len(rows)
    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [r[n] - r[n + 1] * q for r, q in zip(rows, p)]
        h = [r[n + 1] * q * (1 - q) for r, q in zip(rows, p)]

        def split(inside: set[int], depth: int):
            total_g, total_h = sum(g[i] for i in inside), sum(h[i] for i in inside)
            best = None
            for v in values:
                own = [i for i in where[v] if i in inside]
                a, b = sum(g[i] for i in own), sum(h[i] for i in own)
                if not own or len(own) == len(inside):
                    continue
                gain = a * a / (b + RIDGE) + (total_g - a) ** 2 / (total_h - b + RIDGE) - total_g ** 2 / (total_h + RIDGE)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, v, set(own))
            if depth == 0 or best is None or best[0] <= 1e-9:
                leaf = rate * total_g / (total_h + RIDGE)
                for i in inside:
                    score[i] += leaf
                return leaf
            return (best[1][0], best[1][1], split(best[2], depth - 1), split(inside - best[2], depth - 1))

        trees.append(split(set(range(len(rows))), 2))
    return trees


def tree_score(tree, features) -> float:
    """A tree's leaf for a row of features."""
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] == tree[1] else tree[3]
    return tree


def _expression(tree, candidate: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, value, yes, no = tree
    return F.when(candidate[FEATURES[feature]] == value, _expression(yes, candidate)).otherwise(_expression(no, candidate))


def thresholds(rows: list[tuple], trees: list, precision: float = PRECISION) -> list[float]:
    """For each kind the least score from which on the candidates seen are positive with the given share; infinite if there are few."""
    n, out = len(FEATURES), []
    for kind in range(len(KINDS)):
        own = sorted(((sum(tree_score(t, r) for t in trees), r[n], r[n + 1]) for r in rows if r[0] == kind), reverse=True)
        found, good, seen, at = math.inf, 0, 0, 0
        while at < len(own):
            s = own[at][0]
            while at < len(own) and own[at][0] == s:
                good, seen, at = good + own[at][1], seen + own[at][2], at + 1
            if good >= LEAST_POSITIVES and good >= precision * seen:
                found = s
        out.append(found)
    return out


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """A row per document: key, ``base`` (the rules' spans) and ``spans`` (those and the added ones), as arrays of
    (s, k, e): start, number of the kind in KINDS, end; in code points of the whole text, ordered by start, then kind.

    Counts of feature rows cover all candidates of the table and reach the driver as one row for each distinct
    combination of eight small numbers. A candidate is added if its score is at least its kind's threshold, it overlaps
    no base span, and no candidate of a higher score (or as high, and earlier) that it overlaps is selected too.
    Null and empty texts have no spans. Null keys and repeated rows are rows like others. Texts without candidates, or
    few positive ones of a kind, add nothing of it. An empty table gives no rows. Other columns are not looked at.
    """
    found = materialise(with_candidates(docs, key, text), "candidates")
    cells = found.select(F.inline("candidates")).groupBy(*FEATURES).agg(F.sum(F.col("positive").cast("int")).alias("good"), F.count("*").alias("n"))
    rows = sorted(tuple(r) for r in cells.collect())
    trees = boost(rows)
    least = thresholds(rows, trees, precision)

    def scored(c: Column) -> Column:
        total = F.lit(0.0)
        for tree in trees:
            total = total + _expression(tree, c)
        return total

    limits = F.array(*(F.lit(float(x)) for x in least))
    overlap = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    rated = F.transform("candidates", lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("k"), c["e"].alias("e"), scored(c).alias("score")))
    free = F.filter(rated, lambda c: (c["score"] >= F.element_at(limits, c["k"] + 1) - 1e-9) & ~F.exists("base", lambda b: overlap(b, c)))
    found = found.withColumn("free", F.when(F.size("candidates") > 0, free).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,score:double>>")))
    ahead = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (F.struct(a["s"], a["k"], a["e"]) < F.struct(b["s"], b["k"], b["e"])))
    chosen = F.filter("free", lambda c: ~F.exists("free", lambda d: overlap(c, d) & ahead(d, c)))
    added = F.transform(chosen, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    return found.select(F.col("id").alias(key), "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the number of base spans of each kind, the SHA-256 of the base spans written out, and all spans written out."""
    found = personal_data(docs, key=key, text=text)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda b: b["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(count, range(len(KINDS)))
    return found.select(
        key, *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def redacted(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mark: str = "[{}]") -> DataFrame:
    """key and the text with every span replaced by its kind; of overlapping spans the first is named and both are cut."""
    found = personal_data(docs, key=key, text=text).select(F.col(key).alias("id"), "spans").distinct()
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*(F.lit(mark.format(k)) for k in KINDS))

    def step(state: Column, span: Column) -> Column:
        new = span["s"] >= state["at"]
        gap = F.substring(F.col("x"), state["at"] + 1, F.greatest(span["s"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], span["e"]).alias("at"),
                        F.concat(state["out"], F.when(new, F.concat(gap, F.element_at(names, span["k"] + 1))).otherwise(F.lit(""))).alias("out"))

    joined = own.join(found, own["id"].eqNullSafe(found["id"])).drop(found["id"])
    out = F.aggregate("spans", first, step, lambda s: F.concat(s["out"], F.substring(F.col("x"), s["at"] + 1, F.length("x"))))
    return joined.select(F.col("id").alias(key), out.alias(text))
