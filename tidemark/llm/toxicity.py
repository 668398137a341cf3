"""Toxicity of texts: a linear classifier whose scores must not change when a text names another group."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import learning
from .learning import sigmoid

BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
FEATURES = 4096
LEAST_TEXTS = 4
LEAST_GAIN = 3.0
SAMPLE = 12_000
MEMO_WORDS = 300_000
PENALTY = 4.0
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
#: Groups of people, by kind; a term is swapped with the next one of its kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives", "citizens"), ("immigrant", "refugee", "native", "citizen"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"), ("transgender", "cisgender"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAPS = {a: b for kind in IDENTITY for a, b in zip(kind, (*kind[1:], kind[0]))}


def swapped(text: str) -> str:
    """The text with each identity term replaced by the next of its kind; other words stay as they are."""
    return WORD.sub(lambda m: SWAPS.get(m[0].lower(), m[0]), text)


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of the word and of its first letters."""
    parts = [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return tuple(xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


def text_features(text: str) -> np.ndarray:
    """The distinct buckets of all words."""
    return np.array(sorted({b for w in set(WORD.findall(text.lower())) for b in word_features(w)}), np.int64)


def places(features: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where the found buckets are among the features; others are left out."""
    return np.searchsorted(features, found[np.isin(found, features, assume_unique=True)])


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """The sentences that name a group, each with its terms swapped."""
    return [(s, swapped(s)) for s in SENTENCE.findall(text) if any(w in SWAPS for w in WORD.findall(s.lower()))]


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def fit(features: np.ndarray, rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY, ridge: float = 2e-6, steps: int = 600, rate: float = 0.05) -> dict:
    """Weights that make the log loss, a ridge and ``penalty`` times the mean squared score change least.

    ``rows`` are the places of each text's buckets among the features. The score change is that of a labelled sentence
    that names groups, when its terms are swapped for others of their kind: ``pairs`` are the places of both. One label
    alone (or no text) gives a model that scores the share of label 1 everywhere, a half without any labels.
    """
    y = np.asarray(y, np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = {"b": float(np.log(share / (1 - share))), "features": np.zeros(0, np.int64), "w": np.zeros(0)}
    k = len(features)
    if len(set(y.tolist())) < 2 or not k:
        return model
    row, column = _flat(rows)
    here, there = _flat([p[0] for p in pairs]), _flat([p[1] for p in pairs])
    w, b = np.zeros(k), model["b"]
    m, s, n = np.zeros(k + 1), np.zeros(k + 1), len(y)
    for step in range(1, steps + 1):
        error = (sigmoid(b + np.bincount(row, w[column], n)) - y) / n
        g = np.bincount(column, error[row], k) + ridge * w
        if pairs:
            change = np.bincount(here[0], w[here[1]], len(pairs)) - np.bincount(there[0], w[there[1]], len(pairs))
            pull = 2 * penalty * change / len(pairs)
            g += np.bincount(here[1], pull[here[0]], k) - np.bincount(there[1], pull[there[0]], k)
        g = np.append(g, error.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:k], b - move[k]
    heavy = np.abs(w) > 1e-3
    return {"b": float(b), "features": features[heavy], "w": w[heavy]}


def learned(texts: DataFrame, penalty: float = PENALTY) -> dict:
    """The model of a bounded sample (label, text).

    Buckets are counted on the executors, which also look up the chosen ones; the driver gets those and their places.
    """
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([text_features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), found], ["label", "buckets"])

    texts = materialise(texts.select("__id", F.col("label").cast("double").alias("label"), "text"), "labelled")
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("y")).first()
    if not total["n"] or total["y"] in (0, total["n"]):
        return fit(np.zeros(0, np.int64), [], np.full(total["n"], total["y"] > 0), [])
    share = total["y"] / total["n"]
    counts = texts.select("label", "text").mapInArrow(buckets, "label double, buckets array<bigint>").select("label", F.explode("buckets").alias("bucket"))
    counts = counts.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("y")).filter(F.col("n") >= LEAST_TEXTS)
    rated = counts.select("bucket", (F.abs(F.col("y") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))).alias("gain"))
    best = rated.filter(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "bucket").limit(FEATURES).collect()
    features = np.array(sorted(r["bucket"] for r in best), np.int64)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda text: places(features, text_features(text)).astype("<i4").tobytes()
        for batch in batches:
            own = batch.column("text").to_pylist()
            pairs = [[x for a, b in counterfactuals(t) for x in (packed(a), packed(b))] for t in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("label"), pa.array([packed(t) for t in own], pa.binary()), pa.array(pairs, pa.list_(pa.binary()))],
                ["id", "label", "found", "pairs"])

    kind = dict(texts.dtypes)["__id"]
    rows = texts.mapInArrow(looked_up, f"id {kind}, label double, found binary, pairs array<binary>").orderBy("id").collect()
    unpacked = lambda raw: np.frombuffer(raw, "<i4").astype(np.int64)
    pairs = [(unpacked(a), unpacked(b)) for r in rows for a, b in zip(r["pairs"][::2], r["pairs"][1::2])]
    return fit(features, [unpacked(r["found"]) for r in rows], np.array([r["label"] for r in rows]), pairs, penalty)


@cache
def _memo(name: bytes) -> dict[str, tuple[int, ...]]:
    return {}


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    """The probability of label 1 for each text."""
    features = model["features"]
    weights = dict(zip(features.tolist(), model["w"].tolist()))
    memo = _memo(xxhash.xxh3_128_digest(features.tobytes()))
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        found = set()
        for w in set(WORD.findall(text.lower())):
            own = memo.get(w)
            if own is None:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                own = memo[w] = tuple(x for x in word_features(w) if x in weights)
            found.update(own)
        out[i] = model["b"] + sum(weights[x] for x in sorted(found))
    return sigmoid(out)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
    modulus: int = 5, left_out: int = 0, threshold: float = 0.5, sample: int = SAMPLE, penalty: float = PENALTY,
) -> DataFrame:
    """key, held_out, score and predicted of every document: how likely its label is 1.

    The classifier learns from at most ``sample`` labelled documents (see ``learning.labelled_texts``) whose key has
    another remainder than ``left_out``, and sees nothing but the text: hashed words and beginnings of words, whether
    they occur. Scores are between 0 and 1, of empty and null texts too (the share that the model starts from). A row
    without a key is scored and counts as held out. Repeated rows get equal scores. An empty table gives no rows;
    without labels, or with one kind alone, all texts get the share of label 1. Other columns are not looked at.
    """
    own = learning.labelled_texts(docs, labels, label, learning.remainder(key, modulus) != left_out, sample, key, text)
    model = learned(own, penalty)
    held = F.coalesce(learning.remainder(key, modulus) == left_out, F.lit(True))
    return learning.scored(docs, lambda texts: score_texts(model, texts), key, text).select(
        key, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
