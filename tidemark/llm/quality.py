"""Quality of texts: a factorisation machine over hashed words and statistics of a text's form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning
from .learning import sigmoid
from .memory import tidy

WORD_BUCKETS = 1 << 14
BINS = 12
RANK = 4
SAMPLE = 12_000
EPOCHS = 6
STATISTICS = (
    "upper", "punctuation", "digits", "space", "beyond_ascii", "symbols", "bars", "exclamations", "word_length",
    "distinct_words", "repeats_in_a_row", "words", "distinct_lines", "words_a_line", "most_frequent_word",
)


def word_buckets(words: list[str]) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)


def statistics(text: str, words: list[str], counts: np.ndarray) -> list[float]:
    """The values that STATISTICS names; all are 0 for an empty text."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, lower, upper = max(1, int(raw.sum())), int(raw[97:123].sum()), int(raw[65:91].sum())
    punctuation = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    symbols = int(sum(raw[ord(c)] for c in "#$%&*~^<>{}[]\\"))
    lines = text.split("\n")
    n_words = max(1, len(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        upper / max(1, upper + lower), punctuation / n, int(raw[48:58].sum()) / n, int(raw[9:14].sum() + raw[32]) / n,
        int(raw[128:].sum()) / n, symbols / n, int(raw[ord("|")]) / n, int(raw[ord("!")]) / n_words,
        sum(map(len, words)) / n_words, len(counts) / n_words, repeats / n_words, float(np.log2(1 + len(words))),
        len(set(lines)) / len(lines) if text else 0.0, float(np.log2(1 + len(words) / len(lines))),
        float(counts.max()) / n_words if len(counts) else 0.0,
    ]


def featured(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values, how many each text has, and the statistics. Values of a text have length 1."""
    index, value, size, stats = [], [], [], []
    for text in texts:
        words = text.lower().split()
        buckets, counts = np.unique(word_buckets(words), return_counts=True)
        root = np.sqrt(counts)
        index.append(buckets)
        value.append(root / max(1.0, float(np.sqrt(counts.sum()))))
        size.append(len(buckets))
        stats.append(statistics(text, text.split(), counts))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(index, np.int64), join(value, np.float64), np.array(size, np.int64), np.array(stats, np.float64).reshape(len(texts), len(STATISTICS))


def assembled(index: np.ndarray, value: np.ndarray, size: np.ndarray, stats: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and row starts: hashed words, and for each statistic the bin it falls in, with value 1."""
    k = len(STATISTICS)
    bins = np.stack([WORD_BUCKETS + s * BINS + np.searchsorted(edges[s], stats[:, s], "right") for s in range(k)], axis=1)
    start = np.concatenate([[0], np.cumsum(size + k)])
    out, x = np.empty(start[-1], np.int32), np.ones(start[-1], np.float32)
    own = np.repeat(start[:-1], size) + np.arange(len(index)) - np.repeat(np.cumsum(size) - size, size)
    out[own], x[own] = index, value
    out[(start[1:, None] - k) + np.arange(k)] = bins
    return out, x, start


def fm_score(model: dict, index: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """w0 + sum w x + half of the sum over factors of (sum v x)^2 - sum (v x)^2: linear in the features of a row."""
    if len(start) == 1:
        return np.zeros(0)
    vx = model["v"][index] * x[:, None]
    total = np.add.reduceat(vx, start[:-1], axis=0)
    pairs = 0.5 * (total ** 2 - np.add.reduceat(vx ** 2, start[:-1], axis=0)).sum(axis=1)
    return model["w0"] + np.add.reduceat(model["w"][index] * x, start[:-1]) + pairs


def fit(index: np.ndarray, value: np.ndarray, size: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, rate: float = 0.1, decay: float = 1e-4) -> dict:
    """Weights by AdaGrad on the log loss, from the features of a bounded sample in a fixed order.

    One class alone (or no text) gives a model that scores the share of label 1 everywhere, a half without any labels.
    """
    y = np.asarray(y, np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    width = WORD_BUCKETS + len(STATISTICS) * BINS
    model = {"w0": float(np.log(share / (1 - share))), "w": np.zeros(width), "v": np.zeros((width, rank)), "edges": [np.zeros(0)] * len(STATISTICS)}
    if len(set(y.tolist())) < 2:
        return model
    model["edges"] = [np.unique(np.quantile(stats[:, s], np.arange(1, BINS) / BINS)) for s in range(stats.shape[1])]
    index, x, start = assembled(index, value, size, stats, model["edges"])
    rng = np.random.default_rng(11)
    w, v = model["w"], rng.normal(0, 0.05, (width, rank))
    model["v"] = v
    sum_w, sum_v, sum_0 = np.full(width, 1e-6), np.full((width, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(order) // 128)):
            n = start[rows + 1] - start[rows]
            own = np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            first, i, values = np.cumsum(n) - n, index[own], x[own]
            vx = v[i] * values[:, None]
            total = np.add.reduceat(vx, first, axis=0)
            score = model["w0"] + np.add.reduceat(w[i] * values, first) + 0.5 * (total ** 2 - np.add.reduceat(vx ** 2, first, axis=0)).sum(axis=1)
            error = (sigmoid(score) - y[rows]) / len(rows)
            each = np.repeat(error, n) * values
            seen, place = np.unique(i, return_inverse=True)
            g = np.bincount(place, each) + decay * w[seen]
            sum_w[seen] += g * g
            w[seen] -= rate * g / np.sqrt(sum_w[seen])
            for f in range(rank):
                g = np.bincount(place, each * (np.repeat(total[:, f], n) - vx[:, f])) + decay * v[seen, f]
                sum_v[seen, f] += g * g
                v[seen, f] -= 0.5 * rate * g / np.sqrt(sum_v[seen, f])
            sum_0 += error.sum() ** 2
            model["w0"] -= rate * error.sum() / np.sqrt(sum_0)
    return model


def learned(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, sample: int, key: str, text: str):
    """The function that scores texts, learned from labelled documents whose key has another remainder than ``left_out``."""
    own = learning.labelled_texts(docs, labels, label, learning.remainder(key, modulus) != left_out, sample, key, text)

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value, size, stats = featured(batch.column("text").to_pylist())
            edge = np.concatenate([[0], np.cumsum(size)])
            index, value = index.astype("<i4"), value.astype("<f4")
            packed = [[x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])] for x in (index, value)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("label"), *(pa.array(x, pa.binary()) for x in (*packed, [r.tobytes() for r in stats]))],
                ["id", "label", "words", "value", "stats"])

    kinds = dict(own.dtypes)
    rows = own.mapInArrow(features, f"id {kinds['__id']}, label {kinds['label']}, words binary, value binary, stats binary").orderBy("id").collect()
    joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    size = np.array([len(r["words"]) // 4 for r in rows], np.int64)
    stats = joined("stats", np.float64).reshape(len(rows), len(STATISTICS))
    model = fit(joined("words", "<i4"), joined("value", "<f4"), size, stats, np.array([r["label"] for r in rows], np.float64))
    return lambda texts: sigmoid(fm_score(model, *assembled(*featured(texts), model["edges"])))


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
    modulus: int = 4, left_out: int = 2, threshold: float = 0.7, sample: int = SAMPLE,
) -> DataFrame:
    """key, held_out, score and predicted of every document: how likely its label is 1.

    The machine learns from at most ``sample`` labelled documents (see ``learning.labelled_texts``) whose key has
    another remainder than ``left_out``, and sees nothing but the text. Scores are between 0 and 1, of empty and null
    texts too (an empty text has the statistics 0). A row without a key is scored and counts as held out. Repeated
    rows get equal scores. An empty table gives no rows; without labels, or with one kind alone, all texts get the
    share of label 1. Columns beside key and text are not looked at.
    """
    score = learned(docs, labels, label, modulus, left_out, sample, key, text)
    held = F.coalesce(learning.remainder(key, modulus) == left_out, F.lit(True))
    return learning.scored(docs, score, key, text).select(
        key, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
    modulus: int = 4, left_out: int = 2, threshold: float = 0.7, sample: int = SAMPLE,
) -> DataFrame:
    """The documents that :func:`quality_scores` doesn't reject, with all their columns, in one pass without a shuffle."""
    return learning.kept(docs, learned(docs, labels, label, modulus, left_out, sample, key, text), lambda scores: scores >= threshold, text)
