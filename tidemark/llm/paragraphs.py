"""Paragraphs that repeat, exactly or nearly, within and across documents: MinHash banding, exact Jaccard, components.

Beside paragraphs, which are lines, passages are found that begin and end anywhere (see ``passages``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, ship
from . import minhash, passages
from .memory import tidy

RECALL = 0.998
MIN_WORDS = 30


def split_paragraphs(text: str) -> list[tuple[int, int, str]]:
    """Start, end and text of each line, in code points."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line), line))
        at += len(line) + 1
    return out


def signed_paragraphs(docs: DataFrame, key: str, text: str, min_words: int, bands: int) -> DataFrame:
    """``doc, paragraph, start, end, node, bands`` of every paragraph of at least ``min_words`` words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for at, t in enumerate(batch.column("__text").to_pylist()):
                for n, (start, end, line) in enumerate(split_paragraphs(t or "")):
                    words = minhash.words_of(line)
                    if len(words) >= min_words:
                        signed = minhash.band_hashes(minhash.shingles(words), bands)
                        for column, value in zip(rows, (at, n, start, end, minhash.content_key(words), signed)):
                            column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(pa.array(rows[0], pa.int64())), *(pa.array(c, k) for c, k in zip(rows[1:], kinds))],
                ["doc", "paragraph", "start", "end", "node", "bands"],
            )

    kind = dict(docs.dtypes)[key]
    schema = f"doc {kind}, paragraph int, start long, end long, node binary, bands array<bigint>"
    return docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _lines(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """``node, __text`` of every paragraph of at least ``min_words`` words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lines, size = [], [], 0
            for t in batch.column("__text"):
                for line in (t.as_py() or "").split("\n"):
                    words = minhash.words_of(line)
                    if len(words) >= min_words:
                        nodes.append(minhash.content_key(words))
                        lines.append(line)
                        size += len(line)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(lines, pa.string())], ["node", "__text"])
                    nodes, lines, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(lines, pa.string())], ["node", "__text"])

    return docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "node binary, __text string")


def repeated_paragraphs(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
    similarity: float = minhash.SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """The paragraphs that occur more than once: key, paragraph, start, end, class_doc, class_paragraph, occurrences, removed.

    A paragraph is a line of the text with at least ``min_words`` words (parted by white space, compared in lower
    case); start and end are in code points, end exclusive. Paragraphs of the same words are copies; two others are
    linked if the exact Jaccard similarity of their sets of five-word runs is at least ``similarity``. Bands of four
    MinHash values are as many as find a pair that is just similar enough with the probability ``recall``. Components
    of copies and links are classes, named by their first occurrence, by key and then place. All others are removed.

    Null and empty texts have no paragraphs. Rows without a key count as the last ones and so never keep a paragraph
    that a row with a key has. Repeated rows of one key have the same places, so both keep what one keeps.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    bands = minhash.bands_for(similarity, recall)
    own = materialise(signed_paragraphs(docs, key, text, min_words, bands), "paragraphs")
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "paragraph")
    texts = materialise(own.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands")), "texts")

    def with_grams(members: DataFrame) -> DataFrame:
        # by content: a key may be null, repeated or have several texts; copies become one before the shuffle
        source = _lines(docs, text, min_words).groupBy("node").agg(F.first("__text").alias("__text"))
        return minhash.grams_of(source.join(members, "node"), ["node", "cluster", "side", "units"])

    classes, _ = minhash.links(texts.select("node", "bands"), with_grams, similarity)
    named = texts.select("node", "first", "n").join(classes, "node", "left")
    named = materialise(named.select("node", "first", "n", F.coalesce("component", "node").alias("component")), "classes")
    many = named.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("occurrences")).filter("occurrences > 1")
    known = named.join(many, "component").select("node", "kept", "occurrences")
    out = own.select("doc", "paragraph", "start", "end", "node").join(known, "node")
    return out.select(
        F.col("doc").alias(key), "paragraph", "start", "end", F.col("kept.doc").alias("class_doc"),
        F.col("kept.paragraph").alias("class_paragraph"), "occurrences",
        (~(F.col("doc").eqNullSafe(F.col("kept.doc")) & (F.col("paragraph") == F.col("kept.paragraph")))).alias("removed"),
    )


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Repeated paragraphs and passages as one table, told apart by ``kind``.

    Columns: key, kind, paragraph (null for passages), start, end, class_doc, class_start, occurrences, removed; see
    :func:`repeated_paragraphs` and ``passages.repeated_passages``. A passage may lie in a repeated paragraph or span
    several. class_start is the first occurrence's place: a paragraph's number among the lines, a passage's code point.
    """
    lines = repeated_paragraphs(docs, key=key, text=text, **options).select(
        key, F.lit("paragraph").alias("kind"), "paragraph", "start", "end", "class_doc", F.col("class_paragraph").cast("long").alias("class_start"),
        "occurrences", "removed")
    found = passages.repeated_passages(docs, key=key, text=text).select(
        key, F.lit("passage").alias("kind"), F.lit(None).cast("int").alias("paragraph"), "start", "end", "class_doc", "class_start", "occurrences", "removed")
    return lines.unionByName(found)


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every removed paragraph, and the line end after it, and every removed passage cut out of the text.

    What is cut is found by key and place, so rows of one key with several texts are to be told apart before.
    """
    found = repeats(docs, key=key, text=text, **options).filter("removed")
    until = F.col("end") + F.when(F.col("kind") == "paragraph", 1).otherwise(0)
    # a document's own spans, so no more than its text has
    gone = found.groupBy(F.col(key).alias("__id")).agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), until.alias("b")))).alias("__gone"))
    joined = docs.join(gone, docs[key] == F.col("__id"), "left")

    def step(at, span):
        piece = F.substring(F.col(text), (at["at"] + 1).cast("int"), F.greatest(F.lit(0), span["a"] - at["at"]).cast("int"))
        return F.struct(F.greatest(at["at"], span["b"]).alias("at"), F.concat(at["left"], F.array(piece)).alias("left"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("left"))
    rest = lambda at: F.concat(F.array_join(at["left"], ""), F.substring(F.col(text), (at["at"] + 1).cast("int"), F.length(text)))
    left = F.aggregate("__gone", start, step, rest)
    # with the last line the line end before it goes
    last = F.exists("__gone", lambda span: span["b"] > F.length(text))
    kept = F.when(F.col("__gone").isNull(), F.col(text)).when(last, F.regexp_replace(left, r"\n\z", "")).otherwise(left)
    return joined.select(*(kept.alias(c) if c == text else docs[c] for c in docs.columns))
