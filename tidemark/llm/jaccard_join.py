"""Documents whose word n-gram sets are similar: MinHash banding, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise, ship
from . import minhash
from .learning import slices
from .memory import tidy

RECALL = 0.9999


def signatures(docs: DataFrame, key: str, text: str, bands: int, words: int) -> DataFrame:
    """``__id``, ``node`` (the content key; null without words) and ``bands`` of each document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            nodes, signed = [], []
            for t in batch.column("__text").to_pylist():
                w = minhash.words_of(t)
                nodes.append(minhash.content_key(w) if w else None)
                signed.append(minhash.band_hashes(minhash.shingles(w, words), bands) if w else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(nodes, pa.binary()), pa.array(signed, pa.list_(pa.int64()))], ["__id", "node", "bands"]
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"__id {kind}, node binary, bands array<bigint>")


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__node``, the content key of each row's text; null without words."""
    names = docs.columns
    plain = dict(docs.dtypes)[text] == "string"  # no second copy of the texts then
    source = docs if plain else docs.withColumn("__text", F.col(text).cast("string"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words = (minhash.words_of(t.as_py()) for t in batch.column(text if plain else "__text"))
            nodes = pa.array([minhash.content_key(w) if w else None for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, nodes], [*names, "__node"])

    return source.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__node", T.BinaryType())]))


def similar_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = minhash.SIMILARITY,
    words: int = minhash.WORDS, recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``docs``: the key, ``class_id``, ``n_links`` and ``n_copies``.

    Words are parted by white space and compared in lower case. Documents of the same words are copies, one text.
    Two texts are linked if the Jaccard similarity of their sets of five-word runs is at least ``similarity``; a text
    of fewer words has one run, all of it. There are as many bands of four MinHash values as find a pair that is just
    similar enough with the probability ``recall``, and all texts that bands tie together are verified on their whole
    sets. ``n_links`` counts the other texts that a document's text is linked to, ``n_copies`` the documents of its
    text, itself included. ``class_id`` is the least key of all documents that copies and links tie together.

    A null or empty text is in a class of its own, without links, with one copy. A row without a key takes part and
    never names a class unless none of the class has a key. Repeated rows count as copies. An empty table gives no rows.
    """
    signed, named = _named(docs, key, text, similarity, words, recall)
    out = signed.select("__id", "node").join(named.select("node", "class_id", "n_links", "n_copies"), "node", "left")
    return out.select(
        F.col("__id").alias(key), F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def _named(docs: DataFrame, key: str, text: str, similarity: float, words: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """``__id, node`` of each row, and ``node, class_id, kept, n_links, n_copies`` of each text; kept is its class's node that stays."""
    ship(docs.sparkSession)
    bands = minhash.bands_for(similarity, recall)
    signed = materialise(signatures(docs, key, text, bands, words), "signatures")
    texts = signed.filter("node is not null").groupBy("node").agg(F.min("__id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    texts = materialise(texts, "texts")

    def with_grams(members: DataFrame) -> DataFrame:
        # by content: a key may be null, repeated or have several texts; copies become one before the shuffle
        source = keyed(docs.select(F.col(text).cast("string").alias("__copy")), "__copy").filter("__node is not null")
        source = source.groupBy(F.col("__node").alias("node")).agg(F.first("__copy").alias("__text"))
        return minhash.grams_of(source.join(members, "node"), ["node", "cluster", "side", "units"], n=words)

    classes, counts = minhash.links(texts.select("node", "bands"), with_grams, similarity)
    named = texts.select("node", "rep", "n_copies").join(classes, "node", "left").join(counts, "node", "left")
    named = named.select("node", "rep", "n_copies", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = materialise(named, "classes")
    first = F.struct(F.col("rep").isNull(), "rep", "node")
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.min_by("node", first).alias("kept"))
    return signed, named.join(least, "component").select("node", "class_id", "kept", "n_links", "n_copies")


def without_near_copies(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = minhash.SIMILARITY,
    words: int = minhash.WORDS, recall: float = RECALL,
) -> DataFrame:
    """One row of each class of near copies, with all its columns, and all rows with a null or empty text.

    Of a class a row of the least key stays, rows without a key last. Of rows of that key, those of one text only, and of
    these the one that comes first by a hash of its columns. Rows are told apart by their texts, so other texts of a key
    stay where one of them goes.
    """
    _, named = _named(docs, key, text, similarity, words, recall)
    gone = named.filter("node <> kept").select("node")
    # a row without words is a group of its own, by a number shorter than any content key
    rows = keyed(docs, text).withColumn("__at", F.coalesce("__node", F.unhex(F.hex(F.monotonically_increasing_id()))))
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(*plain))
    # copies become one before the shuffle
    one = rows.groupBy("__at").agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
    return one.join(gone, F.col("__at") == F.col("node"), "left_anti").select("__row.*")
