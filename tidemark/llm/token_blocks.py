"""Token ids of documents in binary shards of patched frame-of-reference blocks, and the reader.

A shard is the blocks of consecutive documents (see ``frames``), then an Arrow table with a row
per document (order, key, n_tokens, first byte), an Arrow table with the start of every block,
and a tail that says how long the two are. Shards of a folder are numbered in document order.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import fresh_path, materialise, ship
from . import files, frames
from .memory import tidy

TAIL = "<QQ"
SHARD_BYTES = 64 << 20
MEMO_BYTES = 12 << 20
MEMO_CHARS = 64
ENTRY_BYTES = 200  # what a dictionary needs for an entry beside its letters and ids
WORDS_AT_ONCE = 2048
SIGNS = string.punctuation.replace("'", "")  # an apostrophe may begin a token of letters
#: Letters whose lower case is one letter of the same form.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    return tokenizer


class Memo:
    """Ids of words met lately in a task: of two generations that take ``MEMO_BYTES`` each, the older one goes."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def ids_of(self, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of each word; ``encode`` gives those of the words that are not known."""
        out = list(map(self.young.get, words))
        lacking = [i for i, ids in enumerate(out) if ids is None]
        for i in lacking:
            out[i] = self.old.get(words[i])
        new = [i for i in lacking if out[i] is None]
        for i, ids in zip(new, encode([words[i] for i in new]) if new else ()):
            out[i] = ids
        for i in lacking:
            if len(words[i]) <= MEMO_CHARS:
                self.young[words[i]] = out[i]
                self.bytes += len(words[i]) + len(out[i]) + ENTRY_BYTES
        if self.bytes > MEMO_BYTES:
            self.old, self.young, self.bytes = self.young, {}, 0
        return out


@cache
def _takes_parts(path: str) -> bool:
    """Whether ids of a text are those of its parts: between blanks, and of a word and the signs after it."""
    ids = lambda t: _tokenizer(path).encode(t, add_special_tokens=False).ids
    probes = ("Ab c", ["ab", "c"]), ("x\ny", ["x", "y"]), ("Éa,.; b!", ["éa", ",.;", "b", "!"]), ("  a  %%% ", ["a", "%%%"])
    return all(ids(whole) == [i for p in parts for i in ids(p)] for whole, parts in probes)


@cache
def _ends(path: str) -> np.ndarray:
    """For each id whether its token ends a word; none do where the tokenizer marks no ends."""
    tokenizer = _tokenizer(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    out = np.zeros(tokenizer.get_vocab_size(), bool)
    if suffix:
        out[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    return out


def _ids_of(parts: Sequence[str], path: str) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in _tokenizer(path).encode_batch_fast(list(parts), add_special_tokens=False)]


def _ids_of_words(words: list[str], path: str) -> list[bytes]:
    """Ids of words of one kind each: letters alone, signs alone, or nothing.

    The library gets many at once, parted by blanks, and their ids are cut where a token ends a word. Where the cuts are
    not as many as the words, it gets them one by one.
    """
    out: list[bytes] = []
    for at in range(0, len(words), WORDS_AT_ONCE):
        some = words[at:at + WORDS_AT_ONCE]
        if "" in some:
            out += _ids_of(some, path)
            continue
        ids = np.array(_tokenizer(path).encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(_ends(path)[ids]) + 1
        if len(cut) != len(some) or len(ids) != cut[-1]:
            out += _ids_of(some, path)
            continue
        raw, edge = ids.astype("<u4").tobytes(), [0, *(4 * cut).tolist()]
        out += [raw[a:b] for a, b in zip(edge, edge[1:])]
    return out


def _taken_apart(parts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Letters in lower case, the signs after them, and whether a part is so made; the others are whole in the first."""
    found = pc.extract_regex(parts, f"^(?P<letters>[{LETTERS}]+)(?P<signs>[{re.escape(SIGNS)}]*)$")
    plain = pc.is_valid(found)
    letters = pc.utf8_lower(pc.struct_field(found, "letters"))
    return pc.coalesce(letters, parts), pc.fill_null(pc.struct_field(found, "signs"), ""), plain


def _looked_up(words: pa.Array, memo: Memo, encode: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the distinct words, one after another, with each word's first place and number among them."""
    distinct = pc.dictionary_encode(words)
    coded = memo.ids_of(distinct.dictionary.to_pylist(), encode)
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    at = distinct.indices.to_numpy()
    return np.frombuffer(b"".join(coded), "<u4"), (np.cumsum(size) - size)[at], size[at]


def _gathered(table: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``table`` that begin at ``first``, one after another."""
    return table[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def encode_texts(texts: pa.Array, path: str, memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and how many each has, as the library gives them for the whole text.

    Where the tokenizer drops blanks and no token, merge or composed character spans one, a text's ids are those of its
    parts between blanks, in order, and those of letters with signs after them are those of the lower-case letters and of
    the signs. Each of these is looked up once for all texts. Any other tokenizer gets the whole texts.
    """
    memo = memo or Memo()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not _takes_parts(path):
        coded = _ids_of(texts.to_pylist(), path)
        return np.frombuffer(b"".join(coded), "<u4"), np.array([len(x) // 4 for x in coded], np.int64)
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    edge = split.offsets.to_numpy()
    parts = pc.dictionary_encode(split.flatten())
    words, signs, plain = _taken_apart(parts.dictionary)
    whole, few = pc.invert(plain), lambda w: _ids_of_words(w, path)
    tables = [(words.filter(plain), few), (words.filter(whole), lambda w: _ids_of(w, path)), (signs, few)]
    (table_w, first_w, size_w), (table_o, first_o, size_o), (table_s, first_s, size_s) = (_looked_up(w, memo, e) for w, e in tables)
    # of each distinct part the ids of its letters, or of all of it, and those of its signs
    own, at = np.concatenate([table_w, table_o, table_s]), plain.to_numpy(zero_copy_only=False)
    first, size = np.empty((len(at), 2), np.int64), np.empty((len(at), 2), np.int64)
    first[at, 0], size[at, 0] = first_w, size_w
    first[~at, 0], size[~at, 0] = first_o + len(table_w), size_o
    first[:, 1], size[:, 1] = first_s + len(table_w) + len(table_o), size_s
    table, total = _gathered(own, first.ravel(), size.ravel()), size.sum(axis=1)
    used = parts.indices.to_numpy()
    n = total[used]
    before = np.concatenate([[0], np.cumsum(n)])
    return _gathered(table, (np.cumsum(total) - total)[used], n), np.diff(before[edge - edge[0]])


def _some_texts(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def tokenised(docs: DataFrame, carried: Sequence[str], path: str, end_id: int, text: str = "text") -> DataFrame:
    """``carried`` columns, ``n_tokens``, ``blocks`` (each document's ids and the end id, packed) and ``sizes``, 16 bits for each block."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for whole in batches:
            for batch in _some_texts(whole, "__text"):
                ids, lengths = encode_texts(batch.column("__text"), path, memo)
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                lengths = lengths + 1
                data, sizes, per_doc = frames.encode(ids, lengths)
                first = np.concatenate([[0], np.cumsum(per_doc)])
                columns = [batch.column(c) for c in carried]
                packed = [_cut(data, np.concatenate([[0], np.cumsum(sizes)])[first]), _cut(sizes.astype("<u2").view(np.uint8), 2 * first)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths), *packed], [*carried, "n_tokens", "blocks", "sizes"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "n_tokens long", "blocks binary", "sizes binary"])
    return docs.select(*carried, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _cut(data: np.ndarray, edge: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())


def _write_shards(folder: str, key: str, most: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        keys: list = []
        sizes: list[int] = []
        counts: list[int] = []
        starts: list[np.ndarray] = []
        part = None
        done, size = [], 0

        def close() -> None:
            nonlocal out
            docs = pa.table({"key": pa.array(keys, kind), "n_tokens": pa.array(counts, pa.int64()), "first_byte": pa.array(sizes, pa.int64())})
            tables = []
            for table in (docs, pa.table({"block_start": pa.array(np.concatenate(starts))})):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                tables.append(sink.getvalue().to_pybytes())
            out.write(tables[0] + tables[1] + struct.pack(TAIL, *map(len, tables)))
            out.close()
            done.append((part, len(done), path, len(keys), sum(counts)))
            out = None

        for batch in batches:
            kind = batch.schema.field(key).type
            for k, n, blocks, own, p in zip(*(batch.column(c).to_pylist() for c in (key, "n_tokens", "blocks", "sizes", "__part"))):
                if out is not None and size + len(blocks) > most:
                    close()
                if out is None:
                    path = files.attempt_name(folder, ".ids")
                    out, keys, sizes, counts, starts, size, part = files.create(path), [], [], [], [], 0, p
                keys.append(k)
                counts.append(n)
                sizes.append(size)
                block_sizes = np.frombuffer(own, "<u2").astype(np.int64)
                starts.append(size + np.cumsum(block_sizes) - block_sizes)
                out.write(blocks)
                size += len(blocks)
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "seq", "path", "n_docs", "n_tokens"), x)) for x in done],
            pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    return run


def write_token_blocks(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", order: str | None = None,
    end_id: int = 2, folder: str | None = None, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write all ids to shards in ascending ``order`` (the key if not given).

    ``order`` is a numeric column. Each task takes a range of it, cut at sketched quantiles so that ranges hold
    about as many documents each; there are ``spark.sql.shuffle.partitions`` ranges. A range with many documents
    makes several shards of ``shard_bytes``. Returns the manifest: part, seq, path, n_docs, n_tokens, first_token.

    A null or empty text gives the end id alone. A null key is kept as it is and a null order comes first. Rows of
    equal order (repeated keys) are ordered by key, length and content, so equal tables give equal shards. An empty
    table gives an empty manifest. Other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "tokens")
    source = docs.select(F.col(order or key).alias("__order"), F.col(key).alias("__key"), F.col(text).alias("__text0"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = [k / n for k in range(1, n)]
    edges = source.agg(F.percentile_approx("__order", marks, 100 * n)).first()[0] if marks else None
    edges = sorted(set(edges or []))
    packed = tokenised(source, ["__order", "__key"], tokenizer, end_id, "__text0")
    # the ranges are few and known, so a search among literals places a row without another pass over the texts
    part = F.coalesce(F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda a, e: a + (F.col("__order") > e).cast("int")), F.lit(0)) if edges else F.lit(0)
    placed = packed.withColumn("__part", part).repartitionById(len(edges) + 1, "__part")
    placed = placed.sortWithinPartitions(F.col("__order").asc_nulls_first(), F.col("__key").asc_nulls_first(), "n_tokens", "blocks")
    manifest = placed.mapInArrow(_write_shards(folder, "__key", shard_bytes), "part int, seq int, path string, n_docs long, n_tokens long")
    manifest = materialise(manifest, "token-manifest")
    # a row per shard, not per document
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shard(path: str, docs_at_once: int = 2048) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, token counts and all ids of some documents after another, in a shard's order."""
    with files.open_random(path) as f:
        end = f.size() - struct.calcsize(TAIL)
        n_docs, n_starts = struct.unpack(TAIL, f.read_at(struct.calcsize(TAIL), end))
        docs = pa.ipc.open_stream(f.read_at(n_docs, end - n_starts - n_docs)).read_all().combine_chunks()
        starts = pa.ipc.open_stream(f.read_at(n_starts, end - n_starts)).read_all()["block_start"].to_numpy()
        first = np.append(docs["first_byte"].to_numpy(), end - n_starts - n_docs)
        counts = docs["n_tokens"].to_numpy()
        for a in range(0, len(counts), docs_at_once):
            b = min(a + docs_at_once, len(counts))
            data = np.frombuffer(f.read_at(int(first[b] - first[a]), int(first[a])), np.uint8)
            own = starts[np.searchsorted(starts, first[a]):np.searchsorted(starts, first[b])] - first[a]
            ids = [frames.decode(data, x)[0] for x in np.array_split(own, max(1, len(own) // 16_384))]
            yield docs["key"].slice(a, b - a).combine_chunks(), counts[a:b], np.concatenate(ids)


def _read(spark_manifest: DataFrame, key_type: str, ids: bool, key: str) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist()):
                for keys, counts, values in read_shard(path):
                    edge = np.concatenate([[0], np.cumsum(counts)])
                    columns = {key: keys, "start": pa.array(first + edge[:-1]), "n_tokens": pa.array(counts)}
                    first += int(edge[-1])
                    raw = values.astype("<u4")
                    columns["ids_crc32"] = pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])], pa.int64())
                    if ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"`{key}` {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * ids
    ship(spark_manifest.sparkSession)
    # a shard is work for a task of its own, so the few rows are spread by hand
    n = int(spark_manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spark_manifest.select("path", "first_token").repartition(n, "path").mapInArrow(run, schema)


def read_token_blocks(manifest: DataFrame, *, key: str = "doc_id", key_type: str = "bigint", ids: bool = True) -> DataFrame:
    """Documents of the shards: key, start (ids before it), n_tokens, ids_crc32 and, if wanted, the ids."""
    return _read(manifest, key_type, ids, key)


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str, order: str | None = None) -> DataFrame:
    """Write the documents' ids to shards, read them back, and return doc_id, start, n_tokens and ids_crc32."""
    kind = dict(docs.dtypes)["doc_id"]
    return read_token_blocks(write_token_blocks(docs, tokenizer, order=order), key_type=kind, ids=False)
