import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, documents, prose
from tidemark.llm import frames, token_blocks

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(text, memo=None):
    return token_blocks.encode_texts(pa.array([text]), PATH, memo)[0].tolist()


def _library(text):
    return token_blocks._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def _want(rows):
    """(doc_id, start, n_tokens, crc) of rows in order, by the library on whole texts."""
    out, start = [], 0
    for key, text in rows:
        ids = [*_library(text), 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400), max_size=5))
def test_blocks_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    data, sizes, per_doc = frames.encode(ids, np.array([len(d) for d in docs], np.int64))
    back, counts = frames.decode(data, np.cumsum(sizes) - sizes)
    assert back.tolist() == ids.tolist() and sizes.sum() == len(data)
    assert per_doc.tolist() == [-(-len(d) // frames.BLOCK) for d in docs] and counts.sum() == len(ids)


def test_few_outliers_become_exceptions():
    ids = np.full(128, 1000, np.uint32)
    ids[5] = 4_000_000_000
    data, sizes, _ = frames.encode(ids, np.array([128]))
    assert data[6] == 1 and data[5] == 0 and sizes[0] == frames.HEAD + 5


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_words_give_the_ids_of_whole_texts(text):
    assert _ids(text) == _library(text)


@pytest.mark.parametrize("text", ["á ́b", "ΟΔΟΣ ΟΔΟΣ", "<|endoftext|>x <|startoftext|>", "don't  I'LL", "1234 ²½", " a b\x85c", "İI ﬁ"])
def test_awkward_texts_give_the_ids_of_whole_texts(text):
    assert _ids(text) == _library(text)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_blocks, "MEMO_BYTES", 5 * token_blocks.ENTRY_BYTES)
    texts = [" ".join(f"w{i}x{j}" for j in range(4)) for i in range(9)] + ["w0x0 w8x3 " + "long" * 30, "abc abc, ABC!! x", "w8x3 abc"]
    memo = token_blocks.Memo()
    for t in texts:
        assert _ids(t, memo) == _library(t)
        assert len(memo.young) + len(memo.old) < 30 and not any(len(w) > token_blocks.MEMO_CHARS for w in memo.young)


def test_many_texts_at_once_give_the_ids_of_each():
    rng = random.Random(9)
    texts = [None, "", *(prose(rng, rng.randint(0, 50)).replace("a", rng.choice(["a", "Á", "\n", " ,.", "1", "'s "])) for _ in range(80)), "", "x"]
    ids, n = token_blocks.encode_texts(pa.array(texts).slice(1), PATH)
    edge = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [_library(t) for t in texts[1:]]


def test_a_tokenizer_without_ends_of_words_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, n = token_blocks.encode_texts(pa.array(["Ab  c\n d", None, "x y"]), path)
    want = [token_blocks._tokenizer(path).encode(t, add_special_tokens=False).ids for t in ("Ab  c\n d", "", "x y")]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


@pytest.mark.parametrize("w", range(1, 33))
def test_packing_round_trips_at_every_width(w):
    values = np.random.default_rng(w).integers(0, 2**w, (5, frames.BLOCK), np.uint64).astype(np.uint32)
    bits = (values[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
    rows = frames._packed(values, w)
    assert (rows == np.packbits(bits.astype(np.uint8).reshape(5, -1), axis=1, bitorder="little")).all()
    assert (frames._unpacked(rows, w) == values).all()


def test_documents_equal_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in token_blocks.token_digest(spark, docs, PATH).collect())
    assert got == _want(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_shards_are_cut_and_ids_come_back(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 300))) for i in range(60)]
    manifest = token_blocks.write_token_blocks(documents(spark, rows[::-1]), PATH, shard_bytes=1500)
    assert manifest.count() > 8
    got = sorted((r.doc_id, r.start, list(r.ids)) for r in token_blocks.read_token_blocks(manifest).collect())
    assert [g[2] for g in got] == [[*_library(t), 2] for _, t in rows]
    assert [g[1] for g in got] == [w[1] for w in _want(rows)]


def test_awkward_table(spark):
    df = awkward(spark, random.Random(2))
    got = token_blocks.token_digest(spark, df, PATH).collect()
    assert len(got) == df.count() and sum(r.doc_id is None for r in got) == 2
    by_start = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(by_start, by_start[1:]))
    assert {r.doc_id for r in sorted(got, key=lambda r: r.start)[:2]} == {None}
    assert next(r for r in got if r.doc_id == 1).n_tokens == 1
    want = {(r.doc_id, zlib.crc32(np.array([*_library(r.text), 2], "<u4").tobytes())) for r in df.collect()}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want


def test_order_column(spark):
    df = documents(spark, [(1, "a b"), (2, "c"), (3, "d e f")]).selectExpr("*", "-doc_id as at")
    got = {r.doc_id: r.start for r in token_blocks.token_digest(spark, df, PATH, order="at").collect()}
    assert got == {3: 0, 2: 4, 1: 6}


def test_empty_table(spark):
    assert token_blocks.token_digest(spark, documents(spark, []), PATH).count() == 0
