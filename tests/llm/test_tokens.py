import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

from llm.tokens import Block, WordCache, encode_block, encode_docs, read_blocks, token, tokenizer_path, write_blocks  # noqa: E402


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60_000), max_size=40), min_size=1, max_size=8))
def test_round_trip_and_random_access(docs):
    arrays = [np.array(d, np.uint32) for d in docs]
    b = Block(encode_block(arrays, [None, *range(1, len(docs))]))
    flat = [x for d in docs for x in d]
    assert b.ids().tolist() == flat and [b[i] for i in range(len(flat))] == flat
    assert b.doc_ids == [None, *range(1, len(docs))] and b.starts.tolist() == np.cumsum([0] + [len(d) for d in docs]).tolist()


def test_large_block_uses_its_rank_directory():
    x = np.random.default_rng(2).zipf(1.3, 20_000).clip(1, 49_000).astype(np.uint32)
    b = Block(encode_block([x], [7]))
    assert len(b.widths) > 1 and all(b[i] == x[i] for i in range(0, 20_000, 37))
    with pytest.raises(IndexError):
        b[20_000]


TEXTS = ["Hello world. It's 12 o'clock, e.g. now", "", None, "Ünïcödé ÉÀ. … don't 'S x\x1cy", "a<|endoftext|>b <| z", "Straße\tand\nlines.", "no.stop,here ... ,.", "漢字かな", "İstanbul Σ ΑΣ"] * 3


def test_ids_equal_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in TEXTS]
    rows = [(i * 3 if i else None, x, "e", None, 0) for i, x in enumerate(TEXTS)]
    d = spark.createDataFrame(rows[::-1], "doc_id bigint, text string, shard string, start string, n_ids bigint")
    got = sorted(encode_docs(d).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r, x in zip(got, ids):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    # many shards and blocks give the same
    path = f"file://{tmp_path}/ids"
    write_blocks(d, path, tokenizer_path(), block_ids=20, shard_bytes=100)
    many = sorted(read_blocks(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.ids_crc32) for r in many] == [(r.doc_id, r.start, r.ids_crc32) for r in got]
    r = many[5]
    assert token(spark, path, r.shard, r.block, 0) in ids[5] + ids[4] + ids[3]


def test_repeated_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id bigint, text string")
    assert sorted(r.start for r in encode_docs(d).collect()) == [0, 2, 4]
    assert encode_docs(d.limit(0)).count() == 0


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_words_that_a_polynomial_hash_confuses(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), thue_morse(64, "a", "b"), thue_morse(64, "b", "a"), "z" * 200_000]
    got = {r.doc_id: r.ids_crc32 for r in encode_docs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_words_with_one_hash_in_common(monkeypatch):
    from tokenizers import Tokenizer

    import llm.tokens as T

    def weak(data, s, e, lower=False, seed=0):
        return T_hash(data, s, e, lower, seed) if seed else (e - s).astype(np.uint64)

    T_hash = T.word_hash
    monkeypatch.setattr(T, "word_hash", weak)
    t, cache = Tokenizer.from_file(tokenizer_path()), WordCache(tokenizer_path())
    for text in ("alpha omega gamma a b c omega", "gamma kappa zz", ""):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert cache.encode(raw, np.array([0, len(raw)]), 1)[0].tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]
