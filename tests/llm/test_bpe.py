import hashlib
import os
import random

import numpy as np
import pytest
from corpora import documents, empty, odd_texts, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from ochre.llm import bpe, queries
from ochre.llm.tokens import vocabulary

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
LETTERS = "ab's tdrevmlST  \n\t19,.é日 '😀 　\x1c\x85"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary_ranks(PATH).ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.vocabulary_ranks(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=40))
def test_pieces_are_the_patterns(text):
    import public_tokenizers
    import regex

    raw = np.frombuffer(text.encode(), np.uint8)
    expected = [len(text[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, text)]
    assert bpe.pieces(raw, np.array([0, len(raw)])).tolist() == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text(alphabet=LETTERS, max_size=30), max_size=6))
def test_blocks_as_the_library(library, ranks, texts):
    raw = [t.encode() for t in texts]
    ids, ends = ranks.encode_block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode_ordinary(t) for t in texts]


def test_every_code_point(library, ranks):
    for first in range(0, 0x110000, 1 << 14):
        text = "".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)}." for c in range(first, first + (1 << 14)) if not 0xD800 <= c < 0xE000)
        assert ranks.encode(text).tolist() == library.encode_ordinary(text), hex(first)


def test_long_pieces(library, ranks):
    r = random.Random(3)
    for text in ("ab" * 20_000, "x" * 50_000, "".join(r.choice("abcdefgh") for _ in range(20_000)), " " * 9999 + "x", "日本" * 5000):
        assert ranks.encode(text).tolist() == library.encode_ordinary(text)


def test_perfect_hash(ranks):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    keys = np.unique(keys)
    table = bpe.PerfectHash(keys[::2])
    assert sorted(table.find(keys[::2]).tolist()) == list(range(len(keys[::2])))
    assert len(ranks.id) == len(ranks.ranks) == len(set(ranks.id.tolist()))
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([5, 5], np.uint64))


def test_keys_that_meet(library, ranks, monkeypatch):
    """Pieces with one key are told apart by their bytes."""
    text = "some words and some other words, anoninreerst 12"
    monkeypatch.setattr(bpe, "piece_hashes", lambda data, starts, lengths: np.full(len(starts), 7, np.uint64))
    assert ranks.encode(text).tolist() == library.encode_ordinary(text)


def test_texts_in_parts(library, ranks, monkeypatch):
    r = random.Random(4)
    text = prose(r, 300) + "\n\n  " + "x" * 400 + " \n y" + prose(r, 50) + "  "
    raw = np.frombuffer(text.encode(), np.uint8)
    for most in (1, 7, 50, 300):
        cuts = list(bpe.parts(raw, most))
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(raw)
        ids = np.concatenate([ranks.encode_block(raw[a:b], np.array([0, b - a]))[0] for a, b in cuts])
        assert ids.tolist() == library.encode_ordinary(text)
    monkeypatch.setattr(bpe, "PART_BYTES", 64)
    assert ranks.encode(text).tolist() == library.encode_ordinary(text)


def test_table(spark, library):
    texts = odd_texts() + ["word " * 400_000, "it's <|endoftext|> text"]  # the long one is taken in parts
    docs = documents(spark, texts).withColumnRenamed("score", "ids")
    rows = {r["doc_id"]: r for r in bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        assert rows[k]["ids"] == library.encode_ordinary(text or "")
        assert bytes(rows[k]["decoded"]) == (text or "").encode() and rows[k]["text"] == text
    assert bpe.decode_ids(bpe.encode_texts(empty(spark), PATH), PATH).count() == 0


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [5, None, 6]), (4, [7])], "k int, ids array<int>")
    found = {r["k"]: bytes(r["decoded"]) for r in bpe.decode_ids(rows, PATH).collect()}
    token = {v: k for k, v in bpe.vocabulary_ranks(PATH).ranks.items()}
    assert found == {1: b"", 2: b"", 3: token[5] + token[6], 4: token[7]}
    with pytest.raises(Exception, match="no token"):
        bpe.decode_ids(spark.createDataFrame([(1, [60_000])], "k int, ids array<int>"), PATH).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
