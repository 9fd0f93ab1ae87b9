import os
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from corpora import documents, empty, odd_texts, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ochre.llm import common, packing, queries, token_files, token_rollups
from ochre.llm.common import scratch
from ochre.llm.tokens import encoder, vocabulary

PIECES = ["the", "of", " ", "  ", "\n", "\t", "'s", "é", "日", "😀", "12", ".", "!?", "\u00a0", "\u3000", "\x1c", "<|endoftext|>"]


@lru_cache
def fresh():
    """The library's own tokenizer, apart from the engine's."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def library_ids(text):
    return fresh().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), max_size=4))
def test_ids_are_the_librarys(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, starts = encoder(vocabulary()).encode_block(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [library_ids(t) for t in texts]


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    end, r = "<|endoftext|>", random.Random(7)
    fresh = Tokenizer.from_file(vocabulary())
    texts = [end, f"a {end} b", f"a  {end}  b", f"{end}{end} x", f"one{end}two three", "<|endof", "text|> and", f" {end}\n{end} ", "<|endoftext|", "", "|>", f"é {end}é  {end}\t z"]
    texts += ["".join(r.choice([end, " ", "  ", "\n", "word", " two", "<|", "|>", "é"]) for _ in range(r.randint(1, 12))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, starts = encoder(vocabulary()).encode_block(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == 50256


def test_forgetting_words_changes_nothing(monkeypatch):
    from ochre.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    own = tokens.WordwiseEncoder(vocabulary())
    r = random.Random(1)
    for _ in range(20):
        text = prose(r, 12)
        assert own.encode(text).tolist() == library_ids(text)


def test_words_with_one_key_are_told_apart(monkeypatch):
    from ochre.llm import tokens

    few = lambda data, starts, lengths: lengths.astype(np.uint64) % np.uint64(3)
    monkeypatch.setattr(tokens, "piece_hashes", few)
    monkeypatch.setattr(tokens.WordwiseEncoder, "_first_bytes", staticmethod(lambda data, starts, lengths: np.zeros(len(starts), np.uint64)))
    own = tokens.WordwiseEncoder(vocabulary())
    for text in (" one", " two", " six one", "the end of <|endoftext|> it", "é  日本"):  # the first words stay known
        assert own.encode(text).tolist() == library_ids(text)


def long_text():
    r = random.Random(9)
    return (prose(r, 4000) + " \n é <|endoftext|> x  ") * 125


def test_a_long_text(spark):
    text = long_text()
    assert len(text) > 3_000_000
    ids = [*library_ids(text), 0]
    docs = documents(spark, ["a b", text, None])
    row = token_files.token_files(docs).where("doc_id = 1").first()
    assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (len(library_ids("a b")) + 1, len(ids), crc(ids))
    pieces = packing.pack_documents(docs).where("doc_id = 1").orderBy("piece").collect()
    assert sum(p["length"] for p in pieces) == len(ids) and all(p["length"] == 2048 for p in pieces[1:])
    assert all(crc(ids[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for p in pieces)
    counts = token_rollups.count_tokens(docs, "byte_bpe_50k", vocabulary())
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()} == {0: len(library_ids("a b")), 1: len(ids) - 1, 2: 0}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    rows = token_files.token_files(documents(spark)).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(rows, odd_texts(), strict=True):
        ids = [*library_ids(text), 0]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_of_odd_tables(spark):
    assert token_files.token_files(empty(spark)).count() == 0
    twice = documents(spark, ["a b", "c"]).unionByName(documents(spark, ["a b"])).unionByName(documents(spark, ["z"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = token_files.token_files(twice).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 0, 0, 1] and rows[-1]["start"] == sum(r["n_tokens"] for r in rows[:-1])


def test_files_of_a_store_that_cannot_be_mapped(tmp_path, monkeypatch):
    from pyarrow import fs

    (tmp_path / "x").write_bytes(np.arange(100, dtype="<u2").tobytes())
    mapped = token_files.Flat(str(tmp_path / "x"), "<u2")
    monkeypatch.setattr(token_files, "filesystem", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri))
    ranged = token_files.Flat(str(tmp_path / "x"), "<u2")
    assert mapped.mapped is not None and ranged.mapped is None
    assert mapped[30:40].tolist() == ranged[30:40].tolist() == list(range(30, 40)) and ranged[5:5].tolist() == []


def test_shards_by_size(spark, monkeypatch):
    whole = sorted(map(tuple, token_files.token_files(documents(spark)).collect()))
    monkeypatch.setattr(token_files, "SHARD_BYTES", 1000)
    monkeypatch.setattr(token_files, "DOCS_AT_ONCE", 2)
    assert len(token_files.write_token_files(documents(spark), scratch(spark, "t"))) > 4
    assert sorted(map(tuple, token_files.token_files(documents(spark)).collect())) == whole


def test_packing(spark):
    rows = packing.pack_documents(documents(spark), capacity=64).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(odd_texts()):
        ids, own = [*library_ids(text), 0], sorted(pieces[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert all(r["length"] == 64 for r in own[1:]) and sum(r["length"] for r in own) == len(ids) and (len(own) == 1) == (len(ids) <= 64)
        assert all(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in own)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packed_ids(spark):
    pieces = packing.document_pieces(documents(spark, ["a b c", "d", None]), 16, with_ids=True)
    from ochre.llm.common import written

    rows = packing.packed_sequences(packing.assign(written(pieces, "t"), 16)).collect()
    assert sorted(i for r in rows for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()) == sorted([*library_ids("a b c"), *library_ids("d"), 0, 0, 0])


def simulated_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, f in enumerate(free) if f >= n]
        if fitting:
            free[min(fitting, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return len(free)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = packing.plan_bins(histogram, 20)
    assert bins == simulated_best_fit(lengths, 20)
    used: dict = {}
    for k, (n, rank, first, offset) in enumerate(plan):
        stop = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == n else histogram[n]
        for b in range(first, first + stop - rank):
            used.setdefault(b, []).append((offset, n))
    assert len(used) == bins and sum(map(len, used.values())) == len(lengths)
    for own in used.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 20


def test_rollups(spark):
    docs = documents(spark)
    counts = token_rollups.count_tokens(docs, "byte_bpe_50k", vocabulary())
    store = token_rollups.RollupStore(spark, scratch(spark, "rollups"))
    assert store.totals().count() == 0
    assert store.commit("a/b", token_rollups.inserted(counts)) and not store.commit("a/b", token_rollups.inserted(counts))
    expected: dict = {}
    for k, t in enumerate(odd_texts()):
        own = expected.setdefault((f"src{k % 3}", "en" if k % 2 else "fr"), [0, 0, 0])
        for i, n in enumerate((1, len(library_ids(t)), len(t or ""))):
            own[i] += n
    assert {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"], r["n_chars"]] for r in store.totals().collect()} == expected
    second = token_rollups.count_tokens(docs, "multi", vocabulary("byte_bpe_multi_50k.tiktoken"))
    assert store.commit("recount", token_rollups.revised(counts, second))
    assert {r["tokenizer_version"] for r in store.totals().collect()} == {"multi"}
    assert store.commit("gone", token_rollups.deleted(second)) and store.totals().count() == 0
    assert store.commit("nothing", token_rollups.inserted(counts.limit(0))) and store.batches() == ["a/b", "gone", "nothing", "recount"]


def test_rollups_compact_and_refuse_other_changes(spark):
    docs = documents(spark, ["one", "two words", None, "so on and on"]).withColumn("tokenizer_version", F.lit("x")).withColumn("sign", F.lit(9))
    counts = token_rollups.count_tokens(docs.unionByName(docs), "byte_bpe_50k", vocabulary())  # repeated rows count each
    assert sum(r["n_docs"] for r in counts.groupBy().agg(F.count("*").alias("n_docs")).collect()) == 8
    store = token_rollups.RollupStore(spark, scratch(spark, "rollups"))
    store.compact()
    for k in range(3):
        assert store.commit(f"b{k}", token_rollups.inserted(counts))
        wanted = sorted(map(str, store.totals().collect()))
        store.compact()
        assert sorted(map(str, store.totals().collect())) == wanted and store.batches() == [f"b{i}" for i in range(k + 1)]
        assert not any(store.commit(f"b{i}", token_rollups.inserted(counts)) for i in range(k + 1))
        assert sorted(map(str, store.totals().collect())) == wanted
    assert len(store._names("base=")) == 2 and len(store._names("batch=")) == 1  # what the base before held is gone
    for changes in (token_rollups.deleted(counts), token_rollups.inserted(counts.limit(3))):
        with pytest.raises(ValueError, match="other changes"):
            store.commit("b1", changes)
    assert sorted(map(str, store.totals().collect())) == wanted and not store._names("_attempt")


def best_possible(lengths, capacity):
    """The least number of bins, by trying every way."""
    best = len(lengths)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for i in sorted({f: i for i, f in enumerate(free) if f >= lengths[k]}.values()):
            place(k + 1, [f - lengths[k] if j == i else f for j, f in enumerate(free)])
        place(k + 1, [*free, capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bins_are_bounded_from_below(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    lengths.sort(reverse=True)
    assert packing.least_bins(histogram, 12) <= best_possible(lengths, 12) <= packing.plan_bins(histogram, 12)[1]


def test_sequences_of_a_real_table_are_as_few_as_can_be(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    rows = packing.pack_documents(spark.read.parquet(folder)).select("length", "sequence_id").collect()
    histogram = Counter(r["length"] for r in rows)
    used, least = len({r["sequence_id"] for r in rows}), packing.least_bins(histogram, 2048)
    assert least <= used <= least + 1 + least // 200, (used, least)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_rollup_query_by_hand(spark):
    """Three batches, each committed twice, with two tokenizers, worked out document by document."""
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    one, other = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), token_rollups._ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    expected: dict = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        if r["doc_id"] in toxic:
            continue
        text = r["text"] or ""
        english = r["lang"] == "en"
        n = len(one.encode(text, add_special_tokens=False).ids) if english else len(other.encode_ordinary(text))
        sums = expected.setdefault((r["source"], r["lang"], "byte_bpe_50k" if english else "byte_bpe_multi_50k"), [0, 0, 0])
        for k, v in enumerate((1, n, len(text))):
            sums[k] += v
    rows = queries.op2_token_rollups(spark, folder).collect()
    assert {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_tokens"], r["n_chars"]] for r in rows} == expected


def test_clashing_columns(spark):
    """Columns named like outputs or intermediates change nothing."""
    docs = documents(spark, ["some words here", "", None, "more words"], extra=False)
    clash = docs
    for name in ("ids", "n", "start", "length", "offset", "sequence_id", "piece", "rank", "shard", "n_tokens", "text_hash", "ids_crc32"):
        clash = clash.withColumn(name, F.lit("x"))
    plain = lambda rows: sorted(map(str, rows.collect()))
    assert plain(token_files.token_files(clash)) == plain(token_files.token_files(docs))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert plain(packing.pack_documents(clash, capacity=64).select(*columns)) == plain(packing.pack_documents(docs, capacity=64).select(*columns))


def test_token_files_leave_nothing(spark):
    folder = f"{common.shared_dir(spark)}/ochre"
    common.clear_scratch(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert token_files.token_files(documents(spark)).count() and set(os.listdir(folder)) > before
    common.clear_scratch(spark)
    assert set(os.listdir(folder)) == before
