"""Byte-level BPE, trie counts and packed output, against the libraries and brute force."""

import base64
import functools
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, registry, token_counts, token_output
from tidemark.llm.common import Cache, checkpointed, fresh_dir

RANKS_PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORDS_PATH = P.path("word_bpe_49k.json")

TEXTS = [
    None, "", " ", "a", "it's we'll they'd 'S", "  two  spaces\n\n\tand tabs \r\n end  ", "x" * 700, "가나다 한국어 토큰 🎉🎉 é İstanbul ΣΑΣ", "1234567890 3.14 ½²", "don't " * 300, "'" * 500 + "ll", " " * 900 + "x", "   \x1c\x1f\x85 odd spaces",
    "<|endoftext|> special", "ab " * 5000, ("word's " * 40 + "\n") * 60,
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point_splits_as_the_library_does(reference):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)}{chr(c)} {chr(c)}1" for c in points[at : at + 4000])
        assert np.frombuffer(byte_bpe.encode_text(text, RANKS_PATH, P.PATTERN), "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_merges_as_the_library(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_PATH, "rb"))} if not hasattr(test_merges_as_the_library, "r") else test_merges_as_the_library.r
    test_merges_as_the_library.r = ranks
    enc = getattr(test_merges_as_the_library, "e", None) or tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    test_merges_as_the_library.e = enc
    assert np.frombuffer(byte_bpe.encode_text(text, RANKS_PATH, P.PATTERN), "<u4").tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("chunk,overlap", [(40, 16), (64, 20), (333, 50), (32768, 512)])
def test_chunks_give_the_same_ids(spark, reference, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null key " * 30), (3, "repeated key " * 50), (3, "repeated key " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("k", F.lit(2))
    back = byte_bpe.decode(byte_bpe.encode(df, "doc_id", "text", RANKS_PATH, P.PATTERN, chunk, overlap), "ids", RANKS_PATH).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"]), r["n_tokens"]) for r in back))
    want = sorted((k is None, k or 0, np.array(ids := reference.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode(), len(ids)) for k, t in rows)
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, "doc_id", "text", RANKS_PATH, P.PATTERN).count() == 0
    assert token_counts.count(empty, "text", token_counts.rank_scores, P.path("piece_bpe_32k.model")).count() == 0


def test_query_is_the_library(spark, sf, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = registry.op1_byte_bpe(spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = reference.encode_ordinary(docs[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


def test_cache_keeps_what_is_asked_for():
    made = []
    cache = Cache(lambda k: made.append(k) or k.upper(), limit=3, longest=5)
    for k in "abcabdabeabf":
        assert cache[k] == k.upper()
    assert len(cache) + len(cache.old) <= 6 and made.count("a") <= 2
    assert cache["longer than five"] == "LONGER THAN FIVE" and "longer than five" not in cache


def brute(text, scores, floor):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for i in range(1, len(text) + 1):
        options = [(best[j][0] + scores[text[j:i]], -(best[j][1] + 1)) for j in range(i) if text[j:i] in scores]
        if text[i - 1] not in scores:
            options.append((best[i - 1][0] + floor, -(best[i - 1][1] + len(text[i - 1].encode()))))
        s, n = max(options)
        best[i] = s, -n
    return best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé🎉", min_size=1, max_size=70), max_size=6), st.sampled_from([3, 1000]))
def test_trie_counts_as_plain_dynamic_programming(words, nodes):
    scores = {p: -float(i) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "abc", "c", "bca", "▁ab", "cc", "aaaa"], 1)}
    trie = token_counts.Trie(scores, max_nodes=nodes)
    for w in words * 2:
        assert trie.count(w) == brute("▁" + w, scores, trie.floor)


def test_token_count_query(spark, sf):
    """Every document, every word, against plain dynamic programming."""
    scores = token_counts.rank_scores(P.path("piece_bpe_32k.model"))
    floor, longest = token_counts.Trie(scores).floor, max(map(len, scores))

    @functools.cache
    def pieces(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            options = [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in scores]
            if word[i - 1] not in scores:
                options.append((best[i - 1][0] + floor, best[i - 1][1] - len(word[i - 1].encode())))
            best.append(max(options))
        return -best[-1][1]

    docs = {r["doc_id"]: (r["text"] or "").split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in registry.op7_token_counts(spark, sf).collect()}
    assert found == {k: (len(words), sum(pieces("▁" + w) for w in words)) for k, words in docs.items()}


def test_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, " \n "), (None, "the the")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("n_pretokens", F.lit(0))
    rows = token_counts.count(df, "text", token_counts.rank_scores, P.path("piece_bpe_32k.model")).collect()
    assert sorted((r["doc_id"] or 0, r["n_pretokens"]) for r in rows) == [(0, 2), (1, 0), (2, 0), (2, 0)]
    assert {r["n_tokens"] for r in rows if r["doc_id"]} == {0}


ids = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1)), max_size=700)


@settings(max_examples=150, deadline=None)
@given(ids)
def test_packed_ids_come_back(values):
    a = np.array(values, np.uint64)
    offsets, words = token_output.pack(a)
    assert token_output.unpack(words, offsets, len(a)).tolist() == values
    assert len(offsets) == -(-len(a) // token_output.BLOCK)


def test_packing_uses_few_words():
    assert len(token_output.pack(np.zeros(1280, np.uint64))[1]) <= 10 * 5
    assert len(token_output.pack(np.full(1280, 40_000, np.uint64))[1]) <= 1280 / 128 * 43


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_output_files(spark, sf, monkeypatch, size):
    monkeypatch.setattr(token_output, "SEGMENT", size)
    tokenizer = Tokenizer.from_file(WORDS_PATH)
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    found = {r["doc_id"]: r for r in registry.op8_token_output(spark, sf).collect()}
    start = 0
    for k, t in docs:
        want = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (found[k]["start"], found[k]["n_tokens"], found[k]["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert len(found) == len(docs)


def test_words_are_the_librarys_words():
    tokenizer = Tokenizer.from_file(WORDS_PATH)
    encode = token_output._tokenizer(WORDS_PATH)
    texts = [*(t or "" for t in TEXTS), "Éclair ÀÉÎ ñandú ß ŒUVRE", "a\x1cb\x85c d", "é", "e\u0301 É", "!!'s x'd", "日本語とEnglish", "x² ½ ª º", "", "a", "İi ı"]
    for found, t in zip(encode(texts), texts):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert encode([]) == [] and encode([""]) == [b""] and encode(["日本"]) == [encode(["x", "日本"])[1]]


def test_latin_points_are_the_librarys():
    tokenizer, encode = Tokenizer.from_file(WORDS_PATH), token_output._tokenizer(WORDS_PATH)
    points = [chr(c) for c in [*range(0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2030), *range(0x20A0, 0x20C1)]]
    texts = [f"a{c}b {c} {c}{c}1 x{c}." for c in points]
    for found, t in zip(encode(texts), texts):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_output_of_odd_rows(spark):
    df = spark.createDataFrame([(5, None), (2, "b"), (2, "a"), (None, "none"), (9, "")], "doc_id long, text string").withColumn("start", F.lit(1))
    files = checkpointed(token_output.write(df, "doc_id", "text", fresh_dir(spark, "t"), WORDS_PATH, 2))
    rows = sorted(token_output.read(token_output.with_starts(files)).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in rows] == [None, 2, 2, 5, 9] and [r["n_tokens"] for r in rows][3:] == [1, 1]
    with pytest.raises(TypeError):
        token_output.write(df.withColumn("doc_id", F.lit("a")), "doc_id", "text", fresh_dir(spark, "t"), WORDS_PATH, 2)
    empty = checkpointed(token_output.write(df.limit(0), "doc_id", "text", fresh_dir(spark, "t"), WORDS_PATH, 2))
    assert token_output.read(token_output.with_starts(empty)).count() == 0


def test_damaged_file_is_refused():
    import io

    data = token_output.segment([1], [np.array([1, 2, 3], "<u4").tobytes()])
    assert next(token_output.segments(io.BytesIO(data)))[2].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        list(token_output.segments(io.BytesIO(data[:-3])))


def test_a_key_on_many_rows_is_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(token_output, "HOT", 10)
    rows = [(1, "one word")] + [(7, f"text number {i}") for i in range(300)] + [(None, f"no key {i}") for i in range(50)] + [(9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_output.write(df, "doc_id", "text", fresh_dir(spark, "hot"), WORDS_PATH, 2, 4)
    files = checkpointed(files)
    assert files.count() == 4 and max(r["docs"] for r in files.collect()) < 200
    found = sorted(token_output.read(token_output.with_starts(files)).collect(), key=lambda r: r["start"])
    keys = [r["key"] for r in found]
    assert keys == [None] * 50 + [1] + [7] * 300 + [9] and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
