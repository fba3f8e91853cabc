"""The corpus pipeline: each stage against what it says, the whole against brute force."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as pipeline
from tests.llm.test_documents import brute_classes, brute_hits


def test_stages_and_run(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passed = {r["doc_id"] for r in kept["quality"]}
    long = {k for k, t in before.items() if len((t or "").split()) >= 50}
    assert passed <= long and {k for k in long if labels.get(k) == 1} <= passed | {k for k in long if re.search(r"\b(\S+ \S+ \S+) .*\1", before[k] or "", re.S)}
    assert not {k for k in passed if labels.get(k) == 0}
    deduped = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert set(deduped) == passed and all(set(t.split("\n")) <= {*before[k].split("\n"), ""} for k, t in deduped.items())
    firsts = {least for _, k, least, _ in brute_classes(sorted(deduped.items()))}
    assert {r["doc_id"] for r in kept["near_dedup"]} == firsts
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {k for k in firsts if not brute_hits(deduped[k], items)[1]}
    assert {r["doc_id"] for r in kept["decontaminate"]} == clean
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(k, np.array(enc.encode_ordinary(deduped[k]), "<u4").tobytes(), hashlib.sha256(deduped[k].encode()).hexdigest()) for k in clean}
    assert {(r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in kept["tokenise"]} == want
    assert {(r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in pipeline.run(spark, sf).collect()} == want


def test_odd_rows_go_through(spark, sf):
    """Nulls, empty and repeated rows, and an empty table, in every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf int"
    text = "different words in a row that follow one another " * 12
    rows = [(1, None, None, None, None, 1), (None, text, "en", None, 5, 1), (2, "", "en", "s", 0, 1), (3, text, "en", "s", 9, 1), (3, text, "en", "s", 9, 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count() and (name == "tokenise" or out.columns == pipeline.COLUMNS)
