"""Quality rules: hashed n-gram log-likelihood ratio, and base rules on words.

Two multinomials over hashed n-grams of characters are compared: one of trusted
target texts, one of the raw corpus.  Capitals count as their small letters and
digits as one.  A document's score is the sum of log p_target - log p_raw over
its n-grams, divided by their number.  Every document is kept or dropped by one
threshold on that score; nothing is drawn at random.

* An n-gram that neither side has speaks for nothing: the target is smoothed in
  proportion to its size.  One that only the raw corpus has, as letter soup has
  them, speaks against a text.
* Where ``group`` names a column (a language), each group weighs as much in the
  target as in the raw corpus, so a language that is rare among the trusted rows
  isn't judged by its letters.  A group without trusted rows has no such weight.
* Raw counts cover every document.
* Target texts: labelled rows with ``quality = 1``, at most ``sample_rows`` of
  them, those with the smallest hash of their id; the threshold is set on those of
  these that pass the base rules and as many with ``quality = 0``.  ``sample_rows`` is the one bound.
* Without trusted rows no ratio exists: the score is null and only the base
  rules decide.  Without rejected rows the threshold lies ``slack`` below the
  lowest trusted score.

Defined results: a null text has no words and fails the base rules; a text of
under n bytes has no n-gram and scores 0; rows with null or repeated keys are
judged by their own text; labels may repeat, and an id with both labels is
trusted; keys may have any type; very long texts are read whole.  The added
columns replace those of the same name, all others are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, checkpointed, flat_bytes, row_sums, small

N = 3
#: Weights are multiples of one part of this and summed as whole numbers, so a text's sum is the same whatever batch it is in.
UNIT = 1 << 32
#: Groups whose counts a task holds at once.
HELD = 64
#: Byte -> what counts for it: small letters for capitals, one digit for all.
FOLD = np.array([b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint32)
SPACE = np.zeros(256, np.int8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 1
SYMBOL = np.zeros(256, np.int8)
SYMBOL[list(b"#*$%&|<>")] = 1
#: First bytes of a UTF-8 sequence, that is code points.
POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int8)


def hashed_ngrams(flat: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that begins at each byte, and which of them lie within one text."""
    n = max(0, len(flat) - N + 1)
    folded, gram = FOLD[flat], np.zeros(n, np.uint32)
    for i in range(N):
        gram |= folded[i : i + n] << np.uint32(8 * i)
    mixed = gram * np.uint32(2654435761)
    inside = np.ones(n, bool)
    for i in range(1, N):
        over = offsets[1:] - i
        inside[over[(over >= 0) & (over < n)]] = False
    return ((mixed >> np.uint32(7)) % np.uint32(buckets)).astype(np.int32), inside


def base_words(data: bytes) -> tuple[int, int]:
    """Lines with a word equal to an earlier line; words in 3-word windows found twice or more."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    words = data.split()
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return len(lines) - len(set(lines)), 0
    often = {w for w, c in Counter(windows).items() if c > 1}
    covered = upto = 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return len(lines) - len(set(lines)), covered


def base_features(column: pa.Array) -> dict[str, np.ndarray]:
    flat, offsets = flat_bytes(column)
    space = SPACE[flat]
    begins = 1 - space
    begins[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = 1 - space[first]
    dup, repeat = zip(*(base_words(x or b"") for x in as_bytes(column).to_pylist())) if len(column) else ((), ())
    return {
        "n_words": row_sums(begins, offsets),
        "word_chars": row_sums(POINT[flat] & (1 - space), offsets),
        "n_symbols": row_sums(SYMBOL[flat], offsets),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": np.array(repeat, np.int64),
    }


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def labelled_sample(labels: DataFrame, key: str, quality: str, rows: int) -> DataFrame:
    """(k, label) of at most ``rows`` ids of either label, those with the smallest hash; an id with both labels is trusted.  At most twice ``rows`` rows."""
    ids = labels.filter(F.col(quality).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(quality).cast("int").alias("label"))
    one = [ids.filter(F.col("label") == v).orderBy(F.xxhash64("k"), "k").limit(rows) for v in (1, 0)]
    return checkpointed(one[0].unionByName(one[1]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", sample_rows: int = 20_000, buckets: int = 20_000, alpha: float = 1.0, slack: float = 0.1, min_words: int = 50, repeat_percent: int = 50, group: str | None = None) -> tuple[np.ndarray, float] | None:
    """Weights per bucket and the threshold; None without trusted rows."""
    sample = labelled_sample(labels, key, quality, sample_rows)
    if sample.filter("label = 1").isEmpty():
        return None
    sc = docs.sparkSession.sparkContext
    # The sample is bounded by ``sample_rows``, so its side of the join may be broadcast.
    kind = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), kind.alias("g")).join(F.broadcast(sample), "k", "left").select("label", "t", "g")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, (raw, target) in held.items():
                some = np.flatnonzero(raw)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["g", "b", "raw", "target"])
            held.clear()

        for b in small(batches, 100):
            flat, offsets = flat_bytes(b.column(1))
            at, inside = hashed_ngrams(flat, offsets, buckets)
            spread = lambda row: np.repeat(row, np.diff(offsets))[: len(inside)]
            names = b.column(2).to_numpy(zero_copy_only=False)
            is_target = inside & spread(b.column(0).fill_null(-1).to_numpy() == 1)
            for g in set(names):
                mine = spread(names == g)
                raw, target = held.setdefault(g, np.zeros((2, buckets), np.int64))
                raw += np.bincount(at[inside & mine], minlength=buckets)
                target += np.bincount(at[is_target & mine], minlength=buckets)
            if len(held) > HELD:
                yield from out()
        yield from out()

    counts = checkpointed(rows.mapInArrow(count, "g string, b int, raw long, target long").groupBy("g", "b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    # A group's weight is a whole number of 65536ths, so that sums are exact in any order.
    weight = F.when(F.sum("target") > 0, F.round(F.sum("raw") / F.sum("target") * 65536).cast("decimal(19,0)")).otherwise(0)
    balanced = counts.join(counts.groupBy("g").agg(weight.alias("w")), "g")
    # At most `buckets` rows come to the driver.
    found = balanced.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum(F.col("target").cast("decimal(19,0)") * F.col("w")).alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in found:
        raw[r["b"]], target[r["b"]] = r["raw"], float(r["target"] or 0) / 65536
    target += alpha * max(target.sum(), 1.0) / max(raw.sum(), 1.0)
    raw += alpha
    weights = np.rint((np.log(target / target.sum()) - np.log(raw / raw.sum())) * UNIT) / UNIT

    shared = sc.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 100):
            label, found = b.column(0).to_numpy(), base_features(b.column(1))
            # What the base rules reject teaches nothing about the score.
            failed = (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > repeat_percent * found["n_words"])
            llr = scores(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(label[~failed]), pa.array(llr[~failed])], ["label", "score"])

    # At most twice `sample_rows` rows (repeated ids aside) come to the driver, as one row per distinct score.
    seen = rows.filter("label is not null").mapInArrow(score, "label int, score double").groupBy("label", F.round("score", 6).alias("score")).count().collect()
    return weights, threshold(seen, slack)


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    flat, offsets = flat_bytes(texts)
    at, inside = hashed_ngrams(flat, offsets, len(weights))
    each = np.zeros(len(flat), np.int64)
    each[: len(at)] = np.where(inside, np.rint(weights * UNIT).astype(np.int64)[at], 0)
    n = np.maximum(np.diff(offsets) - N + 1, 0)
    return np.where(n > 0, row_sums(each, offsets) / UNIT / np.maximum(n, 1), 0.0)


def threshold(seen: list[Row], slack: float) -> float:
    """The cut that errs least, as a share of either label; of equal cuts the middle of the widest gap."""
    good = Counter({r["score"]: r["count"] for r in seen if r["label"] == 1})
    bad = Counter({r["score"]: r["count"] for r in seen if r["label"] == 0})
    if not good:
        return float("-inf")
    if not bad:
        return min(good) - slack
    values = sorted({*good, *bad})
    lost, passed = 0.0, 1.0
    cuts = [(lost + passed, 0.0, values[0] - slack)]
    for i, v in enumerate(values):
        lost += good[v] / good.total()
        passed -= bad[v] / bad.total()
        gap = values[i + 1] - v if i + 1 < len(values) else slack
        cuts.append((round(lost + passed, 9), -gap, v + gap / 2))
    return min(cuts)[2]


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", min_words: int = 50, repeat_percent: int = 50, **fitting) -> DataFrame:
    """``docs`` with the base columns, ``base_failed``, ``llr`` and ``kept`` (clashing names are replaced)."""
    model = fit(docs, labels, key, text, quality, min_words=min_words, repeat_percent=repeat_percent, **fitting)
    cut = model[1] if model else None
    weights = docs.sparkSession.sparkContext.broadcast(model[0]) if model else None
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]
    rows = docs.drop(*added, "base_failed", "kept")
    names = rows.columns
    fields = "".join(f"`{n}` {t}, " for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 100):
            texts = b.column(names.index(text))
            found = base_features(texts)
            llr = pa.array(scores(texts, weights.value)) if weights else pa.nulls(b.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[n]) for n in added[:-1]), llr], [*names, *added])

    out = rows.mapInArrow(run, f"{fields}{BASE}, llr double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    verdict = F.col("llr") >= F.lit(cut) if model else F.lit(True)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)
