"""Hard negatives by exact scores from a residue number system.

Inner products of whole-number vectors are computed modulo several small
primes: components become residues in the middle of zero, float32 matrix
products of up to ``CHUNK`` dimensions stay below 2^24 and so are exact, and the
signed score is rebuilt from its residues by Chinese remaindering in mixed
radix.  As many primes are taken as the largest possible score needs.

Two passes over pairs of blocks: the first gives each anchor its best rows of the
same label, the second the best rows of another label inside the window that
each positive's score opens.  Every pair of blocks hands on at most k rows a
window, and a rank over the windows of all blocks selects.

Rows with a null id, label or vector, or with a null or non-finite component,
take no part.  Shorter vectors count as followed by zeros.  Rows with equal ids
are rows of their own: an anchor's copy can be its positive, and two anchors of
one id each give their rows.  Ties go to the smaller id.  An empty table, a label
of one row, or empty windows (all those of a negative positive score) give no
rows.  Inner products beyond 2^62 are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vector_blocks as V
from tidemark.llm.common import checkpointed

#: Dimensions in one float32 product; 64 * 511^2 < 2^24, so residues of primes below 1024 stay exact.
CHUNK = 64
PRIMES = [p for p in range(1023, 500, -1) if all(p % q for q in range(2, 32))]


def basis(bound: int) -> list[int]:
    """Primes whose product exceeds twice the bound, so that signed scores up to it are told apart."""
    found, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        found.append(p)
        product *= p
    return found


def centred(r: np.ndarray, p: int) -> np.ndarray:
    """Congruent numbers of at most half of p in size; exact for whole float32 below 2^24."""
    return r - p * np.rint(r / np.float32(p))


def residues(m: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    m = m.astype(np.int64)
    return [centred((m % p).astype(np.float32), np.float32(p)) for p in primes]


def product(a: list[np.ndarray], c: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed inner products of all rows of two matrices, given as residues."""
    score, radix = np.zeros((len(a[0]), len(c[0])), np.int64), 1
    for ap, cp, p in zip(a, c, primes):
        r = np.zeros(score.shape, np.float32)
        for at in range(0, ap.shape[1], CHUNK):
            r = centred(r + centred(ap[:, at : at + CHUNK] @ cp[:, at : at + CHUNK].T, np.float32(p)), np.float32(p))
        digit = (r.astype(np.int64) - score) % p * pow(radix, -1, p) % p
        digit[digit > p // 2] -= p
        score += digit * radix
        radix *= p
    return score


def slices(block: V.Block, queries: V.Queries, primes: list[int], memo: dict):
    """Scores of a block against slices of the queries: at, end, scores, and which rows are not the query's own."""
    if memo.get("key") != block.key:
        memo.update(key=block.key, residues=residues(block.vecs, primes))
    own, n, step = queries.own(block.key), len(queries.ids), max(1, V.CELLS // len(block.ids))
    for at in range(0, n, step):
        end = min(n, at + step)
        yield at, end, product(residues(queries.vecs[at:end], primes), memo["residues"], primes), np.arange(len(block.ids)) != own[at:end, None]


def mine(
    table: DataFrame, label: Column, id_col: str = "vec_id", vector: str = "embedding", label_col: str = "label", scale: int = 256, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; ``label`` gives the
    label to use.  A negative's score lies between low and high percent of the positive's.
    """
    rows = table.filter(V.usable(vector) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), V.whole(vector, scale).alias("x"))
    shape = V.Shape(rows)
    primes = basis(shape.bound)
    blocks = checkpointed(V.pack(rows, shape))
    anchors = checkpointed(V.queries_of(blocks, every, shape))
    n = anchors.count()

    def same_label(block, queries):
        for at, end, s, other in slices(block, queries, primes, memo_a):
            r, c = V.best(s, other & (queries.labels[at:end, None] == block.labels), positives)
            yield {"block": pa.array(queries.block[at:end][r]), "pos": pa.array(queries.pos[at:end][r]), "positive_id": pa.array(block.ids[c]), "positive_score": pa.array(s[r, c])}

    memo_a, memo_b = {}, {}
    near = V.over_pairs(V.meet(blocks, V.pack_queries(anchors.withColumn("extra", F.array().cast("array<long>")), n)), shape, same_label, "block long, pos int, positive_id long, positive_score long")
    ranked = near.withColumn("slot", F.row_number().over(Window.partitionBy("block", "pos").orderBy(F.desc("positive_score"), "positive_id"))).filter(F.col("slot") <= positives)
    chosen = ranked.groupBy("block", "pos").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score", "positive_id"))).alias("p"))
    pad = lambda name, filler: F.concat(F.transform("p", lambda s: s[name]), F.array_repeat(F.lit(filler).cast("long"), positives - F.size("p")))
    windows = checkpointed(anchors.join(chosen.hint("merge"), ["block", "pos"]).withColumn("extra", F.concat(pad("positive_score", V.LOW), pad("positive_id", 0))).drop("p"))

    def in_window(block, queries):
        for at, end, s, _ in slices(block, queries, primes, memo_b):
            differs = queries.labels[at:end, None] != block.labels
            for j in range(positives):
                score, chosen_id = queries.extra[at:end, j], queries.extra[at:end, positives + j]
                least, most = -(-low * score // 100), high * score // 100
                r, c = V.best(s, differs & (s >= least[:, None]) & (s <= most[:, None]) & (score != V.LOW)[:, None], negatives)
                yield {
                    "block": pa.array(queries.block[at:end][r]), "pos": pa.array(queries.pos[at:end][r]), "slot": pa.array(np.full(len(r), j, np.int32)), "anchor_id": pa.array(queries.ids[at:end][r]),
                    "positive_id": pa.array(chosen_id[r]), "negative_id": pa.array(block.ids[c]), "positive_score": pa.array(score[r]), "negative_score": pa.array(s[r, c]),
                }

    schema = "block long, pos int, slot int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    hard = V.over_pairs(V.meet(blocks, V.pack_queries(windows, n)), shape, in_window, schema)
    w = Window.partitionBy("block", "pos", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return hard.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
