"""Exact top-k by aggregation of sorted lists without random access.

A block holds, for each dimension, its rows sorted by that component.  For a
query the lists are read in step, from the high end where its component is
positive and from the low end where it is negative.  After each step a row's
score lies between what was read of it plus the worst, and plus the best, that
its unread components can be: the ends and the fronts of the lists.  Rows whose
upper bound is under the k-th best lower bound cannot qualify.  Reading stops
when so few rows are left that their final scores are resolved from their
vectors, or at the lists' end, where both bounds are the score.

Blocks are searched apart and their best rows merged by rank.  The k-th best
score inside a query's own block bounds its result from below; it goes with the
query to all other blocks, which hand on only rows that reach it.

Reading is done for many queries at once: what a step reads of the lists is a
matrix with zeros elsewhere, so sums and bounds are matrix products.  They are
exact: whole numbers below 2^53 as doubles, otherwise 64-bit integers.

Rows with a null id or vector, or with a null or non-finite component, take no
part.  Shorter vectors count as followed by zeros; ties go to the smaller id.
Rows with equal ids are rows of their own: a query's copy is a candidate, and two
queries of one id each give their rows.  An empty table gives no rows.  Inner
products beyond 2^62 are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vector_blocks as V
from tidemark.llm.common import checkpointed

#: Steps in which a list is read, and queries that are read for at once.
STEPS = 8
TOGETHER = 64
#: Reading stops at this many open rows a wanted one.
OPEN = 16


def with_lists(blocks: DataFrame, shape: V.Shape) -> DataFrame:
    """Blocks with their sorted lists: per dimension the rows' places by rising component."""

    def add(batches):
        for b in batches:
            lists = [np.argsort(V.Block(b, i, shape).vecs, axis=0, kind="stable").T.astype("<i4").tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.binary())], names=[*b.schema.names, "lists"])

    return blocks.mapInArrow(add, V.BLOCKS + ", lists binary")


class Lists:
    """The sorted lists of a block, read step by step."""

    def __init__(self, block: V.Block, lists: bytes, number: type):
        self.key, self.n, self.vecs = block.key, len(block.ids), block.vecs
        self.order = np.frombuffer(lists, "<i4").reshape(block.vecs.shape[1], -1)
        self.values = np.take_along_axis(block.vecs.T, self.order, axis=1).astype(number)

    def read(self, at: int, end: int, seen: np.ndarray) -> np.ndarray:
        """The components at places [at, end) of every list, by row and dimension, zero elsewhere; marks them as seen."""
        found = np.zeros((self.n, len(self.order)), self.values.dtype)
        places, dims = self.order[:, at:end], np.arange(len(self.order))[:, None]
        found[places, dims] = self.values[:, at:end]
        seen[places, dims] = 1
        return found

    def top(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        """Rows of queries, places and scores of each query's k best rows that reach its floor."""
        number = self.values.dtype
        up, down = np.maximum(q, 0).astype(number), np.minimum(q, 0).astype(number)
        read = np.zeros((len(q), self.n), number)
        high, low = np.zeros((2, self.n, q.shape[1]), number)
        worst_up, worst_down = up * self.values[:, 0], down * self.values[:, -1]
        open_, step = np.arange(len(q)), -(-self.n // STEPS)
        for at in range(0, self.n, step):
            end = min(self.n, at + step)
            read += up @ self.read(self.n - end, self.n - at, high).T + down @ self.read(at, end, low).T
            best_up, best_down = up * self.values[:, self.n - end], down * self.values[:, end - 1]
            unread = lambda a, b: (a.sum(1) + b.sum(1))[:, None] - a @ high.T - b @ low.T
            upper, lower = read + unread(best_up, best_down), read + unread(worst_up, worst_down)
            mine = np.flatnonzero(own[open_] >= 0)
            upper[mine, own[open_[mine]]] = lower[mine, own[open_[mine]]] = V.LOW
            bar = floor[open_].astype(number)
            if self.n > k:
                bar = np.maximum(bar, np.partition(lower, self.n - k, axis=1)[:, self.n - k])
            qualify = (upper >= bar[:, None]) & (upper > V.LOW)
            done = (qualify.sum(1) <= OPEN * k) | (end == self.n)
            for i in np.flatnonzero(done):
                places = np.flatnonzero(qualify[i])
                scores = self.vecs[places].astype(np.int64) @ q[open_[i]].astype(np.int64)
                order = np.lexsort((places, -scores))[:k]
                order = order[scores[order] >= floor[open_[i]]]
                yield open_[i], places[order], scores[order]
            if done.all():
                return
            left = ~done
            open_, read, up, down, worst_up, worst_down = open_[left], read[left], up[left], down[left], worst_up[left], worst_down[left]


def search(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k best other rows."""
    rows = table.filter(V.usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), V.whole(vector, scale).alias("x"))
    shape = V.Shape(rows)
    number = np.float64 if shape.dim * shape.largest**2 < 1 << 52 else np.int64
    if shape.dim * shape.largest**2 >= 1 << 62:
        raise ValueError("bounds of these vectors' inner products do not fit a long")
    blocks = checkpointed(with_lists(V.pack(rows, shape), shape))

    def floors(batches):
        """Each query's k-th best score in its own block, or less than any."""
        for b in batches:
            for i in range(b.num_rows):
                block = V.Block(b, i, shape)
                at = np.flatnonzero(block.ids % every == 0)
                lists, floor = Lists(block, b["lists"][i].as_py(), number), np.full(len(at), V.LOW)
                for s in range(0, len(at), TOGETHER):
                    own = at[s : s + TOGETHER]
                    for j, _, scores in lists.top(block.vecs[own], own, np.full(len(own), V.LOW), k):
                        if len(scores) == k:
                            floor[s + j] = scores[-1]
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(at), block.key)), "pos": pa.array(at.astype(np.int32)), "floor": pa.array(floor)})

    bars = blocks.mapInArrow(floors, "block long, pos int, floor long")
    queries = checkpointed(V.queries_of(blocks.drop("lists"), every, shape).join(bars.hint("merge"), ["block", "pos"]).withColumn("extra", F.array("floor")).drop("floor"))

    def found(batches):
        lists = None
        for b in batches:
            for i in range(b.num_rows):
                if lists is None or lists.key != b["block"][i].as_py():
                    block = V.Block(b, i, shape)
                    lists = Lists(block, b["lists"][i].as_py(), number)
                queries = V.Queries(b, i, shape)
                own = queries.own(block.key)
                for s in range(0, len(own), TOGETHER):
                    part = slice(s, s + TOGETHER)
                    hits = list(lists.top(queries.vecs[part], own[part], queries.extra[part, 0], k))
                    r = np.repeat([s + j for j, _, _ in hits], [len(p) for _, p, _ in hits]).astype(int)
                    if len(r):
                        places, scores = (np.concatenate([h[x] for h in hits]) for x in (1, 2))
                        yield pa.RecordBatch.from_pydict({"block": pa.array(queries.block[r]), "pos": pa.array(queries.pos[r]), "query_id": pa.array(queries.ids[r]), "vec_id": pa.array(block.ids[places]), "score": pa.array(scores)})

    near = V.meet(blocks, V.pack_queries(queries, queries.count())).mapInArrow(found, "block long, pos int, query_id long, vec_id long, score long")
    w = Window.partitionBy("block", "pos").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
