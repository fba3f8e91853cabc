"""Whole-number vectors in blocks, for searches that hold a stated query set against all rows.

Rows are packed where they lie: a block is one row with the ids, labels and
components of at most ``BLOCK_BYTES`` of vectors, ordered by id.  A row is known
by its block and its place there, so rows with equal ids stay rows of their own.
Query rows are packed the same way, and every group of blocks meets every query
block once, by an equality of group numbers.

A vector that is null or holds a null or non-finite component takes no part,
and neither does a row without an id, which no result could name.  Shorter
vectors count as followed by zeros.  Only the named columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of components in a block of rows, and rows in a block of queries.
BLOCK_BYTES = 2 << 20
QUERY_ROWS = 1024
#: Scores that a task holds at once.
CELLS = 2 << 20
#: Below every score.
LOW = -(1 << 62)
BLOCKS = "block long, size int, ids binary, labels binary, vecs binary"
QUERIES = "q_size int, q_block binary, q_pos binary, q_ids binary, q_labels binary, q_vecs binary, q_extra binary"


def usable(vector: str) -> Column:
    """Neither null nor with null or non-finite components."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


class Shape:
    """What one aggregation says of all vectors: their dimension, the size of components and of products."""

    def __init__(self, rows: DataFrame):
        least, most = F.array_min("x").cast("double"), F.array_max("x").cast("double")
        norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        got = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.greatest(most, -least)), F.max(norm)).first()
        self.rows, self.dim, largest, square = got[0], max(1, got[1] or 0), got[2] or 0.0, got[3] or 0.0
        self.largest = int(largest) + 1
        #: No inner product of two vectors is larger (Cauchy and Schwarz); the factor covers the rounding of the sum.
        self.bound = int(square * (1 + 1e-9)) + 1
        if self.bound >= 1 << 62:
            raise ValueError("inner products of these vectors do not fit a long")
        self.dtype = next(t for t, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if self.largest < 1 << bits)


def matrix(column: pa.Array, dim: int, dtype: str) -> np.ndarray:
    """A list column as rows of ``dim`` numbers, shorter lists followed by zeros."""
    n = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dim), dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(column.flatten())
    return out


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of ``rows`` rows, the last one smaller."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, rows - n))
            n += held[-1].num_rows
            b = b.slice(held[-1].num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def pack(rows: DataFrame, shape: Shape) -> DataFrame:
    """Blocks of the rows (id, label, x).  Block numbers are the task's and a count, so fix them by a checkpoint before rows are named by them."""
    dim, dtype = shape.dim, shape.dtype
    most = max(1, BLOCK_BYTES // (dim * np.dtype(dtype).itemsize))

    def blocks(batches):
        part = TaskContext.get().partitionId()
        for at, t in enumerate(gathered(batches, most)):
            t = t.sort_by([("id", "ascending")]).combine_chunks()
            m = np.concatenate([matrix(c, dim, dtype) for c in t["x"].chunks])
            ids, labels = (t[c].to_numpy().astype(d) for c, d in (("id", "<i8"), ("label", "<i8")))
            yield pa.RecordBatch.from_pydict({"block": [part << 28 | at], "size": pa.array([len(m)], pa.int32()), "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vecs": [m.tobytes()]})

    return rows.mapInArrow(blocks, BLOCKS)


def queries_of(blocks: DataFrame, every: int, shape: Shape) -> DataFrame:
    """The rows (block, pos, id, label, vec) whose id is divisible by ``every``."""
    width = shape.dim * np.dtype(shape.dtype).itemsize

    def find(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b["ids"][i].as_py(), "<i8")
                at = np.flatnonzero(ids % every == 0)
                vecs = b["vecs"][i].as_py()
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(at), b["block"][i].as_py())), "pos": pa.array(at.astype(np.int32)), "id": pa.array(ids[at]),
                    "label": pa.array(np.frombuffer(b["labels"][i].as_py(), "<i8")[at]), "vec": pa.array([vecs[p * width : (p + 1) * width] for p in at], pa.binary()),
                })

    return blocks.mapInArrow(find, "block long, pos int, id long, label long, vec binary")


def pack_queries(rows: DataFrame, n: int) -> DataFrame:
    """Blocks of about n query rows (block, pos, id, label, vec, extra: a list of longs of one length)."""

    def blocks(batches):
        for t in gathered(batches, QUERY_ROWS):
            flat = lambda name, d: t[name].to_numpy().astype(d).tobytes()
            extra = np.concatenate([np.asarray(c.flatten()) for c in t["extra"].chunks]).astype("<i8")
            yield pa.RecordBatch.from_pydict({
                "q_size": pa.array([t.num_rows], pa.int32()), "q_block": [flat("block", "<i8")], "q_pos": [flat("pos", "<i4")], "q_ids": [flat("id", "<i8")],
                "q_labels": [flat("label", "<i8")], "q_vecs": [b"".join(t["vec"].to_pylist())], "q_extra": [extra.tobytes()],
            })

    return rows.repartition(max(1, math.ceil(n / QUERY_ROWS)), "block", "pos").mapInArrow(blocks, QUERIES)


def meet(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block with every query block: blocks are dealt to groups, and a query block goes to each group once.

    Both sides are shuffled, at any size: what the optimizer takes a side of packed
    rows for has nothing to do with its bytes, and the copies of the queries would
    go through the driver.
    """
    groups = 2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = blocks.withColumn("g", F.pmod(F.shiftright("block", 28) + F.col("block").bitwiseAND((1 << 28) - 1), F.lit(groups)))
    return left.join(queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))).hint("merge"), "g")


class Block:
    """A row of blocks as arrays."""

    def __init__(self, b: pa.RecordBatch, i: int, shape: Shape):
        self.key = b["block"][i].as_py()
        self.ids, self.labels = (np.frombuffer(b[c][i].as_py(), "<i8") for c in ("ids", "labels"))
        self.vecs = np.frombuffer(b["vecs"][i].as_py(), shape.dtype).reshape(len(self.ids), shape.dim)


class Queries:
    """A row of query blocks as arrays; ``own(key)`` is each query's place in that block, or -1."""

    def __init__(self, b: pa.RecordBatch, i: int, shape: Shape):
        self.block, self.ids, self.labels = (np.frombuffer(b[c][i].as_py(), "<i8") for c in ("q_block", "q_ids", "q_labels"))
        self.pos = np.frombuffer(b["q_pos"][i].as_py(), "<i4")
        self.vecs = np.frombuffer(b["q_vecs"][i].as_py(), shape.dtype).reshape(len(self.ids), shape.dim)
        self.extra = np.frombuffer(b["q_extra"][i].as_py(), "<i8").reshape(len(self.ids), -1)

    def own(self, key: int) -> np.ndarray:
        return np.where(self.block == key, self.pos, -1)


def over_pairs(pairs: DataFrame, shape: Shape, found: Callable[[Block, Queries], Iterator[dict]], schema: str) -> DataFrame:
    """The rows that ``found`` gives, as columns of arrays, for each pair of blocks."""

    def run(batches):
        block = None
        for b in batches:
            for i in range(b.num_rows):
                if block is None or block.key != b["block"][i].as_py():
                    block = Block(b, i, shape)
                for columns in found(block, Queries(b, i, shape)):
                    yield pa.RecordBatch.from_pydict(columns)

    return pairs.mapInArrow(run, schema)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest allowed scores, ties to the lower column."""
    s = np.where(allowed, scores, LOW)
    if s.shape[1] > k:
        allowed = allowed & (s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], col[top]
