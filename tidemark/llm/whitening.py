"""Whitening of vectors with Spark MLlib's BlockMatrix.

Components become whole numbers, whose sums are exact; rows get a running number,
are centred on the exact means and become a BlockMatrix.  Its transpose times
itself is the scatter matrix; the middle dimension is cut, so that no task holds
more than ``TOGETHER`` blocks.  The scatter matrix (dimensions squared, the one
thing that goes to the driver) is decomposed there, and the BlockMatrix times
the whitening matrix projects all rows.

Vectors that are null or hold null or non-finite components go; a missing id
stays a row, and rows with equal ids are rows of their own.  Shorter vectors count
as followed by zeros.  A component without variance (one row, equal rows, fewer
varying dimensions than components) has no scale: ``whitened`` is null there,
``explained`` is zero or, where nothing varies, null, and ``identity_error``
covers the other components (null if none).  A deviation that does not fit a long
is null.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.llm.vector_blocks import usable, whole

#: Bytes of a block, and blocks of each side that a task of the scatter product holds.
BLOCK_BYTES = 1 << 20
TOGETHER = 8
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``index`` 0, 1, 2, ...: places within partitions, moved on by the sizes of the partitions before (one row each on the driver)."""
    placed = checkpointed(rows.withColumn("place", F.monotonically_increasing_id()))
    sizes = sorted(placed.groupBy(F.shiftright("place", 33).alias("p")).count().collect())
    starts = np.cumsum([0] + [r["count"] for r in sizes])
    before = placed.sparkSession.createDataFrame([(r["p"], int(s)) for r, s in zip(sizes, starts)], "p long, start long")
    place = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("p", F.shiftright("place", 33)).join(F.broadcast(before), "p").withColumn("index", place + F.col("start")).drop("p", "place", "start")


def scatter(m: BlockMatrix, blocks: int) -> np.ndarray:
    """Transpose times itself, with the middle dimension cut; the wrapper's method does not take the number of cuts, the JVM's does."""
    splits = max(1, -(-blocks // TOGETHER))
    return BlockMatrix(m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits), m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = 100_000, components: int = 8) -> DataFrame:
    """A row per vector and component, see ``OUT``."""
    spark = table.sparkSession
    rows = table.filter(usable(vector)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(whole(vector, scale), lambda c: c + shift).alias("x"))
    got = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    n, dim = got[0], max(1, got[1] or 0)
    if not n:
        return spark.createDataFrame([], OUT)
    rows = numbered(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dim) - F.size("x")))))
    sums = [0] * dim
    for r in rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["i"]] = int(r["s"])
    means = F.array(*[F.lit(s / n) for s in sums])
    rows = rows.withColumn("c", F.zip_with("x", means, lambda a, m: a.cast("double") - m))

    per_block = max(1, BLOCK_BYTES // (8 * dim))
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("c").alias("vector")), "vector")
    x = IndexedRowMatrix(indexed, n, dim).toBlockMatrix(per_block, dim)
    v = scatter(x, -(-n // per_block)) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace, k = float(np.trace(v)), min(components, dim)
    real = values[:k] > max(trace, 0) * dim * np.finfo(float).eps
    w = np.where(real, vectors[:, :k] / np.sqrt(np.where(real, values[:k], 1)), 0)
    projection = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dim, k, w.T.ravel()))], 1), dim, k)
    projected = callMLlibFunc("getIndexedRows", x.multiply(projection).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    y = checkpointed(projected.select("index", vector_to_array("vector").alias("y")))

    kept = [i for i in range(k) if real[i]]
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    error = None
    if pairs:
        cov = y.agg(*[F.covar_pop(F.col("y")[i], F.col("y")[j]) for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))
    exact = F.array(*[F.lit(v if abs(v) < 1 << 63 else None).cast("long") for v in sums])
    squares = F.zip_with("x", exact, lambda a, b: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), b))
    out = rows.select("index", "vec_id", F.aggregate(squares, F.lit(0).cast("long"), lambda t, q: F.try_add(t, F.try_multiply(q, q))).alias("deviation"))
    stated = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(bool(real[i])).alias("real"), F.lit(float(values[i] / trace) if trace > 0 else None).cast("double").alias("explained")) for i in range(k)])
    return (
        out.join(y, "index").select("vec_id", "deviation", "y", F.explode(stated).alias("e"))
        .select("vec_id", F.col("e.component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("e.real"), F.col("y")[F.col("e.component") - 1]).alias("whitened"), F.col("e.explained"), F.lit(error).cast("double").alias("identity_error"))
    )
