"""What several operators share: the shared folder, checkpoints, Arrow helpers."""

from __future__ import annotations

import contextlib
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and driver and executors are one process, a temporary folder is made and used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    existing = sc._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, as a URI that pyarrow reads too."""
    folder = shared_dir(spark).rstrip("/")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file://" + folder.removeprefix("file:")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed now and cut from its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches to Python of at most ``rows`` rows: 10,000 whole texts at once would fill the memory beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def as_bytes(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a string column, without a copy; nulls stay."""
    return column.cast(pa.binary())


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [offsets[i], offsets[i+1])."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def small(batches: Iterable[pa.RecordBatch], rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` and, but for single rows, ``size`` bytes: bounds what a worker holds as Python objects at once."""
    for b in batches:
        parts = [b.slice(at, rows) for at in range(0, b.num_rows, rows)][::-1]
        while parts:
            part = parts.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def chunks(items: Iterable, n: int) -> Iterator[list]:
    """The items in lists of at most ``n``."""
    items = iter(items)
    while part := list(itertools.islice(items, n)):
        yield part


class Cache(dict):
    """``compute(key)`` for every key asked for, remembered in two generations of at most ``limit`` keys each.

    A full generation becomes the old one; what is asked for again moves to the
    new one, so frequent keys stay and memory is bounded.
    """

    def __init__(self, compute, limit: int = 60_000, longest: int = 48):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@contextlib.contextmanager
def undisturbed() -> Iterator[None]:
    """No search for reference cycles within, and none later among what it made: for code that makes many objects and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()
