"""Byte-level BPE: encode texts to ids by a rank file, decode ids to bytes.

Overlapping chunk encoding.  A text longer than ``chunk_chars`` is cut into
chunks that overlap by ``overlap_chars``; the chunks are pre-tokenised in
parallel.  Two neighbours meet at the first position in their overlap where
both have a pre-token boundary: the pattern looks at nothing before a match, so
from a common boundary on both see the same pre-tokens.  Neighbours without a
common boundary (a run of letters longer than the overlap) are joined and
treated as one piece.  The pieces are then encoded in parallel and their ids
concatenated.

Defined results: a null text is an empty text (no ids); rows with a null or
repeated key keep their row; other columns, whatever their names, are dropped
before the work, so names cannot clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, checkpointed, small

#: Characters before a chunk's end where boundaries aren't trusted; above the pattern's longest fixed string and lookahead.
MARGIN = 8


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    if not data:
        return []
    whole = ranks.get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(data[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[data[i : end[i]]])
        i = end[i]
    return ids


def pieces(ranks: dict[bytes, int]) -> Cache:
    """pre-token -> its ids as little-endian unsigned 32-bit integers."""
    return Cache(lambda piece: np.array(merge(piece.encode("utf-8"), ranks), "<u4").tobytes(), limit=100_000)


_loaded: dict = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _loaded:
        import regex

        _loaded[path, pattern] = regex.compile(pattern).findall, pieces(read_ranks(path)).__getitem__
    return _loaded[path, pattern]


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids of one text, packed."""
    split, ids = _encoder(path, pattern)
    return b"".join(map(ids, split(text)))


def boundaries(chunk: str, pattern: str) -> list[int]:
    """Where pre-tokens of a chunk begin.

    The last ``MARGIN`` characters are left out: there the cut may hide what the
    pattern would have matched (a contraction, a lookahead).
    """
    import regex

    found = {0}
    for m in regex.finditer(pattern, chunk):
        found.add(m.start())
        found.add(m.end())
    return sorted(x for x in found if x <= max(0, len(chunk) - MARGIN))


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str, chunk_chars: int = 32_768, overlap_chars: int = 512) -> DataFrame:
    """One row per row of ``df``: ``key``, ``ids`` (binary, little-endian u32) and ``n_tokens``."""
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    rows = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    short = rows.filter(F.length("t") <= chunk_chars)
    long = rows.filter(F.length("t") > chunk_chars)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids = _encoder(path, pattern)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(map(ids, split(t))) for t in b.column(1).to_pylist()], pa.binary())], ["k", "ids"])

    kind = dict(rows.dtypes)["k"]
    done = short.mapInArrow(whole, f"k {kind}, ids binary").union(_encode_long(long, kind, path, pattern, chunk_chars, overlap_chars))
    return done.select(F.col("k").alias(key), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def _encode_long(long: DataFrame, kind: str, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    cut = F.expr(f"transform(sequence(0, int((length(t) - 1) div {size})), i -> named_struct('i', i, 'c', substring(t, i * {size} + 1, {size + overlap})))")
    numbered = long.withColumn("row", F.monotonically_increasing_id())  # tells rows of one key apart
    chunks = numbered.select("k", "row", F.explode(cut).alias("p")).select("k", "row", "p.i", "p.c").repartition("row", "i")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            heads, tails = [], []
            for c in b.column("c").to_pylist():
                found = boundaries(c, pattern)
                heads.append([x for x in found if x < overlap])
                tails.append([x - size for x in found if x >= size])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("k", "row", "i", "c")), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["k", "row", "i", "c", "head", "tail"])

    # The rows' numbers must not change when a lost executor's part is computed again.
    seen = checkpointed(chunks.mapInArrow(edges, f"k {kind}, row long, i int, c string, head array<int>, tail array<int>"))
    by_text = Window.partitionBy("row").orderBy("i")
    met = seen.withColumn("start", F.when(F.col("i") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_text)))))
    met = met.withColumn("stop", F.lead("start").over(by_text)).withColumn("last", F.lead("i").over(by_text).isNull())
    met = met.withColumn("piece", F.count("start").over(by_text))
    # Own part of a chunk: from where it met the one before (else its start) to where it meets the next (else the next one's start).
    begin = F.coalesce("start", F.lit(0))
    until = F.when(F.col("last"), F.length("c")).otherwise(size + F.coalesce("stop", F.lit(0)))
    parts = met.withColumn("b", begin).withColumn("u", until).select("k", "row", "piece", "i", F.expr("substring(c, b + 1, u - b)").alias("s"))
    pieces = parts.groupBy("row", "piece").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("x"))
    pieces = pieces.select("k", "row", "piece", F.array_join(F.col("x.s"), "").alias("s")).repartition("row", "piece")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids = _encoder(path, pattern)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("k", "row", "piece")), pa.array([b"".join(map(ids, split(s))) for s in b.column("s").to_pylist()], pa.binary())], ["k", "row", "piece", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        return pa.table({"k": table.column("k").slice(0, 1), "ids": pa.array([b"".join(table.column("ids").to_pylist())], pa.binary())})

    return pieces.mapInArrow(each, f"k {kind}, row long, piece long, ids binary").groupBy("row").applyInArrow(joined, f"k {kind}, ids binary")


def decode(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """``df`` with the column ``out``: the raw bytes of the packed ids, concatenated.  Null ids: no bytes."""
    names = df.columns
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ("bytes", path) not in _loaded:
            ranks = read_ranks(path)
            table = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            _loaded["bytes", path] = table
        token = _loaded["bytes", path].__getitem__
        for b in small(batches):
            out_ = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out_, pa.binary())], [*names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` binary")
