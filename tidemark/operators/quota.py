"""Quotas of lookups per client, in windows that begin at a client's first request after the last one ended."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LOOKUPS, WINDOW_SECONDS = 240, 60


def consumed(requests: DataFrame, client: str, at: str, order: str, lookups: str, most: int = MAX_LOOKUPS, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``requests`` with ``allowed`` and ``retry_after`` (whole seconds to the window's end, at least 1, where denied).

    A window opens at the first request at or after the end of the client's last
    one, also if that request is denied.  A request is allowed if its lookups fit
    into what the window has left, and only then counts.  Requests without a client
    are always allowed, and null lookups are none.  Whether one fits depends on those before it, so requests
    are dealt by client, sorted by time in their partition and folded as they
    stream by: a task holds one client's counter and never a client's rows, however many.
    """
    unnamed = requests.filter(F.col(client).isNull()).withColumns({"allowed": F.lit(True), "retry_after": F.lit(0).cast("long")})
    named = requests.filter(F.col(client).isNotNull()).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    columns = named.columns
    dealt = named.repartition(client).sortWithinPartitions(client, "_at", order)
    fields = "".join(f"`{n}` {t}, " for n, t in requests.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, ends, used = None, 0, 0
        for b in batches:
            allowed, retry = [], []
            for c, t, n in zip(*(b.column(columns.index(x)).to_pylist() for x in (client, "_at", lookups))):
                n = n or 0
                if c != who or t >= ends:
                    who, ends, used = c, t + seconds * 1_000_000, 0
                fits = used + n <= most
                used += n if fits else 0
                allowed.append(fits)
                retry.append(0 if fits else max(1, -(-(ends - t) // 1_000_000)))
            kept = b.drop_columns(["_at"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(allowed, pa.bool_()), pa.array(retry, pa.int64())], [*kept.schema.names, "allowed", "retry_after"])

    return dealt.mapInArrow(fold, f"{fields}allowed boolean, retry_after long").unionByName(unnamed)
