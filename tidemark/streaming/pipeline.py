"""Streams of sightings and postings: absence as keyed state, weekly demand with late data, merges per micro-batch.

The batch operators stay the definition of each result; these wrappers feed them
micro-batches or keep the same state per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ingest import MISSING_LIMIT

STATE = "status string, missing_runs int, last_run long"
OUTPUT = "posting_id long, run long, status string, missing_runs int"


def absence_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One posting's runs in order; a run that was seen before changes nothing."""
    status, missing, last = state.get if state.exists else ("open", 0, -1)
    out = []
    for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.run):
        if row.run <= last:
            continue
        last = row.run
        if row.complete and status != "closed":
            missing = 0 if row.seen else missing + 1
            if missing >= MISSING_LIMIT:
                status = "closed"
        out.append((key[0], int(row.run), status, int(missing)))
    state.update((status, int(missing), int(last)))
    yield pd.DataFrame(out, columns=["posting_id", "run", "status", "missing_runs"])


def absence_stream(sightings: DataFrame) -> DataFrame:
    """``sightings`` (posting_id, run, seen, complete; a stream or a table's changes) -> the posting's state after each run."""
    return sightings.groupBy("posting_id").applyInPandasWithState(absence_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def weekly_demand(events: DataFrame, at: str, skill: str, late: str = "30 days") -> DataFrame:
    """Mentions per skill and week; weeks begin on Monday (windows align to a Thursday, hence the offset); later data than ``late`` is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, "7 days", "7 days", "4 days").alias("w"), F.col(skill).alias("skill")).agg(F.count("*").alias("mentions")).select(F.to_date("w.start").alias("week"), "skill", "mentions")


def merged(stream: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Every micro-batch merged into a table: ``write(merge(read(), batch), batch_id)``; a batch that comes again must give the same table, so ``write`` goes by its id."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: write(merge(read(), batch), batch_id))


def new_rows(stream: DataFrame, key: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Rows whose key did not come within the watermark: revisions and notices that must not repeat."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
