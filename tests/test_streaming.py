"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.streaming import pipeline


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_absence_closes_on_the_third(spark, tmp_path):
    runs = [(1, r, r in (1, 3), True) for r in range(1, 8)] + [(2, r, False, r != 2) for r in range(1, 5)] + [(3, 1, True, True), (3, 1, True, True)]
    for i, part in enumerate((runs[:6], runs[6:])):
        spark.createDataFrame(part, "posting_id long, run long, seen boolean, complete boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("posting_id long, run long, seen boolean, complete boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(pipeline.absence_stream(stream), "absence_out").collect()
    last = {r["posting_id"]: (r["status"], r["missing_runs"]) for r in sorted(got, key=lambda r: r["run"])}
    assert last == {1: ("closed", 3), 2: ("closed", 3), 3: ("open", 0)}
    state = spark.createDataFrame([(1, 10, "open", 0), (2, 10, "open", 0)], "posting_id long, source_id long, status string, missing_runs int")
    for r in range(1, 5):
        seen = spark.createDataFrame([(1,)] if r in (1, 3) else [(9,)], "posting_id long")
        state = ingest.absence(state, seen, spark.createDataFrame([(10, r != 2)], "source_id long, complete boolean"))
    assert {r["posting_id"]: r["missing_runs"] for r in state.collect()} == {1: 1, 2: 3}


def test_weeks_begin_on_monday(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    import os
    import shutil
    import tempfile

    folder = tempfile.mkdtemp()
    shutil.copy(f"{sf}/events.parquet", os.path.join(folder, "e.parquet"))
    stream = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(pipeline.weekly_demand(stream, "ts", "event_type"), "weeks_out", "complete").collect()
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp"))).alias("week"), F.col("event_type").alias("skill")).agg(F.count("*").alias("mentions")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}


def test_micro_batches_merge(spark, tmp_path):
    batch = "source_id long, external_id string, url string, title string, status string"
    spark.createDataFrame([(1, "a", "u1", "t", "open"), (1, "b", "u2", "t", "open")], batch).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    state = spark.createDataFrame([(1, "a", "u1", "old", "closed"), (2, "c", "u2", "old", "open")], batch).withColumn("first_seen_at", F.timestamp_seconds(F.lit(0))).withColumn("last_seen_at", F.timestamp_seconds(F.lit(0))).withColumn("missing_runs", F.lit(2))
    stream = spark.readStream.schema(batch).parquet(f"{tmp_path}/in/*")
    q = pipeline.merged(stream, lambda s, b: ingest.upsert(s, b, "2026-01-01"), lambda: state, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["source_id"], r["external_id"]): (r["action"], r["title"], r["missing_runs"]) for r in spark.read.parquet(f"{tmp_path}/out/0").collect()}
    assert got == {(1, "a"): ("update", "t", 0), (1, "b"): ("move", "t", 0)}
