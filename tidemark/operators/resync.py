"""Skill mentions kept in step with postings: only what changed is read again.

State and mentions are tables bucketed and sorted by posting.  A batch is dealt
into the same buckets, so it meets the state without moving the state; what a
posting holds is compared by digest.  Postings that are new or changed are
extracted, those that vanished from the batch's scope lose their mentions, and
all other mentions are kept as they are.  A run that begins again with the same
batch finds nothing changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import skill_mentions
from tidemark.sources.store import fresh_table

MENTIONS = ("posting_id", "skill", "category", "requirement_type", "evidence_text", "confidence", "match_reason", "confirmed")


def digest(*parts: str) -> Column:
    """What a posting says; null and empty parts differ."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def stored(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` as a table bucketed and sorted by key, in the shared folder, under a name of its own."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", fresh_table(spark, name)).saveAsTable(table)
    return spark.table(table)


def changes(state: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """(posting_id, change) of a whole batch (posting_id, digest) against the state: new, changed, gone; the unchanged are left out."""
    now = batch.select("posting_id", F.col("digest").alias("now")).repartition(buckets, "posting_id")
    was = state.select("posting_id", F.col("digest").alias("was"))
    met = was.join(now.hint("shuffle_merge"), "posting_id", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return met.select("posting_id", change.alias("change")).filter("change is not null")


def resynced(spark: SparkSession, state: DataFrame, mentions: DataFrame, batch: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The state, the mentions and the changes after a batch (posting_id, title, body)."""
    batch = batch.withColumn("digest", digest("title", "body"))
    moved = stored(changes(state, batch, buckets), "posting_id", buckets, "changes")
    again = batch.join(moved.filter("change <> 'gone'"), "posting_id", "left_semi")
    fresh = skill_mentions.extract(again, "posting_id", "title", None, "body").select(*MENTIONS)
    kept = mentions.select(*MENTIONS).join(moved.select("posting_id"), "posting_id", "left_anti")
    return stored(batch.select("posting_id", "digest"), "posting_id", buckets, "state"), stored(kept.unionByName(fresh), "posting_id", buckets, "mentions"), moved
