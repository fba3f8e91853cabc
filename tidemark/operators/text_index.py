"""Full-text search by an inverted index kept as a table.

The table has a row per token, segment and block of documents: the block's
documents as distances from its first id, and the places of the token in each.
It is partitioned by a bucket of the token and sorted by token, so a search
reads the buckets of its tokens and, by the statistics of the files, little
else.  A batch of new or changed documents is appended as a segment; the newest
segment of a document is the one that counts, and a deletion is a segment
without text.  ``compacted`` rewrites what counts as one segment.

A search joins its tokens with the lists, puts the lists of a block side by side
and intersects them: documents that hold all tokens, or all of them in a row.
Lists are at most 2^``BLOCK_BITS`` documents long, so a token that every document holds
is many rows and never one.

Tokens are runs of letters, digits and ``_+#``, lower case.  Rows without an id
are left out; a null text has no tokens; a document that stands twice in a batch
counts with the tokens of both rows.  A search without tokens finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Ids that agree but for so many low bits share a block.
BLOCK_BITS = 12
IN_BLOCK = (1 << BLOCK_BITS) - 1
#: Blocks whose numbers agree but for so many low bits share a group: a file holds a bucket's lists of a group.
GROUP_BITS = 6
#: Documents whose places a task holds, and documents up to which every task may hold the superseded ones (a byte each).
PER_TASK, HELD_DOCS = 4096, 8_000_000
#: A document's place in its block stands above so many bits of a token's place.
PLACE_BITS = 40
TOKEN = r"(?U)[^\p{L}\p{N}_+#]+"
LISTS = "token string, block long, first long, ids array<int>, places array<array<int>>"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN), lambda t: t != "")


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def tasks(spark: SparkSession, docs: int) -> int:
    """Tasks that the lists of so many documents are dealt to: some ``PER_TASK`` documents' places each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs // PER_TASK))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows with a token and a block dealt by the token's bucket and the block's group, as they are grouped and written; both are worked out again where they arrive, and not moved."""
    by = {"bucket": bucket(F.col("token")), "grp": F.shiftright("block", GROUP_BITS)}
    return df.repartition(n, *by.values()).withColumns(by)


def lists(docs: DataFrame, key: str, text: str, n: int | None = None) -> DataFrame:
    """(bucket, token, block, first, ids, places) of documents: one shuffle, into ``n`` tasks or as many as the session says."""
    n = n or tasks(docs.sparkSession, 0)
    each = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.posexplode(tokens(F.col(text))).alias("place", "token"))
    entry = dealt(each.withColumn("block", F.shiftright("id", BLOCK_BITS)), n).groupBy("bucket", "grp", "token", "block", "id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    listed = entry.groupBy("bucket", "grp", "token", "block").agg(F.array_sort(F.collect_list(F.struct("id", "places"))).alias("e"), F.min("id").alias("first"))
    return listed.select("bucket", "token", "block", "first", F.transform("e", lambda x: (x["id"] - F.col("first")).cast("int")).alias("ids"), F.transform("e", lambda x: x["places"]).alias("places"))


def add(spark: SparkSession, path: str, segment: int, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
    """Appends a batch as a segment.  A segment that is written again replaces itself."""
    spec = f"segment={segment}"
    rows = lists(docs, key, text, tasks(spark, docs.count())).sortWithinPartitions("bucket", "token", "block")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists/{spec}")
    docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct().write.mode("overwrite").parquet(f"{path}/docs/{spec}")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lists, and the documents with their newest segment."""
    found = spark.read.schema(LISTS + ", segment int, bucket int").option("basePath", f"{path}/lists").parquet(f"{path}/lists")
    docs = spark.read.schema("id long, segment int").parquet(f"{path}/docs")
    return found, docs.groupBy("id").agg(F.max("segment").alias("segment"))


def superseded(docs: DataFrame) -> DataFrame:
    """(segment, block, gone): by place in its block whether a newer segment has the document; no row where none has."""
    held = docs.groupBy("id").agg(F.collect_set("segment").alias("s")).filter(F.size("s") > 1)
    each = held.select("id", F.explode(F.filter("s", lambda x: x < F.array_max("s"))).alias("segment"))
    gone = each.groupBy("segment", F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.collect_set(F.col("id").bitwiseAND(IN_BLOCK).cast("int")).alias("at"))
    return gone.select("segment", "block", F.transform(F.sequence(F.lit(0), F.lit(IN_BLOCK)), lambda i: F.array_contains("at", i)).alias("gone"))


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The lists of what counts of all segments.  Lists move whole, once; what is superseded is told by block, not by entry."""
    found, _ = read(spark, path)
    docs = spark.read.schema("id long, segment int").parquet(f"{path}/docs")
    n = docs.count()
    old = F.broadcast(superseded(docs)) if n <= HELD_DOCS else superseded(docs)
    at = F.transform("ids", lambda i: i + F.col("first").bitwiseAND(IN_BLOCK).cast("int"))
    each = found.join(old, ["segment", "block"], "left").select("token", "block", "gone", F.arrays_zip(at.alias("id"), F.col("places").alias("places")).alias("e"))
    live = each.withColumn("e", F.when(F.col("gone").isNull(), F.col("e")).otherwise(F.filter("e", lambda x: ~F.get("gone", x["id"])))).filter(F.size("e") > 0).drop("gone")
    listed = dealt(live, tasks(spark, n)).groupBy("bucket", "grp", "token", "block").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    least = F.col("e")[0]["id"]
    return listed.select("bucket", "token", "block", (F.shiftleft("block", BLOCK_BITS) + least).alias("first"), F.transform("e", lambda x: x["id"] - least).alias("ids"), F.transform("e", lambda x: x["places"]).alias("places"))


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """What counts of all segments as segment 0 of another index."""
    merged(spark, path).sortWithinPartitions("bucket", "token", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/lists/segment=0")
    _, newest = read(spark, path)
    newest.select("id").write.mode("overwrite").parquet(f"{target}/docs/segment=0")


def _intersected(lists: Column) -> Column:
    return F.aggregate(F.slice(lists, 2, F.size(lists)), lists[0], F.array_intersect)


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str = "query_id", text: str = "text", phrase: bool = False) -> DataFrame:
    """(query_id, id, hits) of documents with all tokens of a query, or with them in a row; ``hits`` counts the rows' starts, or one.

    A table of queries joins the lists by bucket and token; the buckets it needs
    prune the read when it runs.
    """
    words = queries.select(query_id, F.posexplode(tokens(F.col(text))).alias("slot", "token"), F.size(tokens(F.col(text))).alias("n"))
    if not phrase:
        words = words.groupBy(query_id, "token").agg(F.min("slot").alias("slot")).withColumn("n", F.count("*").over(Window.partitionBy(query_id)))
    found, newest = read(spark, path)
    met = found.join(words.withColumn("bucket", bucket(F.col("token"))), ["bucket", "token"])
    in_block = F.col("first").bitwiseAND((1 << BLOCK_BITS) - 1)
    if phrase:  # the document's distance and where the phrase would start, as one number
        keys = F.flatten(F.transform(F.arrays_zip("ids", "places"), lambda e: F.transform(e["places"], lambda p: F.shiftleft(e["ids"] + in_block, PLACE_BITS) + p - F.col("slot"))))
    else:
        keys = F.transform("ids", lambda i: F.shiftleft(i + in_block, PLACE_BITS))
    sided = met.select(query_id, "n", "segment", "block", keys.alias("keys")).groupBy(query_id, "n", "segment", "block").agg(F.collect_list("keys").alias("l"))
    both = sided.filter(F.size("l") == F.col("n")).select(query_id, "segment", "block", F.explode(_intersected(F.col("l"))).alias("k"))
    hits = both.groupBy(query_id, "segment", (F.shiftleft("block", BLOCK_BITS) + F.shiftright("k", PLACE_BITS)).alias("id")).agg(F.count("*").alias("hits"))
    return hits.join(newest, ["id", "segment"], "left_semi").select(query_id, "id", "hits")


def for_tokens(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The lists of tokens known beforehand: the plan reads only their buckets' folders."""
    found, _ = read(spark, path)
    buckets = [r["b"] for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(bucket(F.col("w")).alias("b")).distinct().collect()]
    return found.filter(F.col("bucket").isin(buckets) & F.col("token").isin(wanted))


# Substrings -------------------------------------------------------------------


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; a shorter text has none."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def containing(texts: DataFrame, key: str, text: str, queries: DataFrame, query: str, size: int = 3) -> DataFrame:
    """Rows of texts joined with the queries, not empty, that lie in them.

    A query meets the texts that hold its rarest run of ``size`` characters (all
    of it, if shorter), by an equality; whether it lies there whole is tested on
    those.  Only keys move with the runs, and only runs that a query asks for.
    """
    asked = queries.filter(F.length(query) > 0).withColumn("_gram", F.explode(F.when(F.length(query) >= size, grams(F.col(query), size)).otherwise(F.array(F.col(query)))))
    every = F.flatten(F.array(*(grams(F.col(text), s) for s in range(1, size + 1))))
    spots = texts.select(key, F.explode(every).alias("_gram")).join(asked.select("_gram").distinct(), "_gram", "left_semi")
    often = spots.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(often, "_gram").groupBy(*queries.columns).agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    met = spots.join(rarest, "_gram").drop("_gram")
    return texts.join(met, key).filter(F.contains(F.col(text), F.col(query)))
