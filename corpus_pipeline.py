"""The corpus pipeline: documents go through five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.

1. quality     documents that the quality rules reject go
2. line_dedup  recurring lines go; ``n_chars`` follows the text
3. near_dedup  of each class of near copies the document with the smallest id stays
4. decontaminate  documents that hold a benchmark window go
5. tokenise    one row per document: doc_id, n_tokens, ids, and the digest of the decoded bytes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from tidemark.llm.common import fresh_dir, short_batches
from tidemark.llm.registry import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text has no words and goes; rows with null or repeated ids are judged each by its own text."""
    return quality.assess(docs.select(COLUMNS), table(spark, sf_dir, "labels"), group="lang").filter("kept").select(COLUMNS)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, a text all of whose lines go is empty; a null text stays null; copies of a text count once."""
    short_batches(spark)
    return line_dedup.dedup(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated rows of a document count once.  A document without an id can't be its class's first by id: such documents stay, each text once."""
    short_batches(spark)
    docs = docs.select(COLUMNS)
    named = docs.filter("doc_id is not null")
    classes = jaccard_join.join(named, count_links=False)
    first = classes.filter("doc_id = class_id").select("doc_id")
    kept = named.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])  # dealt by doc_id already
    return kept.select(COLUMNS).unionByName(docs.filter("doc_id is null").dropDuplicates(["text"]).select(COLUMNS))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row by its own text; null and empty texts hold no window and stay."""
    found = decontaminate.find(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(COLUMNS)


def stage_tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row, also for null or repeated ids; a null text is empty and has no ids."""
    import public_tokenizers

    short_batches(spark)
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(docs, "doc_id", "text", path, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, "ids", path).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("tokenise", stage_tokenise),
]

#: Similarity classes and byte-pair merges are not expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
