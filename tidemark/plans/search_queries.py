"""Full-text search over documents: an index in three segments, and searches from benchmark items and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import text_index
from tidemark.plans.analog import table
from tidemark.sources.store import fresh_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def index(spark, sf_dir) -> str:
    """All documents as segment 1; segment 2 gives every tenth a longer text and takes every tenth's next one out; segment 3 brings the rows that segment 1 left out."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_table(spark, "text-index")
    text_index.add(spark, path, 1, docs.filter("doc_id % 13 <> 5"))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" Amended: senior spark engineer"))).otherwise(F.lit(None))
    text_index.add(spark, path, 2, docs.filter("doc_id % 10 IN (0, 1)").select("doc_id", changed.alias("text")))
    text_index.add(spark, path, 3, docs.filter("doc_id % 13 = 5 AND doc_id % 10 NOT IN (0, 1)"))
    return path


TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[^\\p{L}\\p{N}_+#]+'), lambda x: x <> '')"
LIVE = f"d AS (SELECT doc_id AS id, {TOKENS} AS w FROM (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN coalesce(text, '') || ' Amended: senior spark engineer' WHEN 1 THEN NULL ELSE text END AS t FROM documents))"


def asked(words: int) -> str:
    return f"q AS (SELECT query_id, {TOKENS} AS w FROM (SELECT item_id::VARCHAR AS query_id, array_to_string(string_split(text, chr(32))[1:{words}], chr(32)) AS t FROM benchmark UNION ALL SELECT 'amended', 'Spark  ENGINEER' UNION ALL SELECT 'twice', 'the the' UNION ALL SELECT 'none', '...'))"


def searches(spark, sf_dir, text):
    more = spark.createDataFrame([("amended", "Spark  ENGINEER"), ("twice", "the the"), ("none", "...")], "query_id string, text string")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), text.alias("text")).unionByName(more)


def first_words(n: int):
    return F.array_join(F.slice(F.split("text", " "), 1, n), " ")


@query(f"WITH {LIVE}, {asked(4)} SELECT query_id, id AS doc_id FROM q JOIN d ON len(q.w) > 0 AND list_has_all(d.w, q.w)")
def text_search_all(spark, sf_dir):
    return text_index.search(spark, index(spark, sf_dir), searches(spark, sf_dir, first_words(4))).select("query_id", F.col("id").alias("doc_id"))


@query(
    f"""WITH {LIVE}, {asked(3)},
j AS (SELECT query_id, id, q.w AS qw, d.w AS dw FROM q JOIN d ON len(q.w) > 0 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(q.w, ' ') || ' '))
SELECT query_id, id AS doc_id, len(list_filter(range(1, len(dw) - len(qw) + 2), lambda i: dw[i:i + len(qw) - 1] = qw)) AS hits FROM j"""
)
def text_search_phrase(spark, sf_dir):
    found = text_index.search(spark, index(spark, sf_dir), searches(spark, sf_dir, first_words(3)), phrase=True)
    return found.select("query_id", F.col("id").alias("doc_id"), "hits")


@query(f"WITH {LIVE} SELECT token, count(*) AS documents, sum(n)::BIGINT AS places FROM (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(w) AS token FROM d) GROUP BY 1, 2) WHERE token IN ('the', 'engineer', 'spark', 'report', 'und') GROUP BY 1")
def text_index_lists(spark, sf_dir):
    """The compacted index's lists of five tokens: only their buckets are read."""
    source, path = index(spark, sf_dir), fresh_table(spark, "text-index")
    text_index.compacted(spark, source, path)
    found = text_index.for_tokens(spark, path, ["the", "engineer", "spark", "report", "und"])
    return found.groupBy("token").agg(F.sum(F.size("ids")).alias("documents"), F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + F.size(p))).alias("places"))
