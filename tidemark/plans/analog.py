"""Postings, evidence and sources seen in the star schema: the tables the queries run on.

posting = order; status O open, F closed, P delayed; company = customer; career
type = order priority; sector = market segment; location = nation; first seen =
order date; closes = last ship date of the order's items; skill mention = line
item of a part, skill = brand; requirement = return flag; confirmed = quantity of
10 or more; source = supplier, an order's smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evidence

#: Parts that are held whole by every task where items are many; more of them are dealt.
HELD_PARTS = 100_000

# Category and domain by brand number modulo 5.
CATEGORIES = ("language", "web", "data", "infra", "ai")
DOMAINS = ("backend", "frontend", "data", "platform", "ai")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: of a small file, whose rows cost much each, one task would do all the work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _by_number(values: tuple[str, ...], number):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def brand_number(c):
    return F.regexp_extract(c, r"(\d+)$", 1).cast("int")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the brand of their part.  Many items are never sorted for it: they meet few parts where they are, and many in as many tasks as the items ask for, so no task's share grows with the tables."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    n = evidence.tasks(items, items.count())
    if n and parts.count() > HELD_PARTS:
        items, parts = items.repartition(n, "l_partkey"), parts.hint("shuffle_hash")
    elif n:
        parts = F.broadcast(parts)
    kind = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "A", "preferred").otherwise("unspecified")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("posting_id"), F.col("p_brand").alias("skill"), _by_number(CATEGORIES, brand_number(F.col("p_brand"))).alias("category"), kind.alias("requirement_type"), (F.col("l_quantity") >= 10).alias("confirmed")
    )


def postings(spark: SparkSession, sf_dir: str, dated: bool = False, sourced: bool = False, open_only: bool = False) -> DataFrame:
    """Postings; ``open_only`` is decided in the scan; closing dates and sources cost an aggregation over the items and are added only when asked for."""
    orders, customers, nations = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    if open_only:
        orders = orders.filter(F.col("o_orderstatus") == "O")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("delayed")
    out = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("posting_id"), F.col("o_custkey").alias("company_id"), F.col("c_name").alias("company_name"), status.alias("status"), F.concat_ws(" ", F.initcap("c_mktsegment"), F.substring("o_orderpriority", 3, 20)).alias("title"),
        F.col("o_orderpriority").alias("career_type"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("location"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"), F.col("o_orderdate").cast("timestamp").alias("last_verified_at"), "o_totalprice"
    )
    if dated or sourced:
        items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("posting_id")).agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("closes_at"), F.min("l_suppkey").alias("source_id"))
        out = out.join(items, "posting_id", "left")
        out = out if sourced else out.drop("source_id")
    return out


def skill_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """skill, domains: a brand's own domain, and the next one for every third brand."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("skill")).distinct()
    n = brand_number(F.col("skill"))
    own, more = _by_number(DOMAINS, n), _by_number(DOMAINS, n + 1)
    return brands.withColumn("domains", F.when(n % 3 == 0, F.array(own, more)).otherwise(F.array(own)))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources, with states derived from their numbers."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    status = F.when(k % 11 == 0, "blocked").when(k % 7 == 0, "needs_browser").when(k % 5 == 0, "needs_connector").otherwise("allowed")
    policy = F.when(k % 13 == 0, "stopped").when(k % 6 == 0, "review").otherwise("allowed")
    seen = F.when(k % 4 != 0, F.to_timestamp(F.lit("1998-07-01")) - F.make_interval(hours=(k % 100).cast("int")))
    return s.select(
        k.alias("source_id"), (k % 40).alias("company_id"), F.concat(F.lit("Company "), (k % 40).cast("string")).alias("company_name"), status.alias("status"), policy.alias("policy_status"), F.concat(F.lit("family"), (F.col("s_nationkey") % 5).cast("string")).alias("family"),
        seen.alias("last_success_at"), F.when(k % 9 == 0, "blocked").when(k % 10 == 0, "listing_parse_error").alias("last_error_code"), F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.org/jobs")).alias("base_url"), (F.col("s_nationkey") * 3 - k % 4).alias("priority")
    )


# The same tables for DuckDB.
MENTIONS = """
m AS (SELECT l_orderkey AS posting_id, p_brand AS skill,
             ['language','web','data','infra','ai'][CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 5 + 1] AS category,
             CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'preferred' ELSE 'unspecified' END AS requirement_type,
             CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS rk,
             l_quantity >= 10 AS confirmed, l_quantity AS strength
      FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT posting_id, skill, category, requirement_type, confirmed FROM
      (SELECT *, row_number() OVER (PARTITION BY posting_id, skill ORDER BY confirmed DESC, rk DESC, strength DESC) AS rn FROM m) WHERE rn = 1)"""
POSTINGS = """
p AS (SELECT o_orderkey AS posting_id, o_custkey AS company_id, c_name AS company_name,
             CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'delayed' END AS status,
             upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || substr(o_orderpriority, 3) AS title,
             o_orderpriority AS career_type, c_mktsegment AS sector, n_name AS location, o_orderdate AS first_seen_at, o_orderdate AS last_verified_at, o_totalprice
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
DATED = """
i AS (SELECT l_orderkey, max(l_shipdate) AS closes_at, min(l_suppkey) AS source_id FROM lineitem GROUP BY 1),
d AS (SELECT p.*, i.closes_at, i.source_id FROM p LEFT JOIN i ON posting_id = l_orderkey)"""
FOUND = """
o AS (SELECT e.*, p.company_id, p.company_name, p.career_type, p.location, p.title, p.first_seen_at, p.last_verified_at
      FROM e JOIN p USING (posting_id) WHERE e.confirmed AND p.status = 'open')"""
DOMAIN = """
b AS (SELECT skill, CASE WHEN n % 3 = 0 THEN [own, more] ELSE [own] END AS domains FROM
      (SELECT skill, n, ['backend','frontend','data','platform','ai'][n % 5 + 1] AS own, ['backend','frontend','data','platform','ai'][(n + 1) % 5 + 1] AS more
       FROM (SELECT DISTINCT p_brand AS skill, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS n FROM part)))"""
SOURCES = """
s AS (SELECT s_suppkey AS source_id, s_suppkey % 40 AS company_id, 'Company ' || (s_suppkey % 40) AS company_name,
             CASE WHEN s_suppkey % 11 = 0 THEN 'blocked' WHEN s_suppkey % 7 = 0 THEN 'needs_browser' WHEN s_suppkey % 5 = 0 THEN 'needs_connector' ELSE 'allowed' END AS status,
             CASE WHEN s_suppkey % 13 = 0 THEN 'stopped' WHEN s_suppkey % 6 = 0 THEN 'review' ELSE 'allowed' END AS policy_status,
             'family' || (s_nationkey % 5) AS family,
             CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '1998-07-01' - to_hours(CAST(s_suppkey % 100 AS INT)) END AS last_success_at,
             CASE WHEN s_suppkey % 9 = 0 THEN 'blocked' WHEN s_suppkey % 10 = 0 THEN 'listing_parse_error' END AS last_error_code,
             'https://s' || s_suppkey || '.example.org/jobs' AS base_url, s_nationkey * 3 - s_suppkey % 4 AS priority
      FROM supplier)"""


def sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join(p.strip() for p in parts)}\n{body.strip()}"
