"""Queries of the small views: latest and first of a group, tops, pages, merges, client state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import evidence, ingest, views
from tidemark.plans.analog import FOUND, MENTIONS, POSTINGS, SOURCES, mentions, postings, sources, sql, table
from tidemark.plans.community_queries import POSTS, posts
from tidemark.plans.evidence_queries import found

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BASE = (MENTIONS, POSTINGS, FOUND)


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


@query(sql("SELECT company_id, strftime(max(last_verified_at), '%Y-%m-%d') AS last_verified, arg_max(posting_id, (last_verified_at, posting_id)) AS posting_id FROM p GROUP BY 1", POSTINGS))
def company_latest_posting(spark, sf_dir):
    jobs = postings(spark, sf_dir).select("company_id", "last_verified_at", "posting_id")
    return views.latest(jobs, "company_id", "last_verified_at", "posting_id").select("company_id", F.date_format("last_verified_at", "yyyy-MM-dd").alias("last_verified"), "posting_id")


@query(sql("SELECT skill, coalesce(arg_max(c, (first_seen_at, posting_id)) FILTER (c IS NOT NULL), 'other') AS category FROM (SELECT skill, first_seen_at, posting_id, CASE WHEN posting_id % 3 <> 0 AND skill <> 'Brand#5' THEN 'c' || (posting_id % 7) END AS c FROM m JOIN p USING (posting_id)) GROUP BY 1", MENTIONS, POSTINGS))
def skill_last_category(spark, sf_dir):
    k = F.col("posting_id")
    seen = mentions(spark, sf_dir).select("posting_id", "skill").join(postings(spark, sf_dir).select("posting_id", "first_seen_at"), "posting_id")
    seen = seen.withColumn("c", F.when((k % 3 != 0) & (F.col("skill") != "Brand#5"), F.concat(F.lit("c"), (k % 7).cast("string"))))
    return views.last_category(seen, "skill", "c", ["first_seen_at", "posting_id"])


@query(sql("SELECT location, posting_id, price FROM (SELECT location, posting_id, CAST(o_totalprice AS DOUBLE) AS price, row_number() OVER (PARTITION BY location ORDER BY o_totalprice DESC, posting_id) AS r FROM p WHERE status = 'open') WHERE r = 1", POSTINGS))
def location_representative(spark, sf_dir):
    jobs = postings(spark, sf_dir, open_only=True).select("location", "posting_id", F.col("o_totalprice").cast("double").alias("price"))
    return views.first_of_group(jobs, "location", "price", "posting_id")


HEALTH = "h AS (SELECT *, CASE WHEN source_id % 3 = 0 THEN 'stale' WHEN source_id % 3 = 1 THEN 'failing' ELSE 'healthy' END AS health, source_id % 17 AS sparse FROM s)"


@query(
    sql(
        """SELECT kind, CAST(place AS INT) AS place, source_id FROM (
SELECT 'stale' AS kind, row_number() OVER (ORDER BY last_success_at NULLS FIRST, source_id) AS place, source_id FROM h WHERE health = 'stale'
UNION ALL SELECT 'failing', row_number() OVER (ORDER BY last_error_code NULLS FIRST, source_id), source_id FROM h WHERE health = 'failing'
UNION ALL SELECT 'sparse', row_number() OVER (ORDER BY sparse DESC, source_id), source_id FROM h WHERE sparse > 0) WHERE place <= 10""",
        SOURCES,
        HEALTH,
    )
)
def monitor_tops(spark, sf_dir):
    k = F.col("source_id")
    items = sources(spark, sf_dir).withColumn("health", F.when(k % 3 == 0, "stale").when(k % 3 == 1, "failing").otherwise("healthy"))
    return views.monitor_tops(items, items.select("source_id", (k % 17).alias("sparse")))


@query(sql("SELECT source_id, priority, base_url FROM s WHERE family = 'family1' ORDER BY priority DESC, company_name, base_url LIMIT 12", SOURCES))
def preview_targets(spark, sf_dir):
    return views.preview_targets(sources(spark, sf_dir), 12, "family1").select("source_id", "priority", "base_url")


@query(sql("SELECT post_id, (SELECT count(*) FROM po WHERE author_id = 3) > 9 AS has_next FROM po WHERE author_id = 3 ORDER BY created_at DESC, post_id DESC LIMIT 9", POSTS))
def author_page(spark, sf_dir):
    mine = posts(spark, sf_dir).filter("author_id = 3")
    return views.page_with_probe(mine, [F.desc("created_at"), F.desc("post_id")], 9).select("post_id", "has_next")


@query(sql("SELECT kind, id, CASE WHEN in_rank IS NULL THEN 1 ELSE 0 END AS held, coalesce(in_rank, held_rank) AS rank FROM (SELECT kind, id, min(rank) FILTER (held = 0) AS in_rank, min(rank) FILTER (held = 1) AS held_rank FROM (SELECT 'k' || (posting_id % 2) AS kind, posting_id % 5000 AS id, posting_id AS rank, 0 AS held FROM p WHERE posting_id % 3 = 0 UNION ALL SELECT 'k' || (posting_id % 2), posting_id % 7000, posting_id, 1 FROM p WHERE posting_id % 3 = 1) GROUP BY 1, 2)", POSTINGS))
def merged_search_results(spark, sf_dir):
    k = F.col("posting_id")
    jobs = postings(spark, sf_dir).select(k, F.concat(F.lit("k"), (k % 2).cast("string")).alias("kind"), k.alias("rank"))
    incoming = jobs.filter(k % 3 == 0).select("kind", (k % 5000).alias("id"), "rank")
    return views.merged_results(incoming, jobs.filter(k % 3 == 1).select("kind", (k % 7000).alias("id"), "rank"), "kind", "id", "rank")


@query(
    sql(
        """SELECT p.posting_id, p.title, p.company_name, coalesce(required, '') AS required_skills, coalesce(n, 0) AS n_skills, strftime(p.first_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS first_seen_at FROM p
LEFT JOIN (SELECT posting_id, string_agg(skill, ',' ORDER BY skill) FILTER (requirement_type = 'required') AS required, count(*) AS n FROM o GROUP BY 1) g ON p.posting_id = g.posting_id""",
        *BASE,
    )
)
def search_documents(spark, sf_dir):
    docs = views.search_documents(postings(spark, sf_dir), evidence.skill_groups(found(spark, sf_dir)))
    n = F.size("required_skills") + F.size("preferred_skills") + F.size("unspecified_skills")
    return docs.select("posting_id", "title", "company_name", F.array_join("required_skills", ",").alias("required_skills"), n.cast("long").alias("n_skills"), "first_seen_at")


@query(sql("SELECT 'all' AS mode, count(*) AS n FROM p UNION ALL SELECT 'matched', count(*) FROM p WHERE posting_id IN (SELECT posting_id FROM o WHERE skill = 'Brand#5') UNION ALL SELECT 'saved', count(*) FROM p WHERE posting_id % 9 = 0", *BASE))
def job_views(spark, sf_dir):
    jobs = postings(spark, sf_dir)
    matched, saved = found(spark, sf_dir).filter("skill = 'Brand#5'"), jobs.filter("posting_id % 9 = 0").select("posting_id")
    out = None
    for mode in ("all", "matched", "saved"):
        one = views.job_view(jobs, mode, matched, saved).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.union(one)
    return out


@query(sql("SELECT source_id, company_name FROM s WHERE contains(replace(lower(company_name), ' ', ''), 'company1')", SOURCES))
def directory_search(spark, sf_dir):
    s = sources(spark, sf_dir)
    return s.filter(views.named_like(F.col("company_name"), " Company 1 ")).select("source_id", "company_name")


@query(
    sql(
        """SELECT DISTINCT posting_id FROM (SELECT a.posting_id, row_number() OVER (PARTITION BY b.skill ORDER BY a.posting_id) AS r
FROM (SELECT DISTINCT posting_id, skill FROM o) a JOIN (SELECT DISTINCT posting_id, skill FROM o) b ON a.posting_id = b.posting_id AND a.skill = 'Brand#5' AND b.skill <> 'Brand#5') WHERE r <= 5""",
        *BASE,
    )
)
def edge_evidence(spark, sf_dir):
    held = found(spark, sf_dir)
    edges = held.filter("skill <> 'Brand#5'").select(F.lit("Brand#5").alias("source"), F.col("skill").alias("target")).distinct()
    return views.edge_evidence(edges, held)


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 <= 1 WHEN c_custkey % 3 = 1 THEN c_custkey % 5 = 0 ELSE FALSE END AS recent FROM customer")
def skill_recent_use(spark, sf_dir):
    k = F.col("c_custkey")
    by_name = F.element_at(F.array(*map(F.lit, ("current", "within_1y", "older", "never"))), (k % 4 + 1).cast("int"))
    usage = F.when(k % 3 == 0, F.create_map(F.lit("Python"), by_name, F.lit("python"), F.lit("older"))).when(k % 3 == 1, F.create_map(F.lit("python"), F.when(k % 5 == 0, "current").otherwise("older")))
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), views.recent_use(usage, F.lit("Python"), F.lit("python")).alias("recent"))


@query(
    """SELECT user_id, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys, string_agg(stage, ',' ORDER BY key) AS stages FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, key) AS r FROM (
SELECT o_custkey % 50 AS user_id, o_orderkey % 97 AS key, max(o_orderkey) AS t, arg_max(o_orderstatus, o_orderkey) AS stage FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2)) WHERE r <= 24 GROUP BY 1"""
)
def application_stages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("user_id"), (F.col("o_orderkey") % 97).alias("key"), F.col("o_orderstatus").alias("stage"), F.col("o_orderkey").alias("t"))
    kept = views.newest_entries(o, "user_id", "key", "stage", "t", ["O", "F"])
    entries = F.array_sort(F.map_entries("entries"))
    return kept.select("user_id", F.size("entries").cast("long").alias("n"), F.aggregate(F.map_keys("entries"), F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"), F.array_join(F.transform(entries, lambda e: e["value"]), ",").alias("stages"))


@query(
    """SELECT user_id, slug, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t DESC, slug) AS INT) AS place FROM (SELECT s_nationkey AS user_id, 'c-' || (s_suppkey % 200) AS slug, max(s_suppkey) AS t FROM supplier WHERE s_suppkey % 6 <> 0 GROUP BY 1, 2) QUALIFY place <= 60"""
)
def followed_company_slugs(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 6 == 0, " -bad_").otherwise(" C-"), (k % 200).cast("string"), F.lit(" "))
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("user_id"), name.alias("slug"), k.alias("t"))
    return views.followed_slugs(f, "user_id", "slug", "t").select("user_id", "slug", "place")


@query(sql("SELECT post_id, author_id, CASE WHEN author_id = 2 AND post_id % 3 = 0 THEN 'edited ' || post_id ELSE title END AS title, strftime(CASE WHEN author_id = 2 AND post_id % 3 = 0 THEN TIMESTAMP '2024-09-01' ELSE created_at END, '%Y-%m-%d %H') AS updated FROM po WHERE NOT (author_id = 2 AND post_id % 5 = 0)", POSTS))
def owned_posts_edit(spark, sf_dir):
    p = posts(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    edits = p.filter("post_id % 3 = 0").select("post_id", F.concat(F.lit("edited "), F.col("post_id").cast("string")).alias("title"))
    after = views.owned_edit(p, 2, edits, p.filter("post_id % 5 = 0").select("post_id"), datetime(2024, 9, 1))
    return after.select("post_id", "author_id", "title", F.date_format("updated_at", "yyyy-MM-dd HH").alias("updated"))


@query(
    """SELECT search_id, user_id, strftime(CASE WHEN r <= 10 THEN DATE '2002-01-01' ELSE seen END, '%Y-%m-%d') AS checked, coalesce(r <= 10 AND user_id % 7 <> 0, FALSE) AS evaluated
FROM (SELECT o_orderkey AS search_id, o_custkey % 200 AS user_id, o_orderdate AS seen FROM orders) LEFT JOIN
(SELECT o_orderkey AS search_id, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 5 <> 0) USING (search_id)"""
)
def search_checkpoints(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    searches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("search_id"), (F.col("o_custkey") % 200).alias("user_id"), at.alias("updated_at"), at.alias("last_checked_at"), (F.col("o_orderkey") % 5 != 0).alias("is_enabled"))
    states = spark.range(200).select(F.col("id").alias("user_id"), (F.col("id") % 7 != 0).alias("job_notifications_enabled"))
    out = ingest.advanced(searches, states, datetime(2002, 1, 1))
    return out.select("search_id", "user_id", F.date_format("last_checked_at", "yyyy-MM-dd").alias("checked"), "evaluated")


@query(sql("SELECT w.posting_id, CAST(w.place AS INT) AS place, CASE WHEN p.posting_id IS NULL THEN 'unavailable' ELSE 'item' END AS state, p.title FROM (SELECT x * 5 AS posting_id, x AS place FROM range(1, 25) t(x)) w LEFT JOIN p USING (posting_id)", POSTINGS))
def saved_lookup(spark, sf_dir):
    wanted = spark.range(1, 60).select((F.col("id") * 5).alias("posting_id"), F.col("id").cast("int").alias("place"))
    return views.lookup(wanted, postings(spark, sf_dir).select("posting_id", "title")).select("posting_id", "place", "state", "title")
