"""Sources, body quality, and the incremental pipeline."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators import ingest, source_health
from tidemark.plans.analog import DATED, FOUND, MENTIONS, POSTINGS, SOURCES, mentions, postings, sources, sql, table
from tidemark.plans.evidence_queries import found

NOW, SINCE = datetime(1998, 7, 1), datetime(1998, 6, 29)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


RUNNABLE = "status = 'allowed' AND policy_status = 'allowed'"
ACTIVE = """
ac AS (SELECT source_id, count(*) FILTER (status = 'open') AS open_postings, count(*) FILTER (first_seen_at >= TIMESTAMP '1998-06-29') AS new_postings, count(*) FILTER (closes_at >= TIMESTAMP '1998-06-29') AS seen_postings,
  count(*) FILTER (status = 'closed' AND last_verified_at >= TIMESTAMP '1998-06-29') AS closed_postings, count(*) FILTER (status = 'open' AND posting_id IN (SELECT posting_id FROM m)) AS tech_open_postings FROM d GROUP BY 1)"""
ITEMS = f"""
it AS (SELECT s.*, coalesce(open_postings, 0) AS open_postings, coalesce(new_postings, 0) AS new_postings, coalesce(seen_postings, 0) AS seen_postings, coalesce(closed_postings, 0) AS closed_postings, coalesce(tech_open_postings, 0) AS tech_open_postings,
  CASE WHEN status = 'blocked' OR policy_status = 'blocked' THEN 'blocked' WHEN status = 'stopped' OR policy_status = 'stopped' THEN 'stopped' WHEN policy_status <> 'allowed' THEN 'pending' WHEN last_error_code IS NOT NULL THEN 'failing'
       WHEN {RUNNABLE} AND coalesce(last_success_at >= TIMESTAMP '1998-06-29', false) THEN 'healthy' WHEN {RUNNABLE} THEN 'stale' ELSE 'pending' END AS health
  FROM s LEFT JOIN ac USING (source_id))"""
MONITOR = (MENTIONS, POSTINGS, DATED, SOURCES, ACTIVE, ITEMS)


def _active(spark, sf_dir):
    jobs = postings(spark, sf_dir, sourced=True).withColumn("last_seen_at", F.col("closes_at"))
    return source_health.activity(jobs, SINCE, mentions(spark, sf_dir))


def _items(spark, sf_dir):
    return source_health.monitor(sources(spark, sf_dir), _active(spark, sf_dir), SINCE)


@query(sql("SELECT source_id, health, open_postings, new_postings, seen_postings, closed_postings, tech_open_postings, CAST(CASE WHEN open_postings > 0 THEN floor(100.0 * tech_open_postings / open_postings + 0.5) ELSE 0 END AS BIGINT) AS tech_percent FROM it", *MONITOR))
def source_monitor_items(spark, sf_dir):
    return _items(spark, sf_dir).select("source_id", "health", "open_postings", "new_postings", "seen_postings", "closed_postings", "tech_open_postings", "tech_percent")


FAMILY = "count(*) AS sources, count(*) FILTER (health = 'healthy') AS healthy, count(*) FILTER (health = 'stale') AS stale, count(*) FILTER (health = 'failing') AS failing, count(*) FILTER (health = 'blocked') AS blocked, count(*) FILTER (health = 'stopped') AS stopped, count(*) FILTER (health = 'pending') AS pending, CAST(sum(open_postings) AS BIGINT) AS open_postings, CAST(sum(tech_open_postings) AS BIGINT) AS tech_open_postings"


@query(sql(f"SELECT family, {FAMILY} FROM it GROUP BY 1", *MONITOR))
def source_family_health(spark, sf_dir):
    return source_health.family_health(_items(spark, sf_dir)).filter("not is_total").drop("is_total")


@query(sql(f"SELECT {FAMILY} FROM it", *MONITOR))
def source_totals(spark, sf_dir):
    return source_health.family_health(_items(spark, sf_dir)).filter("is_total").drop("family", "is_total")


@query(sql("SELECT 'status' AS field, status AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'policy_status', policy_status, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'family', family, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'last_error_code', coalesce(last_error_code, 'unknown'), count(*) FROM s GROUP BY 2", SOURCES))
def source_value_counts(spark, sf_dir):
    return source_health.value_counts(sources(spark, sf_dir), ["status", "policy_status", "family", "last_error_code"])


@query(sql("SELECT source_id, priority, open_postings FROM it ORDER BY priority DESC, open_postings DESC, company_name DESC, source_id LIMIT 10", *MONITOR))
def source_report_tops(spark, sf_dir):
    return _items(spark, sf_dir).orderBy(F.desc("priority"), F.desc("open_postings"), F.desc("company_name"), "source_id").limit(10).select("source_id", "priority", "open_postings")


@query(
    sql(
        f"""SELECT company_id, company_name, sources, collecting, open_postings, CASE WHEN NOT collecting THEN 'preparing' WHEN last IS NULL OR last < TIMESTAMP '1998-06-29' THEN 'attention' WHEN open_postings > 0 THEN 'active' ELSE 'quiet' END AS activity,
  CASE WHEN collecting THEN NULL ELSE reason END AS reason, careers_url FROM
(SELECT company_id, company_name, count(*) AS sources, bool_or(c) AS collecting, CAST(coalesce(sum(open_postings) FILTER (c), 0) AS BIGINT) AS open_postings, max(last_success_at) FILTER (c) AS last,
  min(CASE WHEN c THEN NULL WHEN policy_status = 'review' THEN 'policy_review' WHEN status = 'needs_browser' THEN 'access_limited' WHEN status = 'needs_connector' THEN 'connector_pending' ELSE 'policy_review' END) AS reason,
  arg_max(base_url, (CAST(c AS INT), open_postings, -source_id)) AS careers_url
 FROM (SELECT *, {RUNNABLE} AS c FROM it WHERE status NOT IN ('blocked', 'stopped')) GROUP BY 1, 2)""",
        *MONITOR,
    )
)
def source_directory(spark, sf_dir):
    return source_health.directory(sources(spark, sf_dir), _active(spark, sf_dir), NOW)


AUDITED = "t AS (SELECT source, doc_id, length(trim(regexp_replace(CASE WHEN doc_id % 6 = 0 THEN substr(text, 1, 60) ELSE text END, '\\s+', ' ', 'g'))) >= 120 AS long, doc_id % 4 = 0 AS pictured, contains(lower(text), 'data') AS skilled FROM documents)"


@query(
    f"""WITH {AUDITED}
SELECT source, count(*) FILTER (long OR pictured) AS substantive, count(*) FILTER (NOT long AND pictured) AS image_only, count(*) FILTER (NOT long AND NOT pictured) AS sparse, count(*) FILTER (NOT coalesce(skilled, FALSE)) AS zero_skill,
  coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM t x WHERE x.source = t.source AND NOT x.long AND NOT x.pictured ORDER BY doc_id LIMIT 3)), '') AS examples FROM t GROUP BY source"""
)
def quality_audit(spark, sf_dir):
    """Every sixth text is cut short, every fourth has a picture, and a skill is the word data."""
    d = table(spark, sf_dir, "documents").withColumn("skilled", F.contains(F.lower("text"), F.lit("data"))).withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.substring("text", 1, 60)).otherwise(F.col("text")))
    return source_health.body_quality(d, "source", "doc_id", "text", F.when(F.col("doc_id") % 4 == 0, 1), with_skill=F.col("skilled"))


@query(
    sql(
        """SELECT source_id, health, open_postings, coalesce(substantive, 0) AS substantive_open_postings, coalesce(image_only, 0) AS image_only_open_postings, coalesce(sparse, 0) AS sparse_open_postings, coalesce(zero_skill, 0) AS zero_skill_open_postings, coalesce(examples, '') AS sparse_examples FROM it
LEFT JOIN (SELECT source_id, count(*) FILTER (posting_id % 3 <> 0 OR posting_id % 5 = 0) AS substantive, count(*) FILTER (posting_id % 3 = 0 AND posting_id % 5 = 0) AS image_only, count(*) FILTER (posting_id % 3 = 0 AND posting_id % 5 <> 0) AS sparse, count(*) FILTER (posting_id % 7 = 0) AS zero_skill,
  array_to_string(list(posting_id ORDER BY posting_id) FILTER (posting_id % 3 = 0 AND posting_id % 5 <> 0)[1:3], ',') AS examples FROM d WHERE status = 'open' GROUP BY 1) USING (source_id)""",
        *MONITOR,
    )
)
def source_monitor_quality(spark, sf_dir):
    """Sources with the quality of their open postings: every third says little, every fifth has a picture, every seventh no skill."""
    k = F.col("posting_id")
    open_ = postings(spark, sf_dir, sourced=True, open_only=True).withColumn("body", F.when(k % 3 == 0, F.col("title")).otherwise(F.repeat(F.lit("word "), 30)))
    quality = source_health.body_quality(open_, "source_id", "posting_id", "body", F.when(k % 5 == 0, 1), with_skill=k % 7 != 0)
    items = source_health.with_quality(_items(spark, sf_dir), quality)
    return items.select("source_id", "health", "open_postings", "substantive_open_postings", "image_only_open_postings", "sparse_open_postings", "zero_skill_open_postings", "sparse_examples")


@query(sql("SELECT source_id, last_error_code FROM s WHERE last_error_code IS NOT NULL ORDER BY last_error_code, company_name, source_id LIMIT 10", SOURCES))
def source_error_tops(spark, sf_dir):
    return source_health.error_tops(sources(spark, sf_dir), 10).select("source_id", "last_error_code")


# Incremental: documents with ids below the middle are the state, the rest the batch.
@query("SELECT source, sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND b.source = documents.source AND b.text = documents.text) GROUP BY 1, 2")
def revision_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", identity.content_hash(F.col("text")).alias("content_hash"))
    incoming = docs.filter("doc_id % 2 = 1").groupBy("source", "content_hash").agg(F.min("doc_id").alias("doc_id"))
    return ingest.new_revisions(docs.filter("doc_id % 2 = 0"), incoming, "source", "content_hash")


@query("SELECT sha256(text) AS content_hash, 'sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.html' AS storage_key, count(*) AS n FROM documents GROUP BY 1, 2")
def raw_snapshot_store(spark, sf_dir):
    digest = identity.content_hash(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy(digest.alias("content_hash")).agg(F.count("*").alias("n")).withColumn("storage_key", identity.blob_key(F.col("content_hash")))


@query(
    sql(
        """SELECT posting_id, CASE WHEN status <> 'closed' AND complete AND new_runs >= 3 THEN 'closed' ELSE status END AS status, new_runs AS missing_runs FROM
(SELECT posting_id, status, source_id IS NOT NULL AND source_id % 3 <> 0 AS complete, CASE WHEN source_id IS NULL OR source_id % 3 = 0 OR status = 'closed' THEN posting_id % 4 WHEN posting_id % 5 < 2 THEN 0 ELSE posting_id % 4 + 1 END AS new_runs FROM d)""",
        POSTINGS, DATED,
    )
)
def absence_transitions(spark, sf_dir):
    state = postings(spark, sf_dir, sourced=True).select("posting_id", "source_id", "status", (F.col("posting_id") % 4).alias("missing_runs"))
    listings = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 3 != 0).alias("complete"))
    return ingest.absence(state, state.filter("posting_id % 5 < 2").select("posting_id"), listings).select("posting_id", "status", "missing_runs")


@query(sql("SELECT d.posting_id, CASE WHEN d.status = 'open' AND s.status <> 'allowed' AND (last_success_at IS NULL OR last_success_at <= TIMESTAMP '1998-06-28') THEN 'delayed' ELSE d.status END AS status FROM d LEFT JOIN s USING (source_id)", POSTINGS, DATED, SOURCES))
def stale_quarantine(spark, sf_dir):
    return ingest.quarantine(postings(spark, sf_dir, sourced=True), sources(spark, sf_dir), NOW).select("posting_id", "status")


@query(
    """WITH st AS (SELECT o_orderkey AS k, o_custkey AS src, o_orderstatus AS status, o_orderdate AS first_seen FROM orders WHERE o_orderkey % 3 <> 0),
ba AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 7 THEN o_custkey + 100000000 ELSE o_custkey END AS src, 'O' AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 10 = 7)
SELECT k AS external_id, ba.src AS source_id, ba.status, coalesce(strftime(first_seen, '%Y-%m-%d'), '2002-01-01') AS first_seen, 0 AS missing_runs, CASE WHEN first_seen IS NULL THEN 'insert' WHEN st.src = ba.src THEN 'update' ELSE 'move' END AS action FROM ba LEFT JOIN st USING (k)
UNION ALL SELECT k, src, status, strftime(first_seen, '%Y-%m-%d'), 1, 'keep' FROM st WHERE k NOT IN (SELECT k FROM ba)"""
)
def posting_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("external_id"), F.col("o_custkey").alias("source_id"), F.concat(F.lit("https://jobs.example.org/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"))
    state = orders.filter("external_id % 3 <> 0").withColumn("last_seen_at", F.col("first_seen_at")).withColumn("missing_runs", F.lit(1))
    moved = F.when(F.col("external_id") % 10 == 7, F.col("source_id") + 100_000_000).otherwise(F.col("source_id"))
    batch = orders.filter("external_id % 2 = 0 OR external_id % 10 = 7").withColumn("source_id", moved).withColumn("status", F.lit("O")).drop("first_seen_at")
    out = ingest.upsert(state, batch, datetime(2002, 1, 1))
    return out.select("external_id", "source_id", "status", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), "missing_runs", "action")


# Notifications: literal searches and follows over the postings of June 1998.
SEARCHES = [
    ("u1", 1, "urgent", "", "", "1-URGENT", datetime(1998, 6, 20), datetime(1998, 1, 1)),
    ("u1", 2, "house", "house", "", "", datetime(1998, 6, 28), datetime(1998, 1, 2)),
    ("u2", 3, "infra", "", "infra", "", datetime(1998, 6, 29), datetime(1998, 1, 1)),
    ("u2", 4, "place", "nation_7", "data", "5-LOW", datetime(1990, 1, 1), datetime(1998, 1, 1)),
    ("u3", 5, "brand", "brand#25", "", "", datetime(1998, 6, 15), datetime(1998, 1, 1)),
]
FOLLOWS = [("u1", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], datetime(1998, 6, 1), True), ("u2", [*range(100, 160)], datetime(1990, 1, 1), True), ("u4", [4, 6], datetime(1990, 1, 1), False)]
WINDOW = "status = 'open' AND first_seen_at > TIMESTAMP '1998-06-01' AND first_seen_at <= TIMESTAMP '1998-07-01'"
MATCHES = f"""
rp AS (SELECT p.*, lower(concat_ws(chr(10), title, location, company_name, sk)) AS txt, cats FROM p LEFT JOIN (SELECT posting_id, string_agg(DISTINCT lower(skill), chr(10)) AS sk, list(DISTINCT category) AS cats FROM o GROUP BY 1) USING (posting_id) WHERE {WINDOW}),
sm AS (SELECT 'u1' AS user_id, 1 AS search_id, posting_id, first_seen_at FROM rp WHERE career_type = '1-URGENT' AND first_seen_at > TIMESTAMP '1998-06-20'
  UNION ALL SELECT 'u1', 2, posting_id, first_seen_at FROM rp WHERE contains(txt, 'house') AND first_seen_at > TIMESTAMP '1998-06-28'
  UNION ALL SELECT 'u2', 3, posting_id, first_seen_at FROM rp WHERE list_contains(cats, 'infra') AND first_seen_at > TIMESTAMP '1998-06-29'
  UNION ALL SELECT 'u2', 4, posting_id, first_seen_at FROM rp WHERE career_type = '5-LOW' AND list_contains(cats, 'data') AND contains(txt, 'nation_7')
  UNION ALL SELECT 'u3', 5, posting_id, first_seen_at FROM rp WHERE contains(txt, 'brand#25') AND first_seen_at > TIMESTAMP '1998-06-15'),
fm AS (SELECT 'u1' AS user_id, posting_id, first_seen_at FROM rp WHERE company_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) UNION ALL SELECT 'u2', posting_id, first_seen_at FROM rp WHERE company_id BETWEEN 100 AND 159),
nt AS (SELECT *, 'job:' || posting_id AS dedupe_key, row_number() OVER (PARTITION BY user_id ORDER BY first_seen_at DESC, posting_id DESC) AS rank FROM
  (SELECT user_id, posting_id, max(first_seen_at) AS first_seen_at, bool_or(followed) AS followed_company, coalesce(string_agg(DISTINCT search_id::VARCHAR, ',' ORDER BY search_id::VARCHAR), '') AS searches
   FROM (SELECT user_id, posting_id, first_seen_at, search_id, false AS followed FROM sm UNION ALL SELECT user_id, posting_id, first_seen_at, NULL, true FROM fm) GROUP BY 1, 2))"""


def _matches(spark, sf_dir):
    searches = spark.createDataFrame(SEARCHES, "user_id string, search_id int, name string, query_text string, category string, career_type string, last_checked_at timestamp, updated_at timestamp")
    follows = spark.createDataFrame(FOLLOWS, "user_id string, company_ids array<long>, checked_at timestamp, enabled boolean")
    jobs = postings(spark, sf_dir)
    return ingest.search_matches(searches, jobs, found(spark, sf_dir), NOW), ingest.followed_matches(follows, jobs, NOW)


@query(sql("SELECT user_id, search_id, posting_id FROM sm", MENTIONS, POSTINGS, FOUND, MATCHES))
def saved_search_matches(spark, sf_dir):
    return _matches(spark, sf_dir)[0].select("user_id", "search_id", "posting_id")


@query(sql("SELECT user_id, posting_id, followed_company, searches, CAST(rank AS INT) AS rank FROM nt WHERE rank <= 20 AND posting_id % 7 <> 0", MENTIONS, POSTINGS, FOUND, MATCHES))
def notifications_new(spark, sf_dir):
    by_search, by_company = _matches(spark, sf_dir)
    sent = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.explode(F.array(*map(F.lit, ("u1", "u2", "u3")))).alias("user_id"), F.concat(F.lit("job:"), F.col("o_orderkey").cast("string")).alias("dedupe_key"))
    new = ingest.notifications(by_search, by_company, sent)
    return new.select("user_id", "posting_id", "followed_company", F.array_join("search_ids", ",").alias("searches"), "rank")
