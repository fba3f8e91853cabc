"""State that changes: quotas over events, users who leave, and mentions kept in step with changed texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import accounts, community, quota, resync, skill_mentions
from tidemark.plans import community_queries, skill_queries
from tidemark.plans.analog import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query(
    """WITH RECURSIVE e AS (SELECT event_id, CASE WHEN user_id % 40 <> 7 THEN user_id END AS client, epoch_us(ts) AS t, event_id % 90 + 1 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, user_id FROM events),
f AS (SELECT user_id, i, event_id, t + 172800000000 AS ends, CASE WHEN n <= 240 THEN n ELSE 0 END AS used, n <= 240 AS allowed, 0::BIGINT AS retry_after FROM e WHERE i = 1 AND client IS NOT NULL
  UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN e.t >= f.ends THEN e.t + 172800000000 ELSE f.ends END, CASE WHEN e.t >= f.ends THEN e.n WHEN f.used + e.n <= 240 THEN f.used + e.n ELSE f.used END, e.t >= f.ends OR f.used + e.n <= 240,
    CASE WHEN e.t >= f.ends OR f.used + e.n <= 240 THEN 0 ELSE greatest(1, (f.ends - e.t + 999999) // 1000000) END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, allowed, retry_after FROM f UNION ALL SELECT event_id, TRUE, 0 FROM e WHERE client IS NULL"""
)
def lookup_quota(spark, sf_dir):
    """Windows of two days, as the table's users come seldom; some requests name no client."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("user_id") % 40 != 7, F.col("user_id")).alias("client"), (F.col("event_id") % 90 + 1).alias("n"))
    return quota.consumed(e, "client", "ts", "event_id", "n", seconds=172_800).select("event_id", "allowed", "retry_after")


NOW = datetime(2024, 9, 1)
GONE = "user_id % 5 = 2"


def social(spark, sf_dir):
    """Community tables of customers and conversations, with authors among the customers."""
    user = lambda n: F.pmod(n, F.lit(37))
    p, c = community_queries.posts(spark, sf_dir), community_queries.comments(spark, sf_dir)
    posts = p.select("post_id", user(F.col("post_id") * 3).alias("author_id"), "created_at")
    comments = c.select("comment_id", "post_id", user(F.col("comment_id")).alias("author_id"))
    reactions = c.select("post_id", user(F.col("comment_id") * 7 + F.col("post_id")).alias("user_id")).distinct()
    saves = p.filter("post_id % 2 = 0").select("post_id", user(F.col("post_id") + 1).alias("user_id"))
    follows = table(spark, sf_dir, "customer").select(user(F.col("c_custkey")).alias("follower_id"), user(F.col("c_custkey") * 5 + 1).alias("followed_id")).distinct()
    profiles = table(spark, sf_dir, "customer").filter("c_custkey < 37").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("nickname"), F.lit(datetime(2024, 1, 1)).alias("updated_at"))
    counted = community.counters(posts, comments, reactions, saves).withColumn("updated_at", F.lit(datetime(2024, 1, 1)))
    return {"profiles": profiles, "posts": counted, "comments": comments, "reactions": reactions, "saves": saves, "follows": follows}


SOCIAL = """
p AS (SELECT conv_id AS post_id, conv_id * 3 % 37 AS author_id FROM conversations WHERE turn = 0), c AS (SELECT conv_id AS post_id, conv_id * 1000 + turn AS comment_id, (conv_id * 1000 + turn) % 37 AS author_id FROM conversations WHERE turn > 0),
r AS (SELECT DISTINCT post_id, (comment_id * 7 + post_id) % 37 AS user_id FROM c), s AS (SELECT post_id, (post_id + 1) % 37 AS user_id FROM p WHERE post_id % 2 = 0), f AS (SELECT DISTINCT c_custkey % 37 AS follower_id, (c_custkey * 5 + 1) % 37 AS followed_id FROM customer),
u AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey < 37), d AS (SELECT post_id FROM p WHERE author_id % 5 = 2),
lc AS (SELECT * FROM c WHERE author_id % 5 = 2 OR post_id IN (SELECT post_id FROM d)), lr AS (SELECT * FROM r WHERE user_id % 5 = 2 OR post_id IN (SELECT post_id FROM d)), ls AS (SELECT * FROM s WHERE user_id % 5 = 2 OR post_id IN (SELECT post_id FROM d))"""


def leaving(spark):
    return spark.range(0, 60).select(F.col("id").alias("user_id")).filter(GONE)


@query(
    f"""WITH {SOCIAL} SELECT post_id, author_id, (SELECT count(*) FROM c WHERE c.post_id = p.post_id AND author_id % 5 <> 2) AS comment_count, (SELECT count(*) FROM r WHERE r.post_id = p.post_id AND user_id % 5 <> 2) AS reaction_count,
(SELECT count(*) FROM s WHERE s.post_id = p.post_id AND user_id % 5 <> 2) AS save_count, post_id IN (SELECT post_id FROM lc UNION ALL SELECT post_id FROM lr UNION ALL SELECT post_id FROM ls) AS touched FROM p WHERE author_id % 5 <> 2"""
)
def posts_after_leaving(spark, sf_dir):
    """The counters move by what was deleted; the SQL counts them anew."""
    after, _ = accounts.left(social(spark, sf_dir), leaving(spark), NOW)
    return after["posts"].select("post_id", "author_id", "comment_count", "reaction_count", "save_count", (F.col("updated_at") == F.lit(NOW)).alias("touched"))


@query(
    f"""WITH {SOCIAL} SELECT * FROM (SELECT 'profiles' AS "table", user_id::VARCHAR AS key FROM u WHERE user_id % 5 = 2 UNION ALL SELECT 'posts', post_id::VARCHAR FROM d UNION ALL SELECT 'follows', follower_id || '>' || followed_id FROM f WHERE follower_id % 5 = 2 OR followed_id % 5 = 2
UNION ALL SELECT 'comments', comment_id::VARCHAR FROM lc UNION ALL SELECT 'reactions', post_id || ':' || user_id FROM lr UNION ALL SELECT 'saves', post_id || ':' || user_id FROM ls)"""
)
def deleted_with_users(spark, sf_dir):
    return accounts.left(social(spark, sf_dir), leaving(spark), NOW)[1]


@query(
    """WITH u AS (SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN ' ' || c_name || ' ' WHEN 1 THEN 'x' WHEN 2 THEN 'a' || chr(8203) || 'b' WHEN 3 THEN 'a much too long nickname for anyone' END AS asked FROM customer)
SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'kept' WHEN user_id % 5 = 0 AND length(trim(asked)) BETWEEN 2 AND 20 THEN trim(asked) END AS nickname FROM u"""
)
def profiles_of_new_users(spark, sf_dir):
    k = F.col("c_custkey")
    asked = F.when(k % 5 == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).when(k % 5 == 1, "x").when(k % 5 == 2, "a​b").when(k % 5 == 3, "a much too long nickname for anyone")
    users = table(spark, sf_dir, "customer").select(k.alias("user_id"), asked.alias("nickname"))
    known = users.filter("user_id % 4 = 0").select("user_id", F.lit("kept").alias("nickname"), F.lit(NOW).alias("updated_at"))
    return accounts.bootstrapped(known, users.unionByName(users.limit(3)), NOW).select("user_id", "nickname")


BUCKETS = 8


def batches(spark, sf_dir):
    """Yesterday's postings, and today's: every fifth says more, every ninth is gone, every seventh is new today."""
    p = skill_queries.postings(spark, sf_dir)
    before = p.filter("posting_id % 7 <> 3")
    after = p.filter("posting_id % 9 <> 4").withColumn("body", F.when(F.col("posting_id") % 5 == 0, F.concat("body", F.lit("\nRequirements\nTerraform and Kafka"))).otherwise(F.col("body")))
    return before, after


def synced(spark, sf_dir):
    before, after = batches(spark, sf_dir)
    state = resync.stored(before.select("posting_id", resync.digest("title", "body").alias("digest")), "posting_id", BUCKETS, "state")
    mentions = resync.stored(skill_mentions.extract(before, "posting_id", "title", None, "body").select(*resync.MENTIONS), "posting_id", BUCKETS, "mentions")
    return resync.resynced(spark, state, mentions, after, BUCKETS)


@query("SELECT posting_id, change FROM (SELECT doc_id AS posting_id, CASE WHEN doc_id % 9 = 4 THEN CASE WHEN doc_id % 7 <> 3 THEN 'gone' END WHEN doc_id % 7 = 3 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' END AS change FROM documents) WHERE change IS NOT NULL")
def resync_changes(spark, sf_dir):
    return synced(spark, sf_dir)[2]


LATER = skill_queries.POSTED.replace(" AS body FROM documents)", " || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Requirements' || chr(10) || 'Terraform and Kafka' ELSE '' END AS body FROM documents WHERE doc_id % 9 <> 4)")


@query("WITH " + skill_queries.blocks_sql(skill_queries.lines_sql("doc_id", "title", "body", LATER)) + f", {skill_queries.best_sql()} SELECT key AS posting_id, skill, requirement_type, confidence, sha256(text) AS evidence_sha256 FROM k")
def resync_mentions(spark, sf_dir):
    """After the batch the mentions are those of a whole extraction."""
    return synced(spark, sf_dir)[1].select("posting_id", "skill", "requirement_type", "confidence", F.sha2("evidence_text", 256).alias("evidence_sha256"))
