"""Community posts, feeds and client state, over conversations: turn 0 is a post, other turns are comments on it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import community, rank
from tidemark.plans.analog import POSTINGS, postings, sql, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


POSTS = "po AS (SELECT conv_id AS post_id, conv_id % 7 AS author_id, text AS body, substr(text, 1, 40) AS title, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id // 3 AS INT)) AS created_at FROM conversations WHERE turn = 0)"
COMMENTS = "co AS (SELECT conv_id AS post_id, conv_id * 1000 + turn AS comment_id, (conv_id + turn) % 7 AS author_id FROM conversations WHERE turn > 0)"


def posts(spark, sf_dir):
    k = F.col("conv_id")
    made = F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(hours=F.floor(k / 3).cast("int"))
    return table(spark, sf_dir, "conversations").filter("turn = 0").select(k.alias("post_id"), (k % 7).alias("author_id"), F.col("text").alias("body"), F.substring("text", 1, 40).alias("title"), made.alias("created_at"))


def comments(spark, sf_dir):
    k, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").filter("turn > 0").select(k.alias("post_id"), (k * 1000 + t).alias("comment_id"), ((k + t) % 7).alias("author_id"))


def follows(spark):
    return spark.createDataFrame([(1, 2), (1, 4), (2, 1), (3, 3), (5, 1)], "follower_id long, followed_id long")


def saves(spark, sf_dir):
    p = posts(spark, sf_dir).filter("post_id % 4 = 0")
    return p.select("post_id", (F.col("post_id") % 3).alias("user_id"), (F.to_timestamp(F.lit("2024-06-01")) - F.make_interval(mins=F.col("post_id").cast("int"))).alias("created_at"))


@query(sql("SELECT post_id, author_id FROM po WHERE (contains(lower(title), 'the') OR contains(lower(body), 'the')) AND (created_at < TIMESTAMP '2024-01-02' OR (created_at = TIMESTAMP '2024-01-02' AND post_id < 73)) ORDER BY created_at DESC, post_id DESC LIMIT 20", POSTS))
def community_search(spark, sf_dir):
    return community.search_posts(posts(spark, sf_dir), " The ", ("2024-01-02", 73), None).select("post_id", "author_id")


@query(sql("SELECT post_id, author_id FROM po WHERE author_id IN (2, 4) ORDER BY created_at DESC, post_id DESC LIMIT 10", POSTS))
def community_following(spark, sf_dir):
    return community.following_posts(posts(spark, sf_dir), follows(spark), 1, None, 10).select("post_id", "author_id")


@query(sql("SELECT post_id, author_id FROM po WHERE post_id % 4 = 0 AND post_id % 3 = 1 ORDER BY TIMESTAMP '2024-06-01' - to_minutes(CAST(post_id AS INT)) DESC, post_id DESC LIMIT 15", POSTS))
def community_saved(spark, sf_dir):
    return community.saved_posts(posts(spark, sf_dir), saves(spark, sf_dir), 1, None, 15).select("post_id", "author_id")


COUNTERS = """
cn AS (SELECT po.*, (SELECT count(*) FROM co WHERE co.post_id = po.post_id) AS comment_count, (SELECT count(*) FROM co WHERE co.post_id = po.post_id AND comment_id % 2 = 0) AS reaction_count,
  CASE WHEN post_id % 4 = 0 THEN 1 ELSE 0 END AS save_count FROM po)"""


def _counted(spark, sf_dir):
    c = comments(spark, sf_dir)
    return community.counters(posts(spark, sf_dir), c, c.filter("comment_id % 2 = 0"), saves(spark, sf_dir))


@query(sql("SELECT post_id, comment_count, reaction_count, save_count FROM cn", POSTS, COMMENTS, COUNTERS))
def community_counters(spark, sf_dir):
    return _counted(spark, sf_dir).select("post_id", "comment_count", "reaction_count", "save_count")


@query(sql("SELECT post_id, reaction_count + 2 * comment_count + save_count AS score FROM cn ORDER BY score DESC, created_at DESC, post_id LIMIT 25", POSTS, COMMENTS, COUNTERS))
def feed_popular(spark, sf_dir):
    rows = _counted(spark, sf_dir).withColumn("score", F.col("reaction_count") + 2 * F.col("comment_count") + F.col("save_count"))
    return rank.popular(rows, "popular").limit(25).select("post_id", "score")


TAB = "SELECT '{0}' AS tab, post_id, CAST(row_number() OVER (ORDER BY {1}) AS INT) AS place FROM cn {2} QUALIFY place <= 15"


@query(sql(" UNION ALL ".join((TAB.format("recommended", "post_id % 13, post_id", ""), TAB.format("following", "created_at DESC, post_id DESC", "WHERE author_id IN (2, 5)"), TAB.format("latest", "created_at DESC, post_id DESC", ""), TAB.format("popular", "reaction_count + 2 * comment_count + save_count DESC, created_at DESC, post_id", ""))), POSTS, COMMENTS, COUNTERS))
def feed_tabs(spark, sf_dir):
    rows = _counted(spark, sf_dir).withColumn("rank", F.struct((F.col("post_id") % 13).alias("a"), "post_id"))
    out = None
    for tab in ("recommended", "following", "latest", "popular"):
        first = rank.popular(rows, tab, (2, 5)).limit(15).withColumn("n", F.monotonically_increasing_id())
        one = first.select(F.lit(tab).alias("tab"), "post_id", F.row_number().over(Window.orderBy("n")).alias("place"))  # 15 rows
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("""SELECT DISTINCT po.author_id AS user_id, co.author_id AS actor_id, 'comment:' || comment_id AS dedupe_key FROM co JOIN po USING (post_id) WHERE po.author_id <> co.author_id AND comment_id % 5 <> 0
UNION ALL SELECT * FROM (VALUES (2, 1, 'follow:1'), (4, 1, 'follow:1'), (1, 2, 'follow:2'), (1, 5, 'follow:5'))""", POSTS, COMMENTS))
def community_notices(spark, sf_dir):
    sent = comments(spark, sf_dir).filter("comment_id % 5 = 0").join(posts(spark, sf_dir).select("post_id", F.col("author_id").alias("user_id")), "post_id").select("user_id", F.concat(F.lit("comment:"), F.col("comment_id").cast("string")).alias("dedupe_key"))
    return community.notices(posts(spark, sf_dir), comments(spark, sf_dir), follows(spark), sent).select("user_id", "actor_id", "dedupe_key")


FEED = """
a AS (SELECT 'post' AS kind, post_id AS item, (row_number() OVER (ORDER BY created_at DESC, post_id DESC) - 1) * 3 AS slot FROM po),
j AS (SELECT 'job' AS kind, posting_id AS item, r // 2 * 3 + 1 + r % 2 AS slot FROM (SELECT posting_id, row_number() OVER (ORDER BY first_seen_at DESC, posting_id DESC) - 1 AS r FROM p WHERE status = 'open'))"""


@query(sql("SELECT kind, item FROM (SELECT * FROM a UNION ALL SELECT * FROM j) ORDER BY slot LIMIT 30", POSTS, POSTINGS, FEED))
def feed_interleave(spark, sf_dir):
    newest = lambda df, t, k, n: df.orderBy(F.desc(t), F.desc(k)).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(t), F.desc(k))) - 1).withColumn("item", F.col(k))
    mine = newest(posts(spark, sf_dir), "created_at", "post_id", 30)
    jobs = newest(postings(spark, sf_dir).filter("status = 'open'"), "first_seen_at", "posting_id", 30)
    return rank.feed(mine, jobs, 30).select("kind", "item")


#: Tags by number, and whether they are fine.
TAGS = ((["spark", "sql"], True), (["a", "b", "c", "d"], True), (["Data", "data"], False), ([" padded"], False), ([], True), (["x" * 41], False), (["tab\tbed"], False), (["한글", "ai"], True), ([""], False))


@query(f"SELECT conv_id, {[ok for _, ok in TAGS]}[conv_id % 9 + 1] AND NOT (conv_id % 4 = 0 AND conv_id % 9 = 1) AS valid FROM conversations WHERE turn = 0")
def tag_validation(spark, sf_dir):
    """Every fourth post has one more tag, its number: too many for those that have four."""
    k = F.col("conv_id")
    tags = F.element_at(F.array(*(F.array(*map(F.lit, t)).cast("array<string>") for t, _ in TAGS)), (k % 9 + 1).cast("int"))
    tags = F.when(k % 4 == 0, F.array_append(tags, k.cast("string"))).otherwise(tags)
    return table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", tx.tags_valid(tags).alias("valid"))


@query("SELECT user_id, item_count, last_item FROM (SELECT user_id, count(*) AS item_count, arg_max(v, pos) AS last_item FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS r FROM (SELECT user_id, (event_id % 90)::VARCHAR AS v, max(event_id) AS pos FROM events WHERE event_type = 'view' GROUP BY 1, 2)) WHERE r <= 24 GROUP BY 1)")
def saved_jobs_keep_last(spark, sf_dir):
    views = table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id"))), lambda x: (x["event_id"] % 90).cast("string")).alias("ids"))
    kept = community.keep_last(views, "user_id", "ids")
    return kept.select("user_id", F.size("ids").cast("long").alias("item_count"), F.element_at("ids", -1).alias("last_item"))


@query("SELECT user_id, post_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, post_id) AS place FROM (SELECT user_id, event_id % 50 AS post_id, max(ts) AS seen FROM events WHERE event_type = 'click' GROUP BY 1, 2)) WHERE place <= 8")
def recent_topics(spark, sf_dir):
    views = table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", (F.col("event_id") % 50).alias("post_id"), F.col("ts").alias("viewed_at"))
    return community.recent_topics(views).select("user_id", "post_id", "place")


@query("SELECT post_id, available FROM (SELECT DISTINCT event_id % 150 AS post_id FROM events WHERE user_id = 3) LEFT JOIN (SELECT conv_id AS post_id, true AS t FROM conversations WHERE turn = 0) USING (post_id) CROSS JOIN LATERAL (SELECT coalesce(t, false) AS available)")
def saved_library_lookup(spark, sf_dir):
    saved = table(spark, sf_dir, "events").filter("user_id = 3").select((F.col("event_id") % 150).alias("post_id")).distinct()
    return community.lookup(saved, posts(spark, sf_dir)).select("post_id", "available")


@query(
    """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'lead ' || c_custkey END AS role, ['a', 'b' || c_custkey % 5] AS sk, MAP {'x': c_custkey::VARCHAR, 'y': '2'} AS st FROM customer WHERE c_custkey % 4 <> 1),
c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new' END AS role, ['b' || c_custkey % 3, 'd'] AS sk, MAP {'y': '3', 'z' || c_custkey % 2: '4'} AS st FROM customer WHERE c_custkey % 4 <> 2)
SELECT coalesce(s.k, c.k) AS user_id, CASE WHEN c.role <> '' THEN c.role ELSE s.role END AS role, array_to_string(list_filter(list_concat(coalesce(s.sk, []), coalesce(c.sk, [])), lambda x, i: list_position(list_concat(coalesce(s.sk, []), coalesce(c.sk, [])), x) = i), ',') AS skills,
  array_to_string(list_sort(list_concat(CASE WHEN s.k IS NULL THEN [] ELSE ['x=' || (s.k::VARCHAR)] END, CASE WHEN c.k IS NOT NULL THEN ['y=3', 'z' || (c.k % 2) || '=4'] ELSE ['y=2'] END)), ',') AS stages FROM s FULL JOIN c ON s.k = c.k"""
)
def account_state_merge(spark, sf_dir):
    """What the server and a device know of a customer; either may know nothing."""
    k = F.col("c_custkey")
    word = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    state = lambda role, skills, stages: table(spark, sf_dir, "customer").select(k.alias("user_id"), role.alias("role"), skills.alias("skills"), stages.alias("stages"))
    server = state(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("lead "), k.cast("string"))), F.array(F.lit("a"), word("b", 5)), F.create_map(F.lit("x"), k.cast("string"), F.lit("y"), F.lit("2"))).filter("user_id % 4 <> 1")
    client = state(F.when(k % 2 == 0, "").otherwise("new"), F.array(word("b", 3), F.lit("d")), F.create_map(F.lit("y"), F.lit("3"), word("z", 2), F.lit("4"))).filter("user_id % 4 <> 2")
    merged = community.merge_state(server, client, "user_id", ["role"], ["skills"], ["stages"])
    pairs = F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("user_id", "role", F.array_join("skills", ",").alias("skills"), F.array_join(pairs, ",").alias("stages"))
