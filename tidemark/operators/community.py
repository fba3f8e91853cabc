"""Community posts: search, feeds, counters, notices, and the merges of a user's client state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rank import keyset


def search_posts(posts: DataFrame, query: str, after: tuple | None, limit: int | None) -> DataFrame:
    """A page of posts whose title, body or a tag holds the query (2 to 80 characters, else none), newest first."""
    q = " ".join(query.split()).lower()
    if not 2 <= len(q) <= 80:
        return posts.limit(0)
    hit = F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("body"), F.lit(q))
    if "tags" in posts.columns:
        hit = hit | F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q))), F.lit(False))
    return keyset(posts.filter(F.coalesce(hit, F.lit(False))), "created_at", "post_id", after, limit)


def following_posts(posts: DataFrame, follows: DataFrame, viewer, after: tuple | None, limit: int | None) -> DataFrame:
    mine = follows.filter(F.col("follower_id") == viewer).select(F.col("followed_id").alias("author_id"))
    return keyset(posts.join(mine, "author_id", "left_semi"), "created_at", "post_id", after, limit)


def saved_posts(posts: DataFrame, saves: DataFrame, viewer, after: tuple | None, limit: int | None) -> DataFrame:
    """The viewer's saved posts in the order of saving."""
    mine = saves.filter(F.col("user_id") == viewer).select("post_id", F.col("created_at").alias("saved_at"))
    return keyset(posts.join(mine, "post_id"), "saved_at", "post_id", after, limit)


def counters(posts: DataFrame, comments: DataFrame, reactions: DataFrame, saves: DataFrame) -> DataFrame:
    """Comment, reaction and save counts, counted from the rows themselves."""
    out = posts
    for name, rows in (("comment_count", comments), ("reaction_count", reactions), ("save_count", saves)):
        out = out.join(rows.groupBy("post_id").agg(F.count("*").alias(name)), "post_id", "left").fillna(0, [name])
    return out


def adjusted(counter, delta):
    """A counter after a change, never below 0."""
    return F.greatest(F.lit(0), counter + delta)


def notices(posts: DataFrame, comments: DataFrame, follows: DataFrame, sent: DataFrame) -> DataFrame:
    """Notices to a post's author about comments and to a user about followers: never about oneself, never twice."""
    c = comments.join(posts.select("post_id", F.col("author_id").alias("user_id")), "post_id").select("user_id", F.col("author_id").alias("actor_id"), F.concat(F.lit("comment:"), F.col("comment_id").cast("string")).alias("dedupe_key"))
    f = follows.select(F.col("followed_id").alias("user_id"), F.col("follower_id").alias("actor_id"), F.concat(F.lit("follow:"), F.col("follower_id").cast("string")).alias("dedupe_key"))
    new = c.unionByName(f).filter(F.col("user_id") != F.col("actor_id")).dropDuplicates(["user_id", "dedupe_key"])
    return new.join(sent.select("user_id", "dedupe_key"), ["user_id", "dedupe_key"], "left_anti")


def visible_to(rows: DataFrame, viewer, owner: str = "author_id", public: str | None = None) -> DataFrame:
    """Rows a viewer may read: own ones, and public ones where a column says so."""
    mine = F.col(owner) == viewer
    return rows.filter(mine | F.col(public) if public else mine)


def keep_last(df: DataFrame, user: str, values: str, limit: int = 24, longest: int = 200) -> DataFrame:
    """Per user the last ``limit`` distinct values of an array, each at its last place; empty and over-long ones dropped."""
    each = df.select(user, F.posexplode(values).alias("pos", "v")).withColumn("v", F.trim("v")).filter((F.col("v") != "") & (F.length("v") <= longest))
    last = each.groupBy(user, "v").agg(F.max("pos").alias("pos"))
    w = Window.partitionBy(user).orderBy(F.desc("pos"))
    kept = last.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    return kept.groupBy(user).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias(values))


def keep_first(df: DataFrame, user: str, values: str, limit: int = 100) -> DataFrame:
    """Per user distinct values without regard to case, the first spelling of each, sorted."""
    each = df.select(user, F.posexplode(values).alias("pos", "v")).withColumn("v", F.trim("v")).filter(F.col("v") != "")
    first = each.groupBy(user, F.lower("v").alias("key")).agg(F.min(F.struct("pos", "v")).alias("b"))
    w = Window.partitionBy(user).orderBy("b.pos")
    kept = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    return kept.groupBy(user).agg(F.array_sort(F.collect_list("b.v")).alias(values))


def merge_state(server: DataFrame, client: DataFrame, key: str, scalars: list[str], arrays: list[str], maps: list[str]) -> DataFrame:
    """Account state from two sides: the client's scalar if it is not empty, arrays server first, maps with the client's entries over the server's."""
    s, c = server.alias("s"), client.alias("c")
    both = s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"), "full")
    cols = [F.coalesce(f"s.{key}", f"c.{key}").alias(key)]
    cols += [F.coalesce(F.when(F.col(f"c.{n}") != "", F.col(f"c.{n}")), F.col(f"s.{n}")).alias(n) for n in scalars]
    empty = F.array().cast("array<string>")
    cols += [F.array_distinct(F.concat(F.coalesce(f"s.{n}", empty), F.coalesce(f"c.{n}", empty))).alias(n) for n in arrays]
    for n in maps:
        mine, theirs = F.col(f"c.{n}"), F.col(f"s.{n}")
        left = F.map_filter(theirs, lambda k, v: ~F.coalesce(F.map_contains_key(mine, k), F.lit(False)))
        cols.append(F.when(mine.isNull(), theirs).when(theirs.isNull(), mine).otherwise(F.map_concat(left, mine)).alias(n))
    return both.select(*cols)


def recent_topics(views: DataFrame, n: int = 8) -> DataFrame:
    """Per user the newest distinct posts."""
    latest = views.filter(F.col("post_id").isNotNull() & F.col("viewed_at").isNotNull()).groupBy("user_id", "post_id").agg(F.max("viewed_at").alias("viewed_at"))
    w = Window.partitionBy("user_id").orderBy(F.desc("viewed_at"), "post_id")
    return latest.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def lookup(saved: DataFrame, posts: DataFrame) -> DataFrame:
    """Saved ids (user_id, place, post_id) with whether the post is still there."""
    return saved.join(posts.select("post_id", F.lit(True).alias("_there")), "post_id", "left").withColumn("available", F.coalesce("_there", F.lit(False))).drop("_there")
