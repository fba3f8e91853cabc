"""Accounts: profiles of new users, and what goes with a user who leaves.

Deletions spread along the references between the tables: what a user wrote,
what others wrote under it, and the counters of posts that stay.  Each step is an
anti or semi join on the reference, so the cost goes with the rows that name a
deleted one; counters move by what was deleted and are not counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.community import adjusted

# Characters that take no space and that no name may hold.
UNSEEN = r"\p{Cntrl}|[​‌‍⁠﻿]"
#: Which table's rows a counter of posts counts.
COUNTED = {"comment_count": "comments", "reaction_count": "reactions", "save_count": "saves"}


def nickname(asked: Column) -> Column:
    """A name of 2 to 20 characters without control or unseen ones, else none."""
    name = F.trim(F.coalesce(asked, F.lit("")))
    return F.when(F.length(name).between(2, 20) & ~name.rlike(UNSEEN), name)


def bootstrapped(profiles: DataFrame, users: DataFrame, now) -> DataFrame:
    """``profiles`` (user_id, nickname, updated_at) with a row for every new user (user_id, nickname asked for); who has one keeps it."""
    new = users.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("nickname").alias("asked")).join(profiles.select("user_id"), "user_id", "left_anti")
    return profiles.unionByName(new.select("user_id", nickname(F.col("asked")).alias("nickname"), F.lit(now).cast("timestamp").alias("updated_at")))


def left(tables: dict[str, DataFrame], gone: DataFrame, now) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after the users of ``gone`` (user_id) left, and the feed of what was deleted: (table, key).

    ``tables``: profiles (user_id), posts (post_id, author_id, counters,
    updated_at), comments (comment_id, post_id, author_id), reactions and saves
    (post_id, user_id), follows (follower_id, followed_id).  Users that are not
    there change nothing.
    """
    users = gone.select("user_id").distinct()
    posts, out, feed = tables["posts"], {}, []
    by = lambda column: users.withColumnRenamed("user_id", column)
    dead = posts.join(by("author_id"), "author_id", "left_semi").select("post_id")

    def split(name: str, key: Column, *references: DataFrame) -> DataFrame:
        """Keeps the rows that name nothing deleted; returns the others."""
        rows, lost = tables[name], F.lit(False)
        for i, ref in enumerate(references):
            on = ref.columns[0]
            rows = rows.join(ref.select(on, F.lit(True).alias(f"_{i}")), on, "left")
            lost = lost | F.coalesce(f"_{i}", F.lit(False))
        marks = [f"_{i}" for i in range(len(references))]
        out[name] = rows.filter(~lost).drop(*marks).select(tables[name].columns)
        deleted = rows.filter(lost).drop(*marks)
        feed.append(deleted.select(F.lit(name).alias("table"), key.cast("string").alias("key")))
        return deleted

    split("profiles", F.col("user_id"), users)
    split("posts", F.col("post_id"), by("author_id"))
    split("follows", F.concat_ws(">", "follower_id", "followed_id"), by("follower_id"), by("followed_id"))
    lost = {
        "comments": split("comments", F.col("comment_id"), by("author_id"), dead),
        "reactions": split("reactions", F.concat_ws(":", "post_id", "user_id"), users, dead),
        "saves": split("saves", F.concat_ws(":", "post_id", "user_id"), users, dead),
    }
    kept = out["posts"]
    moved = F.lit(False)
    for counter, name in COUNTED.items():
        kept = kept.join(lost[name].groupBy("post_id").agg(F.count("*").alias("_n")), "post_id", "left")
        kept = kept.withColumn(counter, adjusted(F.col(counter), -F.coalesce("_n", F.lit(0)))).withColumn(f"_{counter}", F.col("_n").isNotNull()).drop("_n")
        moved = moved | F.col(f"_{counter}")
    out["posts"] = kept.withColumn("updated_at", F.when(moved, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))).select(posts.columns)
    every = feed[0]
    for f in feed[1:]:
        every = every.unionByName(f)
    return out, every
