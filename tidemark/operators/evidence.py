"""Skill evidence: the best mention per posting and skill, and the confirmed evidence of open postings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least confidence of confirmed evidence.
CONFIRMED = 0.80


def requirement_rank(c: Column) -> Column:
    return F.when(c == "required", 3).when(c == "preferred", 2).otherwise(1)


#: Mentions that a task holds at most, where their number is known: what it sorts and counts by is some 400 bytes a mention.
ROWS = 500_000


def tasks(df: DataFrame, rows: int | None) -> int | None:
    """The tasks that ``rows`` mentions are dealt to; None if they are few, and the session's settings do."""
    n = math.ceil((rows or 0) / ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def best_mentions(mentions: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per (posting_id, skill): confirmed first, then the stronger requirement; an unknown requirement is unspecified.

    What is left undecided reaches no output.  The order is one small number, so
    the maximum stays in a hash aggregate; mentions are dealt by posting, so that
    what joins postings next finds its rows in place.  A posting's mentions are
    few and hardly repeat: combining them before the shuffle would not pay.
    ``rows`` is about how many there are: many are dealt to more tasks, so that
    one task's share stays the same; few are left to the session's settings.
    """
    n = tasks(mentions, rows)
    dealt = mentions.repartition(n, "posting_id") if n else mentions.repartition("posting_id")
    order = F.when(F.col("confirmed"), 4).otherwise(0) + requirement_rank(F.col("requirement_type"))
    best = dealt.groupBy("posting_id", "skill", "category").agg(F.max(order).alias("b"))
    kind = F.when(F.col("b") % 4 == 3, "required").when(F.col("b") % 4 == 2, "preferred").otherwise("unspecified")
    return best.select("posting_id", "skill", "category", kind.alias("requirement_type"), (F.col("b") >= 4).alias("confirmed"))


def confirmed_open(evidence: DataFrame, postings: DataFrame, career_type: str | None = None) -> DataFrame:
    """Confirmed evidence joined to its open posting."""
    open_ = postings.filter(F.col("status") == "open")
    if career_type:
        open_ = open_.filter(F.col("career_type") == career_type)
    return evidence.filter("confirmed").join(open_, "posting_id")


def in_category(found: DataFrame, category: str) -> DataFrame:
    """Postings that have a skill of the category, with all their skills."""
    ids = found.filter(F.col("category") == category).select("posting_id").distinct()
    return found.join(ids, "posting_id", "left_semi")


def skill_groups(found: DataFrame) -> DataFrame:
    """Per posting three sorted arrays; an unknown requirement is unspecified."""
    kind = F.when(F.col("requirement_type").isin("required", "preferred"), F.col("requirement_type")).otherwise("unspecified")
    pick = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("skill")))).alias(f"{k}_skills")
    return found.withColumn("kind", kind).groupBy("posting_id").agg(pick("required"), pick("preferred"), pick("unspecified"), F.sort_array(F.collect_set("category")).alias("categories"))


def resync(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """What changes ``current`` skills of re-extracted postings into ``fresh``: action insert, update or delete per (posting_id, skill)."""
    c, f = current.alias("c"), fresh.alias("f")
    both = c.join(f, ["posting_id", "skill"], "full")
    fields = [n for n in fresh.columns if n not in ("posting_id", "skill")]
    same = F.lit(True)
    for n in fields:
        same = same & F.col(f"c.{n}").eqNullSafe(F.col(f"f.{n}"))
    action = F.when(F.col(f"c.{fields[0]}").isNull(), "insert").when(F.col(f"f.{fields[0]}").isNull(), "delete").when(~same, "update")
    return both.select("posting_id", "skill", action.alias("action"), *[F.col(f"f.{n}").alias(n) for n in fields]).filter("action is not null")
