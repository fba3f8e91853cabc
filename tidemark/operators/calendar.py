"""Hiring calendar: deadlines in a range of local days, summary, active companies, month grid."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import local_date, local_midnight


def in_days(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Rows whose instant lies in the local days from ``start`` up to, not including, ``end``."""
    return df.filter((F.col(column) >= local_midnight(F.lit(start))) & (F.col(column) < local_midnight(F.lit(end))))


def deadlines(postings: DataFrame, start: date, end: date, limit: int) -> DataFrame:
    open_ = in_days(postings.filter(F.col("status") == "open"), "closes_at", start, end)
    return open_.orderBy("closes_at", F.desc("first_seen_at"), "posting_id").limit(limit)


def summary(postings: DataFrame, start: date, end: date, now) -> DataFrame:
    """Deadlines in the range, closing within a week, undated, and companies that hire: one pass."""
    now = F.lit(now)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    closes = F.col("closes_at")
    return postings.filter(F.col("status") == "open").agg(
        n((closes >= local_midnight(F.lit(start))) & (closes < local_midnight(F.lit(end)))).alias("deadlines"),
        n((closes >= now) & (closes < now + F.expr("INTERVAL 7 DAYS"))).alias("closing_7d"),
        n(closes.isNull()).alias("undated"),
        F.countDistinct("company_id").alias("companies"),
    )


def active_companies(postings: DataFrame, now, days: int, limit: int = 12) -> DataFrame:
    """Companies by new postings of the last ``days``, with their next deadline and latest posting."""
    now = F.lit(now)
    new = (F.col("first_seen_at") >= now - F.make_interval(days=F.lit(days))) & (F.col("first_seen_at") <= now)
    groups = postings.filter(F.col("status") == "open").groupBy("company_id", "company_name").agg(
        F.sum(F.when(new, 1).otherwise(0)).alias("new_postings"), F.min(F.when(F.col("closes_at") >= now, F.col("closes_at"))).alias("nearest_deadline"), F.max("first_seen_at").alias("latest"), F.count("*").alias("open_postings")
    )
    return groups.filter("new_postings > 0").orderBy(F.desc("new_postings"), F.desc("latest"), "company_name").limit(limit)


def month_grid(postings: DataFrame, year: int, month: int) -> DataFrame:
    """The 42 days from the Monday on or before the month's first, with deadlines and openings per local day."""
    first = date(year, month, 1)
    start = first - timedelta(days=first.weekday())
    end = start + timedelta(days=42)
    days = postings.sparkSession.range(42).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    open_ = postings.filter(F.col("status") == "open")
    per = lambda c, name: in_days(open_, c, start, end).groupBy(local_date(F.col(c)).alias("day")).agg(F.count("*").alias(name))
    grid = days.join(per("closes_at", "deadlines"), "day", "left").join(per("first_seen_at", "opened"), "day", "left").fillna(0, ["deadlines", "opened"])
    return grid.withColumn("in_month", F.month("day") == month)
