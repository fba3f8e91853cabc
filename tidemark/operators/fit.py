"""Fit of owned skills to open postings: coverage, branches by domain, next skills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.market import top


def matched_postings(found: DataFrame, owned: Sequence[str], skill_domains: DataFrame, requested: Sequence[str] = ()) -> DataFrame:
    """One row per posting that shares a skill with ``owned``: covered, missing_required, missing_preferred, required_total, domains.

    A posting's domains are those of what is missing, else of what is covered;
    with requested domains, postings outside them are left out.
    ``skill_domains``: skill, domains (array).
    """
    mine = F.array(*map(F.lit, owned))
    rows = found.join(skill_domains, "skill", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
    owns = F.col("skill").isin(*owned)
    kind = F.col("requirement_type")
    lacks = ~owns & kind.isin("required", "preferred")
    pick = lambda c, v: F.array_sort(F.collect_set(F.when(c, F.col(v))))
    per = rows.groupBy("posting_id").agg(
        pick(owns, "skill").alias("covered"),
        pick(~owns & (kind == "required"), "skill").alias("missing_required"),
        pick(~owns & (kind == "preferred"), "skill").alias("missing_preferred"),
        F.sum(F.when(kind == "required", 1).otherwise(0)).alias("required_total"),
        F.sum(F.when(owns & (kind == "required"), 1).otherwise(0)).alias("covered_required"),
        F.array_distinct(F.flatten(F.collect_list(F.when(lacks, F.col("domains"))))).alias("missing_domains"),
        F.array_distinct(F.flatten(F.collect_list(F.when(owns, F.col("domains"))))).alias("covered_domains"),
    ).filter(F.size("covered") > 0)
    domains = F.when(F.size("missing_domains") > 0, F.col("missing_domains")).otherwise(F.col("covered_domains"))
    if requested:
        domains = F.array_intersect(domains, F.array(*map(F.lit, requested)))
    per = per.withColumn("domains", F.array_sort(domains)).drop("missing_domains", "covered_domains")
    return per.filter(F.size("domains") > 0) if requested else per


def coverage(matched: DataFrame) -> DataFrame:
    """Matching postings, and those with at least half of their required skills covered."""
    strong = (F.col("required_total") > 0) & (2 * F.col("covered_required") >= F.col("required_total"))
    return matched.agg(F.count("*").alias("matching_postings"), F.coalesce(F.sum(F.when(strong, 1).otherwise(0)), F.lit(0)).alias("strong_fit_postings"))


def missing(matched: DataFrame, skill_domains: DataFrame, requested: Sequence[str] = ()) -> DataFrame:
    """(posting_id, domains, skill, kind, skill_domains) of each missing skill, within the requested domains."""
    part = lambda c, k: matched.select("posting_id", "domains", F.explode(c).alias("skill"), F.lit(k).alias("kind"))
    rows = part("missing_required", "required").unionByName(part("missing_preferred", "preferred")).join(skill_domains.select("skill", F.col("domains").alias("skill_domains")), "skill")
    if requested:
        rows = rows.filter(F.arrays_overlap("skill_domains", F.array(*map(F.lit, requested))))
    return rows


def next_skills(missing_: DataFrame, shortlist: int = 20, limit: int = 10) -> DataFrame:
    """The most supported missing skills, of these the most required: two cuts, in this order."""
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    counts = missing_.groupBy("skill").agg(n("required").alias("required_count"), n("preferred").alias("preferred_count"), F.count("*").alias("support"))
    return counts.orderBy(F.desc("support"), "skill").limit(shortlist).orderBy(F.desc("required_count"), F.desc("support"), "skill").limit(limit)


def branches(matched: DataFrame, skill_domains: DataFrame, requested: Sequence[str] = (), limit: int = 10) -> DataFrame:
    """Per domain: supporting postings, covered skills, the leading missing required and preferred skills; requested domains appear even with none."""
    support = matched.select(F.explode("domains").alias("domain")).groupBy("domain").agg(F.count("*").alias("supporting_postings"))
    if requested:
        all_ = matched.sparkSession.createDataFrame([(d,) for d in requested], "domain string")
        support = all_.join(support, "domain", "left").fillna({"supporting_postings": 0})
    by_domain = lambda rows: rows.withColumn("domain", F.explode(F.array_intersect("domains", "skill_domains")))
    covered = matched.select("posting_id", "domains", F.explode("covered").alias("skill")).join(skill_domains.select("skill", F.col("domains").alias("skill_domains")), "skill")
    covered = by_domain(covered).groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("skill")), ",").alias("covered_skills"))
    counts = by_domain(missing(matched, skill_domains)).groupBy("domain", "kind", "skill").agg(F.count("*").alias("n"))
    lead = top(counts, ["domain", "kind"], limit, F.desc("n"), F.asc("skill"))
    lists = lambda k: lead.filter(F.col("kind") == k).groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))), lambda x: x["skill"]), ",").alias(f"missing_{k}"))
    out = support.join(covered, "domain", "left").join(lists("required"), "domain", "left").join(lists("preferred"), "domain", "left")
    return out.fillna({"covered_skills": "", "missing_required": "", "missing_preferred": ""})
