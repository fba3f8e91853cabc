"""Market questions over confirmed evidence: demand, pairs, fields, companies, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import monday


def _count(condition):
    return F.sum(F.when(condition, 1).otherwise(0))


def skill_stats(found: DataFrame, limit: int | None = 500) -> DataFrame:
    """Demand per skill: postings, companies, and postings by requirement.

    ``found`` has one row per (posting, skill), so rows are postings and only
    companies need a distinct count.
    """
    by = lambda k: _count(F.col("requirement_type") == k).alias(f"{k}_count")
    stats = found.groupBy("skill", "category").agg(F.count("*").alias("posting_count"), F.countDistinct("company_id").alias("company_count"), by("required"), by("preferred"), by("unspecified"))
    return stats.orderBy(F.desc("posting_count"), "skill").limit(limit) if limit else stats


def skill_total(found: DataFrame) -> DataFrame:
    return found.select("skill", "category").distinct().agg(F.count("*").alias("total"))


def relative_bars(stats: DataFrame, count: str = "posting_count") -> DataFrame:
    """``bar``: percent of the largest count, halves rounded up."""
    top = F.greatest(F.lit(1), F.max(count).over(Window.partitionBy(F.lit(0))))
    return stats.withColumn("bar", F.floor(F.lit(100.0) * F.col(count) / top + 0.5).cast("long"))


def pairs(found: DataFrame, strength: dict[str, int] | None = None) -> DataFrame:
    """Skills of one posting, each unordered pair once, with support, required pairs and the summed strength of both (in tenths).

    A posting has a bounded number of skills; the pairs are made inside its row,
    so the posting's skills are gathered once and no self-join is needed.
    """
    strength = strength or {"required": 10, "preferred": 7, "unspecified": 4}
    weight = F.coalesce(*(F.when(F.col("requirement_type") == k, v) for k, v in strength.items()), F.lit(4))
    skills = found.groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct("skill", weight.alias("w"), (F.col("requirement_type") == "required").alias("r")))).alias("s"))
    rest = lambda x, i: F.slice(F.col("s"), i + 2, F.greatest(F.size("s") - i - 1, F.lit(0)))
    both = F.flatten(F.transform("s", lambda x, i: F.transform(rest(x, i), lambda y: F.struct(x["skill"].alias("source"), y["skill"].alias("target"), (x["w"] + y["w"]).alias("w"), (x["r"] & y["r"]).alias("r")))))
    return skills.select("posting_id", F.explode(both).alias("p")).select("posting_id", "p.*").groupBy("source", "target").agg(F.count("*").alias("support"), F.sum("w").alias("strength"), _count(F.col("r")).alias("required_pairs"), F.min("posting_id").alias("first_posting"))


def supporting(found: DataFrame, n: int = 5) -> DataFrame:
    """(source, target, posting_ids): of each pair of skills the ``n`` smallest ids of postings with both.

    Pairs are made inside a posting's row.  The rank's limit is taken in every
    task before pairs are dealt, so at most n ids of a pair leave a task.
    """
    skills = found.groupBy("posting_id").agg(F.array_sort(F.collect_set("skill")).alias("s"))
    both = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.greatest(F.size("s") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    each = skills.select("posting_id", F.explode(both).alias("p")).select("posting_id", "p.*")
    least = each.withColumn("_r", F.row_number().over(Window.partitionBy("source", "target").orderBy("posting_id"))).filter(F.col("_r") <= n)
    return least.groupBy("source", "target").agg(F.array_sort(F.collect_list("posting_id")).alias("posting_ids"))


def market_fields(classified: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per domain: the field's counts, its five leading locations, its eight leading skills.

    ``classified``: posting_id, domain, company_id, career_type, location, one row per posting and domain.
    """
    newcomer = F.lower("career_type").isin("new_comer", "newcomer")
    experienced = F.lower("career_type") == "experienced"
    fields = classified.groupBy("domain").agg(
        F.count("*").alias("posting_count"),
        F.countDistinct("company_id").alias("company_count"),
        _count(newcomer).alias("new_comer"),
        _count(experienced).alias("experienced"),
        _count(~F.coalesce(newcomer | experienced, F.lit(False))).alias("mixed_or_unknown"),
    )
    fields = fields.withColumn("sample_status", F.when((F.col("posting_count") >= 10) & (F.col("company_count") >= 3), "comparable").otherwise("limited"))
    places = classified.filter(F.trim("location") != "").groupBy("domain", "location").agg(F.count("*").alias("posting_count"))
    places = top(places, "domain", 5, F.desc("posting_count"), F.asc("location"))
    skills = classified.select("posting_id", "domain", "company_id").join(found.select("posting_id", "skill"), "posting_id")
    skills = skills.groupBy("domain", "skill").agg(F.count("*").alias("posting_count"), F.countDistinct("company_id").alias("company_count"))
    return fields, places, top(skills, "domain", 8, F.desc("company_count"), F.desc("posting_count"), F.asc(F.lower("skill")))


def top(df: DataFrame, by: str | list[str], n: int, *order) -> DataFrame:
    """The first ``n`` rows of each group, with ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def company_profile(found: DataFrame, postings: DataFrame) -> DataFrame:
    """Per company: open postings, distinct skills and places, evidence by requirement, latest posting."""
    by = lambda k: _count(F.col("requirement_type") == k).alias(f"{k}_count")
    skills = found.groupBy("company_id").agg(F.countDistinct("skill").alias("skill_count"), by("required"), by("preferred"), by("unspecified"))
    jobs = postings.filter(F.col("status") == "open").groupBy("company_id").agg(F.count("*").alias("posting_count"), F.countDistinct("location").alias("location_count"), F.max("first_seen_at").alias("latest"))
    zero = {f"{k}_count": 0 for k in ("skill", "required", "preferred", "unspecified")}
    return jobs.join(skills, "company_id", "left").fillna(zero)


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per label; null and empty are unknown."""
    return df.groupBy(F.coalesce(F.when(F.col(label) != "", F.col(label)), F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


def company_skills(found: DataFrame) -> DataFrame:
    """Per company and skill (letter case aside) how many postings ask for it, by requirement, with ``rank`` in the company."""
    by = lambda k: _count(F.col("requirement_type") == k).alias(f"{k}_count")
    key = F.lower(F.trim("skill"))
    each = found.filter(key != "").groupBy("company_id", key.alias("skill_key")).agg(F.min(F.trim("skill")).alias("skill"), F.count("*").alias("posting_count"), by("required"), by("preferred"), by("unspecified"))
    order = Window.partitionBy("company_id").orderBy(F.desc("posting_count"), F.desc("required_count"), F.desc("preferred_count"), "skill_key")
    return each.withColumn("rank", F.row_number().over(order)).drop("skill_key")


def combinations(found: DataFrame, n: int = 3, selected: str = "") -> DataFrame:
    """The pairs of skills that most postings hold together, of those with the selected skill if one is named."""
    both = pairs(found)
    wanted = selected.strip().lower()
    if wanted:
        both = both.filter((F.lower("source") == wanted) | (F.lower("target") == wanted))
    return both.orderBy(F.desc("support"), F.concat_ws("::", "source", "target")).limit(n).select("source", "target", F.col("support").alias("posting_count"))


def company_groups(found: DataFrame, postings: DataFrame, skills: int = 5, url: str | None = None) -> DataFrame:
    """Search results by company: postings, the latest one (with its address, if ``url`` names the column), the leading skills in one string."""
    last = F.max(F.struct("first_seen_at", "posting_id", *([F.col(url).alias("url")] if url else [])))
    jobs = postings.filter(F.col("status") == "open").groupBy("company_id", "company_name").agg(F.count("*").alias("posting_count"), last.alias("last"))
    leading = top(found.groupBy("company_id", "skill").agg(F.count("*").alias("n")), "company_id", skills, F.desc("n"), F.asc("skill"))
    leading = leading.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))), lambda x: x["skill"]), ",").alias("top_skills"))
    more = [F.col("last.url").alias("source_url")] if url else []
    return jobs.join(leading, "company_id", "left").select("company_id", "company_name", "posting_count", F.col("last.posting_id").alias("latest_posting"), F.coalesce("top_skills", F.lit("")).alias("top_skills"), *more)


def weekly_trend(demand: DataFrame, weeks: int, skills: list[str] | None = None, minimum: int = 4) -> DataFrame:
    """Counts per skill for the last ``weeks`` weeks that have snapshots; skills a week lacks count 0; fewer than ``minimum`` weeks give no rows.

    ``demand``: observed_on, skill, posting_count.  A week is told by its last day.
    """
    days = demand.select("observed_on").distinct()
    collected = days.groupBy(monday(F.col("observed_on")).alias("week")).agg(F.max("observed_on").alias("observed_on"))
    ranked = collected.withColumn("age", F.row_number().over(Window.orderBy(F.desc("week")))).withColumn("all", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row per week
    last = ranked.filter((F.col("age") <= weeks) & (F.col("all") >= minimum)).select("week", "observed_on")
    wanted = demand.filter(F.col("skill").isin(*skills)) if skills else demand
    kept = last.agg(F.array_sort(F.collect_list(F.struct("week", "observed_on")))).scalar()  # at most ``weeks`` elements
    grid = wanted.select("skill").distinct().select("skill", F.explode(kept).alias("x")).select("skill", "x.week", "x.observed_on")
    return grid.join(wanted, ["observed_on", "skill"], "left").select("week", "skill", F.coalesce("posting_count", F.lit(0)).alias("posting_count"))


def trend_delta(series: DataFrame) -> DataFrame:
    """Per skill its latest count, the one before, and their difference."""
    w = Window.partitionBy("skill").orderBy("week")
    both = series.withColumn("before", F.lag("posting_count").over(w)).withColumn("age", F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("week"))))
    return both.filter("age = 1").select("skill", F.col("posting_count").alias("latest"), "before", (F.col("posting_count") - F.col("before")).alias("delta"))
