"""Sources: directory, monitor, reports, body quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapsed
from tidemark.operators.market import top

MIN_BODY = 120


def _n(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def runnable() -> Column:
    return (F.col("status") == "allowed") & (F.col("policy_status") == "allowed")


def health(since) -> Column:
    """blocked > stopped > pending policy > failing > healthy > stale > pending."""
    last = F.coalesce(F.col("last_success_at") >= F.lit(since), F.lit(False))
    either = lambda v: (F.col("status") == v) | (F.col("policy_status") == v)
    return (
        F.when(either("blocked"), "blocked").when(either("stopped"), "stopped").when(F.col("policy_status") != "allowed", "pending").when(F.coalesce(F.col("last_error_code"), F.lit("")) != "", "failing")
        .when(runnable() & last, "healthy").when(runnable(), "stale").otherwise("pending")
    )


def preparation_reason() -> Column:
    """Why a source does not run; null if it does."""
    return F.when(runnable(), F.lit(None).cast("string")).when(F.col("policy_status") == "review", "policy_review").when(F.col("status") == "needs_browser", "access_limited").when(F.col("status") == "needs_connector", "connector_pending").otherwise("policy_review")


def activity_status(collecting: Column, open_postings: Column, last: Column, now: Column, hours: int = 48) -> Column:
    stale = last.isNull() | (last < now - F.make_interval(hours=F.lit(hours)))
    return F.when(~collecting, "preparing").when(stale, "attention").when(open_postings > 0, "active").otherwise("quiet")


def activity(postings: DataFrame, since, with_skill: DataFrame | None = None) -> DataFrame:
    """Per source: open, new, seen, closed and technical postings.  ``with_skill``: ids of postings with a skill of any confidence."""
    if with_skill is not None:
        postings = postings.join(with_skill.select("posting_id").distinct().withColumn("has_skill", F.lit(True)), "posting_id", "left")
    has = F.coalesce(F.col("has_skill"), F.lit(False)) if with_skill is not None else F.lit(False)
    is_open, after = F.col("status") == "open", lambda c: F.coalesce(F.col(c) >= F.lit(since), F.lit(False))
    return postings.groupBy("source_id").agg(
        _n(is_open).alias("open_postings"), _n(after("first_seen_at")).alias("new_postings"), _n(after("last_seen_at")).alias("seen_postings"), _n((F.col("status") == "closed") & after("last_verified_at")).alias("closed_postings"), _n(is_open & has).alias("tech_open_postings")
    )


def monitor(sources: DataFrame, active: DataFrame, since) -> DataFrame:
    """Every source with its health, activity and share of technical postings (percent, halves up)."""
    counts = ["open_postings", "new_postings", "seen_postings", "closed_postings", "tech_open_postings"]
    items = sources.join(active, "source_id", "left").fillna(0, counts)
    share = F.when(F.col("open_postings") > 0, F.floor(F.lit(100.0) * F.col("tech_open_postings") / F.col("open_postings") + 0.5)).otherwise(0)
    return items.withColumn("health", health(since)).withColumn("tech_percent", share.cast("long"))


def family_health(items: DataFrame) -> DataFrame:
    """Per connector family, and in total (``is_total``; a source may have a null family): sources by health and sums, in one aggregation."""
    kinds = [_n(F.col("health") == k).alias(k) for k in ("healthy", "stale", "failing", "blocked", "stopped", "pending")]
    return items.rollup("family").agg((F.grouping("family") == 1).alias("is_total"), F.count("*").alias("sources"), *kinds, F.sum("open_postings").alias("open_postings"), F.sum("tech_open_postings").alias("tech_open_postings"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) over several columns; null and empty count as unknown."""
    value = lambda c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit("unknown"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.*").groupBy("field", "value").agg(F.count("*").alias("n"))


def directory(sources: DataFrame, active: DataFrame, now) -> DataFrame:
    """One row per company: sources, open postings of collecting ones, freshness of runnable ones, preferred address.

    Blocked and stopped sources are hidden.
    """
    shown = sources.filter(~F.col("status").isin("blocked", "stopped")).join(active.select("source_id", "open_postings"), "source_id", "left").fillna(0, ["open_postings"])
    shown = shown.withColumn("collecting", runnable())
    best = F.max(F.struct(F.col("collecting").cast("int"), "open_postings", (-F.col("source_id")).alias("s"), "base_url"))
    groups = shown.groupBy("company_id", "company_name").agg(
        F.count("*").alias("sources"), F.max("collecting").alias("collecting"), F.sum(F.when(F.col("collecting"), F.col("open_postings")).otherwise(0)).alias("open_postings"), F.max(F.when(F.col("collecting"), F.col("last_success_at"))).alias("last_success_at"), best.alias("b"), F.min(preparation_reason()).alias("reason")
    )
    out = groups.withColumn("activity", activity_status(F.col("collecting"), F.col("open_postings"), F.col("last_success_at"), F.lit(now)))
    return out.select("company_id", "company_name", "sources", "collecting", "open_postings", "activity", F.when(F.col("collecting"), F.lit(None).cast("string")).otherwise(F.col("reason")).alias("reason"), F.col("b.base_url").alias("careers_url"))


def directory_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("collecting"), F.desc("open_postings"), F.lower("company_name"))


def body_quality(bodies: DataFrame, group: str, key: str, text: str, images: Column | None = None, examples: int = 3, with_skill: Column | None = None) -> DataFrame:
    """Per group: substantive, image-only and sparse bodies, those without a skill, and the first few sparse ids."""
    size = F.length(collapsed(F.coalesce(F.col(text), F.lit(""))))
    pictures = F.coalesce(images, F.lit(0)) if images is not None else F.lit(0)
    skilled = F.coalesce(with_skill, F.lit(False)) if with_skill is not None else F.lit(True)
    rows = bodies.select(group, key, (size >= MIN_BODY).alias("long"), (pictures > 0).alias("pictured"), skilled.alias("skilled"))
    sparse = ~F.col("long") & ~F.col("pictured")
    counts = rows.groupBy(group).agg(
        _n(F.col("long") | F.col("pictured")).alias("substantive"), _n(~F.col("long") & F.col("pictured")).alias("image_only"), _n(sparse).alias("sparse"), _n(~F.col("skilled")).alias("zero_skill")
    )
    # The few examples come from a ranked cut, not from gathering a group's ids.
    first = top(rows.filter(sparse).select(group, key), group, examples, F.asc(key)).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k.cast("string")), ",").alias("examples"))
    return counts.join(first, group, "left").fillna({"examples": ""})


def with_quality(items: DataFrame, quality: DataFrame) -> DataFrame:
    """Monitored sources with the quality of their open postings' bodies (``body_quality`` by source_id); what has none counts 0."""
    names = {n: f"{n}_open_postings" for n in ("substantive", "image_only", "sparse", "zero_skill")}
    q = quality.select("source_id", *(F.col(a).alias(b) for a, b in names.items()), F.col("examples").alias("sparse_examples"))
    return items.join(q, "source_id", "left").fillna(dict.fromkeys(names.values(), 0) | {"sparse_examples": ""})


def error_tops(sources: DataFrame, n: int) -> DataFrame:
    """Failing sources by error and name."""
    return sources.filter(F.col("last_error_code").isNotNull()).orderBy(F.coalesce("last_error_code", F.lit("")), "company_name", "source_id").limit(n)


def report_tops(sources: DataFrame, n: int) -> DataFrame:
    """Sources by priority, open postings and name, all descending."""
    return sources.orderBy(F.desc("priority"), F.desc("open_postings"), F.desc("company_name")).limit(n)


def report_json(totals: DataFrame, families: DataFrame) -> DataFrame:
    """The monitor's report as one JSON document: totals, and families by name (as many as there are connector families)."""
    inner = families.agg(F.array_sort(F.collect_list(F.struct(*families.columns))).alias("families"))
    return totals.select(F.to_json(F.struct(F.struct(*totals.columns).alias("totals"), inner.scalar().alias("families"))).alias("report"))


def report_markdown(families: DataFrame) -> DataFrame:
    """A Markdown table of the families, one line per row."""
    escape = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return families.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(escape(c) for c in families.columns)), F.lit(" |")).alias("line"))


def preview(parsed: DataFrame, n: int = 5) -> DataFrame:
    """A dry run: the first openings by id, nothing written."""
    return parsed.filter("error is null").orderBy("source_id", "external_id").limit(n)
