"""Incremental state as batch merges: postings, revisions, absence, quarantine, snapshots, notifications.

State is read, joined and rewritten; nothing is updated in place, so a lost
executor or a run that begins again gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import local_date
from tidemark.operators import text_index

MISSING_LIMIT = 3
QUARANTINE_HOURS = 72
MAX_SEARCHES, MAX_NOTIFICATIONS, LOOKBACK_DAYS, RETENTION_DAYS = 10, 20, 30, 180


def upsert(state: DataFrame, batch: DataFrame, now, order: str | None = None) -> DataFrame:
    """Postings after a batch: known (source_id, external_id) are updated, a known url under another source moves, the rest is new.

    ``state`` and ``batch``: source_id, external_id, url, title, status; ``state``
    adds first_seen_at, last_seen_at, missing_runs.  ``action`` says what happened.
    A key that the batch repeats counts once, by its last row: the one with the
    greatest ``order`` (a column of the batch, if it has one), then url, title and
    status.  A url that several postings hold moves with the earliest first_seen_at.
    """
    now = F.lit(now).cast("timestamp")
    key = ["source_id", "external_id"]
    fields = [F.col(c) for c in ("url", "title", "status")]
    last = F.max(F.struct(*([F.col(order).alias("_order")] if order else []), *fields)).alias("_last")
    batch = batch.groupBy(key).agg(last).select(*key, "_last.url", "_last.title", "_last.status")
    by_key = state.select(*key, F.lit(True).alias("_known")).distinct()
    by_url = state.filter("url is not null").groupBy("url").agg(F.min("first_seen_at").alias("_first"))
    new = batch.join(by_key, key, "left")
    moved = new.filter("_known is null").join(by_url, "url", "left")
    inserted = moved.select(*key, "url", "title", "status", F.coalesce("_first", now).alias("first_seen_at"), F.when(F.col("_first").isNull(), "insert").otherwise("move").alias("action"))
    updated = batch.join(state.select(*key, "first_seen_at"), key).select(*key, "url", "title", "status", "first_seen_at", F.lit("update").alias("action"))
    touched = updated.unionByName(inserted).withColumn("last_seen_at", now).withColumn("missing_runs", F.lit(0))
    kept = state.join(touched.select(*key), key, "left_anti").join(touched.select("url"), "url", "left_anti").withColumn("action", F.lit("keep"))
    return kept.select(touched.columns).unionByName(touched)


def new_revisions(seen: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Incoming rows whose (key, digest) was not seen, each once."""
    return incoming.dropDuplicates([key, digest]).join(seen.select(key, digest), [key, digest], "left_anti")


def absence(state: DataFrame, seen: DataFrame, listings: DataFrame) -> DataFrame:
    """Counts absences per posting: seen resets, absent from a complete listing adds one, the third closes; an incomplete listing changes nothing.

    ``state``: posting_id, source_id, status, missing_runs; ``seen``: posting_id; ``listings``: source_id, complete.
    """
    joined = state.join(seen.select("posting_id").distinct().withColumn("_seen", F.lit(True)), "posting_id", "left").join(listings.groupBy("source_id").agg(F.max("complete").alias("_complete")), "source_id", "left")
    complete, present, open_ = F.coalesce("_complete", F.lit(False)), F.coalesce("_seen", F.lit(False)), F.col("status") != "closed"
    runs = F.when(~complete | ~open_, F.col("missing_runs")).when(present, 0).otherwise(F.col("missing_runs") + 1)
    return joined.withColumn("missing_runs", runs).withColumn("status", F.when(open_ & complete & (F.col("missing_runs") >= MISSING_LIMIT), "closed").otherwise(F.col("status"))).drop("_seen", "_complete")


def quarantine(postings: DataFrame, sources: DataFrame, now, hours: int = QUARANTINE_HOURS) -> DataFrame:
    """Open postings of a source that is not allowed, and never succeeded or not for ``hours``, become delayed."""
    stale = F.col("last_success_at").isNull() | (F.col("last_success_at") <= F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours)))
    bad = sources.filter((F.col("status") != "allowed") & stale).select("source_id").distinct().withColumn("_bad", F.lit(True))
    held = (F.col("status") == "open") & F.coalesce("_bad", F.lit(False))
    return postings.join(bad, "source_id", "left").withColumn("status", F.when(held, "delayed").otherwise(F.col("status"))).drop("_bad")


def mark_source(outcome: str):
    """The error code a source gets from a run's outcome; null for success."""
    c = F.col(outcome)
    known = ("blocked", "unsupported_connector", "temporary_fetch_error", "listing_parse_error", "partial_detail_failure", "partial_ingestion_failure", "incomplete_listing")
    return F.when(c == "success", F.lit(None).cast("string")).when(c.isin(*known), c).otherwise("temporary_fetch_error")


def daily_snapshot(observations: DataFrame, at: str, skill: str, posting: str) -> DataFrame:
    """(observed_on, skill, posting_count): distinct postings per local day.  Written with dynamic partition overwrite by observed_on, a day runs again without harm."""
    return observations.groupBy(local_date(F.col(at)).alias("observed_on"), F.col(skill).alias("skill")).agg(F.countDistinct(posting).alias("posting_count"))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("observed_on").parquet(path)


def bounded_searches(searches: DataFrame, limit: int = MAX_SEARCHES) -> DataFrame:
    """The latest searches of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "search_id")
    return searches.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def search_matches(searches: DataFrame, postings: DataFrame, found: DataFrame, now) -> DataFrame:
    """(user_id, search_id, posting_id) of open postings first seen after the search's checkpoint (at most 30 days back) that meet it.

    The window of time is cut first, for the evidence too; a search joins postings on its career type
    where it names one, else on its category, else on the rarest characters of its
    text; the rest is tested within the joined row.
    """
    now_ = F.lit(now).cast("timestamp")
    floor = now_ - F.make_interval(days=F.lit(LOOKBACK_DAYS))
    recent = postings.filter((F.col("status") == "open") & (F.col("first_seen_at") > floor) & (F.col("first_seen_at") <= now_))
    skills = found.join(recent.select("posting_id"), "posting_id", "left_semi").groupBy("posting_id").agg(F.collect_set("category").alias("_categories"), F.concat_ws("\n", F.collect_set(F.lower("skill"))).alias("_skills"))
    recent = recent.join(skills, "posting_id", "left").withColumn("_text", F.lower(F.concat_ws("\n", "title", "location", "company_name", "_skills")))
    wanted = bounded_searches(searches).withColumn("_from", F.greatest(F.col("last_checked_at"), floor)).withColumnRenamed("career_type", "_career").withColumnRenamed("category", "_category")
    query = F.lower(F.trim("query_text"))
    fits = (F.col("first_seen_at") > F.col("_from")) & ((F.coalesce("_category", F.lit("")) == "") | F.coalesce(F.array_contains("_categories", F.col("_category")), F.lit(False))) & ((query == "") | F.contains("_text", query))
    named = wanted.filter(F.coalesce("_career", F.lit("")) != "").join(recent, F.col("_career") == F.col("career_type"))
    open_ = wanted.filter(F.coalesce("_career", F.lit("")) == "")
    by_category = open_.filter(F.coalesce("_category", F.lit("")) != "").join(recent.withColumn("_one", F.explode("_categories")), F.col("_category") == F.col("_one")).drop("_one")
    any_ = open_.filter(F.coalesce("_category", F.lit("")) == "")
    by_text = text_index.containing(recent, "posting_id", "_text", any_.withColumn("_query", query), "_query").drop("_query")
    # A search that names nothing matches every recent posting: its result is that long.  One equal key a side lets it be dealt by posting.
    blank = any_.filter(query == "").select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt")).join(recent.withColumn("_salt", F.pmod(F.xxhash64("posting_id"), F.lit(16)).cast("int")), "_salt").drop("_salt")
    return named.unionByName(by_category).unionByName(by_text).unionByName(blank).filter(fits).select("user_id", "search_id", "name", "posting_id", "first_seen_at")


def advanced(searches: DataFrame, states: DataFrame, now, limit: int = MAX_SEARCHES) -> DataFrame:
    """``searches`` after an evaluation, with ``evaluated``: the latest enabled ones of each user are checked up to ``now``.

    A user who has notifications off (``states``: user_id, job_notifications_enabled)
    is not evaluated, but the checkpoints move on, so that nothing old is sent when
    they are on again.  ``searches`` has user_id, search_id, updated_at, last_checked_at, is_enabled.
    """
    taken = bounded_searches(searches.filter("is_enabled"), limit).select("user_id", "search_id", F.lit(True).alias("_taken"))
    off = states.filter(~F.col("job_notifications_enabled")).select("user_id", F.lit(True).alias("_off")).distinct()
    joined = searches.join(taken, ["user_id", "search_id"], "left").join(off, "user_id", "left")
    moved = F.coalesce("_taken", F.lit(False))
    return joined.withColumn("last_checked_at", F.when(moved, F.lit(now).cast("timestamp")).otherwise(F.col("last_checked_at"))).withColumn("evaluated", moved & ~F.coalesce("_off", F.lit(False))).drop("_taken", "_off")


def followed_matches(follows: DataFrame, postings: DataFrame, now) -> DataFrame:
    """(user_id, posting_id) of new open postings of followed companies; ``follows``: user_id, company_ids, checked_at, enabled."""
    now_ = F.lit(now).cast("timestamp")
    floor = now_ - F.make_interval(days=F.lit(LOOKBACK_DAYS))
    each = follows.filter("enabled").select("user_id", F.greatest("checked_at", floor).alias("_from"), F.explode(F.array_distinct(F.slice("company_ids", 1, 60))).alias("company_id"))
    recent = postings.filter((F.col("status") == "open") & (F.col("first_seen_at") > floor) & (F.col("first_seen_at") <= now_))
    return each.join(recent, "company_id").filter(F.col("first_seen_at") > F.col("_from")).select("user_id", "posting_id", "first_seen_at")


def notifications(by_search: DataFrame, by_company: DataFrame, sent: DataFrame, limit: int = MAX_NOTIFICATIONS) -> DataFrame:
    """New notifications: reasons merged per user and posting, the newest 20 per user, then without those already sent (user_id, dedupe_key)."""
    a = by_search.select("user_id", "posting_id", "first_seen_at", "search_id", F.lit(False).alias("followed"))
    b = by_company.select("user_id", "posting_id", "first_seen_at", F.lit(None).cast(dict(a.dtypes)["search_id"]).alias("search_id"), F.lit(True).alias("followed"))
    merged = a.unionByName(b).groupBy("user_id", "posting_id").agg(F.max("first_seen_at").alias("first_seen_at"), F.max("followed").alias("followed_company"), F.array_sort(F.collect_set("search_id")).alias("search_ids"))
    w = Window.partitionBy("user_id").orderBy(F.desc("first_seen_at"), F.desc("posting_id"))
    newest = merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    keyed = newest.withColumn("dedupe_key", F.concat(F.lit("job:"), F.col("posting_id").cast("string")))
    return keyed.join(sent.select("user_id", "dedupe_key"), ["user_id", "dedupe_key"], "left_anti")


def retained(sent: DataFrame, now, days: int = RETENTION_DAYS) -> DataFrame:
    return sent.filter(F.col("created_at") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def reason_text(followed, names):
    """Why a notification was made: searches' names, the followed company, or both."""
    n = F.size(names)
    searched = F.when(n == 1, F.concat(F.lit("search: "), names[0])).when(n > 1, F.concat(F.lit("search: "), names[0], F.lit(" +"), (n - 1).cast("string")))
    return F.concat_ws(", ", searched, F.when(followed, "followed company"))


def seed(state: DataFrame, catalog: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources after seeding, and postings after retirements.

    A catalog row with a known base_url updates it; one whose former_url is known
    moves it; the rest is new.  A source that the catalog marks retired is
    stopped and its open postings are closed.  Seeding again changes nothing.

    ``state``: source_id, base_url, family, status; ``catalog``: source_id, base_url, former_url, family, retired.
    """
    known = state.select(F.col("source_id").alias("_id"), F.col("base_url").alias("_url"), F.col("status").alias("_status"))
    # A join on either address, as an equality: the catalog row once per address.
    hit = catalog.withColumn("_url", F.explode(F.array_distinct(F.array_compact(F.array("base_url", "former_url"))))).join(known, "_url", "left")
    one = hit.groupBy("base_url", "family", "retired", F.col("source_id").alias("_new")).agg(F.max(F.struct(F.col("_id").isNotNull().alias("known"), (F.col("_url") == F.col("base_url")).alias("same"), "_id", "_status")).alias("k"))
    seeded = one.select(F.coalesce("k._id", "_new").alias("source_id"), "base_url", "family", F.when(F.col("retired"), "stopped").otherwise(F.coalesce("k._status", F.lit("needs_connector"))).alias("status"), "retired")
    kept = state.join(seeded.select("source_id"), "source_id", "left_anti").withColumn("retired", F.lit(False))
    after = kept.select("source_id", "base_url", "family", "status", "retired").unionByName(seeded)
    gone = after.filter("retired").select("source_id", F.lit(True).alias("_gone"))
    closed = postings.join(gone, "source_id", "left").withColumn("status", F.when(F.coalesce("_gone", F.lit(False)) & (F.col("status") == "open"), "closed").otherwise(F.col("status"))).drop("_gone")
    return after.drop("retired"), closed


def set_status(sources: DataFrame, ids: list, status: str) -> DataFrame:
    """Sources with a status set by hand; allowing one clears its error."""
    chosen = F.col("source_id").isin(*ids)
    error = F.when(chosen & F.lit(status == "allowed"), F.lit(None).cast("string")).otherwise(F.col("last_error_code"))
    return sources.withColumn("last_error_code", error).withColumn("status", F.when(chosen, status).otherwise(F.col("status")))


def position_summary(positions):
    """Of an array of positions (type, low, high): the common type or mixed, the least low and the largest high."""
    types = F.array_distinct(F.filter(F.transform(positions, lambda p: p["type"]), lambda t: t.isNotNull()))
    kind = F.when(F.size(types) == 1, types[0]).when(F.size(types) > 1, "mixed")
    return F.struct(kind.alias("career_type"), F.array_min(F.transform(positions, lambda p: p["low"])).alias("career_min"), F.array_max(F.transform(positions, lambda p: p["high"])).alias("career_max"))
