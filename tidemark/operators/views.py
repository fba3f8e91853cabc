"""Small views of postings, sources, posts and client state: latest and first of a group, tops, pages, merges.

"Latest" and "first" are aggregates over a struct, which combine before the
shuffle, not windows; a top is a bounded sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.market import supporting

SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
KEPT_ENTRIES, KEPT_SLUGS, LOOKUP_IDS, TOP = 24, 60, 24, 10
#: Uses of a skill that count as recent.
RECENT_USE = ("current", "within_1y")


def latest(df: DataFrame, group: str, time: str, key: str) -> DataFrame:
    """Per group the row of the latest ``time``, of equal ones the one with the largest ``key``; rows without a time count as the earliest."""
    best = F.max(F.struct(F.col(time).isNotNull(), time, key, *[c for c in df.columns if c not in (group, time, key)])).alias("b")
    return df.groupBy(group).agg(best).select(group, *[f"b.{c}" for c in df.columns if c != group])


def last_category(observed: DataFrame, skill: str, category: str, order: list[str]) -> DataFrame:
    """Per skill the last category that is not null, ``other`` if there is none."""
    last = F.max_by(category, F.when(F.col(category).isNotNull(), F.struct(*order)))
    return observed.groupBy(skill).agg(F.coalesce(last, F.lit("other")).alias("category"))


def first_of_group(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Per group the row with the highest ``score``, of equal ones the one with the smallest ``key``."""
    return df.groupBy(group).agg(F.max(F.struct(score, (-F.col(key)).alias("_k"))).alias("b")).select(group, (-F.col("b._k")).alias(key), f"b.{score}")


def monitor_tops(items: DataFrame, sparse: DataFrame, n: int = TOP) -> DataFrame:
    """(kind, place, source_id): the ``n`` sources stale for longest, failing by code, and with most sparse bodies (source_id, sparse)."""
    stale = items.filter("health = 'stale'").orderBy(F.asc_nulls_first("last_success_at"), "source_id").limit(n).select(F.lit("stale").alias("kind"), "source_id", F.struct(F.col("last_success_at").isNotNull().alias("a"), F.col("last_success_at").cast("long").alias("b"), F.lit("").alias("c")).alias("o"))
    failing = items.filter("health = 'failing'").orderBy("last_error_code", "source_id").limit(n).select(F.lit("failing").alias("kind"), "source_id", F.struct(F.lit(True).alias("a"), F.lit(0).cast("long").alias("b"), F.coalesce("last_error_code", F.lit("")).alias("c")).alias("o"))
    thin = sparse.filter("sparse > 0").orderBy(F.desc("sparse"), "source_id").limit(n).select(F.lit("sparse").alias("kind"), "source_id", F.struct(F.lit(True).alias("a"), (-F.col("sparse")).cast("long").alias("b"), F.lit("").alias("c")).alias("o"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("o", "source_id"))  # over 3 n rows
    return stale.unionByName(failing).unionByName(thin).select("kind", place.alias("place"), "source_id")


def preview_targets(sources: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    """Sources to try first: by priority, company and address."""
    chosen = sources if kind is None else sources.filter(F.col("family") == kind)
    return chosen.orderBy(F.desc("priority"), "company_name", "base_url").limit(n)


def page_with_probe(df: DataFrame, order: list, n: int) -> DataFrame:
    """A page of ``n`` rows with ``has_next``: one row more is fetched and cut again."""
    held = df.orderBy(*order).limit(n + 1)
    w = Window.orderBy(*order)  # over n + 1 rows
    return held.withColumn("_r", F.row_number().over(w)).withColumn("has_next", F.count("*").over(Window.partitionBy()) > n).filter(F.col("_r") <= n).drop("_r")


def merged_results(incoming: DataFrame, held: DataFrame, kind: str, key: str, rank: str) -> DataFrame:
    """Results of two searches: what came in last stands first, each (kind, key) once."""
    both = incoming.withColumn("_held", F.lit(0)).unionByName(held.withColumn("_held", F.lit(1)))
    first = both.groupBy(kind, key).agg(F.min(F.struct("_held", rank)).alias("f"))
    return first.select(kind, key, F.col("f._held").alias("held"), F.col(f"f.{rank}").alias(rank))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def search_documents(postings: DataFrame, skills: DataFrame) -> DataFrame:
    """Denormalised documents of a search index, one per posting: texts, skills by requirement, times as ISO strings.

    ``skills``: posting_id, required_skills, preferred_skills, unspecified_skills.
    """
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("required_skills", "preferred_skills", "unspecified_skills")]
    return postings.join(skills, "posting_id", "left").select("posting_id", "title", "company_name", "location", "career_type", "status", *lists, iso(F.col("first_seen_at")).alias("first_seen_at"), iso(F.col("last_verified_at")).alias("last_verified_at"))


def job_view(postings: DataFrame, mode: str, matched: DataFrame, saved: DataFrame) -> DataFrame:
    """Postings of a view: ``all``, ``matched`` (eligible ones) or ``saved``."""
    chosen = {"all": None, "matched": matched, "saved": saved}[mode]
    return postings if chosen is None else postings.join(chosen.select("posting_id"), "posting_id", "left_semi")


def named_like(name: Column, query: str) -> Column:
    """Whether a name holds the query, letter case and white space aside."""
    return F.contains(F.regexp_replace(F.lower(name), r"\s+", ""), F.lit("".join(query.lower().split())))


def edge_evidence(edges: DataFrame, held: DataFrame, n: int = 5) -> DataFrame:
    """(posting_id) that support a visible edge: of each edge (source, target) the ``n`` smallest ids, each once.

    The ids come from the postings' own pairs; edges meet the table of pairs, which the dictionary bounds, and never the evidence.
    """
    ends = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return supporting(held, n).join(ends, ["source", "target"], "left_semi").select(F.explode("posting_ids").alias("posting_id")).distinct()


def recent_use(usage: Column, name: Column, key: Column) -> Column:
    """Whether a map of skill uses says that a skill, by its name or else its key, is or was used within a year."""
    return F.coalesce(F.coalesce(F.try_element_at(usage, name), F.try_element_at(usage, key)).isin(*RECENT_USE), F.lit(False))


def newest_entries(entries: DataFrame, user: str, key: str, value: str, time: str, valid: list[str], n: int = KEPT_ENTRIES) -> DataFrame:
    """Per user a map of the ``n`` newest keys with their last value; values that are not valid are left out first."""
    last = entries.filter(F.col(value).isin(*valid)).groupBy(user, key).agg(F.max(F.struct(time, value)).alias("x"))
    w = Window.partitionBy(user).orderBy(F.desc(f"x.{time}"), key)
    return last.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy(user).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(f"x.{value}")))).alias("entries"))


def followed_slugs(follows: DataFrame, user: str, slug: str, time: str, n: int = KEPT_SLUGS) -> DataFrame:
    """Per user the ``n`` slugs followed last, in lower case; what is no slug is left out."""
    last = follows.withColumn(slug, F.lower(F.trim(slug))).filter(F.col(slug).rlike(SLUG)).groupBy(user, slug).agg(F.max(time).alias(time))
    w = Window.partitionBy(user).orderBy(F.desc(time), slug)
    return last.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def owned_edit(posts: DataFrame, owner: int, edits: DataFrame, deleted: DataFrame, now) -> DataFrame:
    """Posts after an owner's edits (post_id, title) and deletions (post_id): rows of others stay as they are; an edit sets updated_at."""
    own = F.col("author_id") == owner
    joined = posts.join(edits.select("post_id", F.col("title").alias("_title")), "post_id", "left").join(deleted.select("post_id", F.lit(True).alias("_gone")), "post_id", "left")
    edited = own & F.col("_title").isNotNull()
    kept = joined.filter(~(own & F.coalesce("_gone", F.lit(False))))
    return kept.withColumn("title", F.when(edited, F.col("_title")).otherwise(F.col("title"))).withColumn("updated_at", F.when(edited, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))).drop("_title", "_gone")


def lookup(wanted: DataFrame, postings: DataFrame, n: int = LOOKUP_IDS) -> DataFrame:
    """The first ``n`` wanted ids (posting_id, place) with their posting, or as unavailable."""
    asked = wanted.orderBy("place").limit(n)
    return asked.join(postings.withColumn("_there", F.lit(True)), "posting_id", "left").withColumn("state", F.when(F.col("_there"), "item").otherwise("unavailable")).drop("_there")
