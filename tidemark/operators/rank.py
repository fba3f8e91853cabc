"""Lists of postings: diversity rounds, personalised order, search, paging, feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import relevance
from tidemark.sources.store import cut

NEWEST = ("first_seen_at", "last_verified_at", "posting_id")


def newest() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in NEWEST]


def rounds(df: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """``company_round``: each company's postings in turns of ``size``, after all filters."""
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(*order))
    return df.withColumn("_r", rank).withColumn("company_round", F.expr(f"(_r - 1) div {size}")).drop("_r")


def diverse(df: DataFrame, offset: int, limit: int, size: int = 5) -> DataFrame:
    """A page of postings, newest first within diversity rounds."""
    return rounds(df, size, newest()).orderBy("company_round", *newest()).offset(offset).limit(limit)


def search(postings: DataFrame, found: DataFrame, query: str, fields: Sequence[str] = ("title", "location", "company_name")) -> DataFrame:
    """Postings that hold the query (as plain text, in any case) in a field or in a confirmed skill."""
    q = query.strip().lower()
    if not q:
        return postings
    by_skill = found.filter(F.contains(F.lower("skill"), F.lit(q))).select("posting_id").distinct().withColumn("_skill", F.lit(True))
    hit = F.coalesce(F.col("_skill"), F.lit(False))
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(q)), F.lit(False))
    return postings.join(by_skill, "posting_id", "left").filter(hit).drop("_skill")


def filtered(postings: DataFrame, found: DataFrame | None = None, companies: Sequence | None = None, career_type: str | None = None, category: str | None = None, query: str | None = None) -> DataFrame:
    """Open postings that meet every filter given."""
    out = postings.filter(F.col("status") == "open")
    if companies:
        out = out.filter(F.col("company_id").isin(*companies))
    if career_type:
        out = out.filter(F.col("career_type") == career_type)
    if category:
        out = out.join(found.filter(F.col("category") == category).select("posting_id").distinct(), "posting_id", "left_semi")
    return search(out, found, query) if query else out


def match_stats(found: DataFrame, owned: Sequence[str]) -> DataFrame:
    """Per posting: required skills, and how many of each requirement the owned skills meet."""
    mine = F.col("skill").isin(*owned)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kind = F.col("requirement_type")
    stats = found.groupBy("posting_id").agg(
        n(kind == "required").alias("required_total"),
        n(mine & (kind == "required")).alias("matched_required"),
        n(mine & (kind == "preferred")).alias("matched_preferred"),
        n(mine & ~kind.isin("required", "preferred")).alias("matched_unspecified"),
    )
    coverage = F.when(F.col("required_total") > 0, F.col("matched_required") / F.col("required_total")).otherwise(F.lit(0.0))
    return stats.withColumn("coverage", coverage).withColumn("matched_total", F.col("matched_required") + F.col("matched_preferred") + F.col("matched_unspecified"))


def personalised(postings: DataFrame, found: DataFrame, owned: Sequence[str], offset: int, limit: int, size: int = 2) -> DataFrame:
    """A page that gives four matched postings to one to explore; where one kind runs out the other fills.

    Slot of the r-th matched posting (from 0): r + r div 4; of the e-th to
    explore: 5 e + 4.  Ordered by slot, gaps close by themselves.
    """
    counts = ["matched_required", "matched_preferred", "matched_unspecified", "matched_total", "required_total"]
    ranked = postings.join(match_stats(found, owned), "posting_id", "left").fillna({**dict.fromkeys(counts, 0), "coverage": 0.0})
    ranked = ranked.withColumn("matched", F.col("matched_total") > 0)
    keys = [F.desc("matched_required"), F.desc("coverage"), F.desc("matched_preferred"), F.desc("matched_unspecified"), F.desc("matched_total")]
    # To explore, all keys are equal, so one window serves both kinds.
    order = [*keys, *newest()]
    in_company = F.row_number().over(Window.partitionBy("matched", "company_id").orderBy(*order))
    ranked = ranked.withColumn("_r", in_company).withColumn("company_round", F.expr(f"(_r - 1) div {size}"))
    # Only the first offset + limit of each kind can be on the page: a bounded sort, then a window over few rows.
    upto = offset + limit
    first = lambda m: ranked.filter(F.col("matched") == m).orderBy("company_round", *order).limit(upto)
    page = first(True).unionByName(first(False)).withColumn("_p", F.row_number().over(Window.partitionBy("matched").orderBy("company_round", *order)) - 1)
    slot = F.when(F.col("matched"), F.expr("_p + _p div 4")).otherwise(F.expr("5 * _p + 4"))
    return page.withColumn("slot", slot).orderBy("slot", F.desc("matched")).offset(offset).limit(limit).drop("_r", "_p")


def keyset(df: DataFrame, time: str, key: str, after: tuple | None, limit: int | None) -> DataFrame:
    """The page after (time, key), newest first; a cursor with one null has no page; the limit is clamped to 1..51."""
    page = min(max(20 if limit is None else limit, 1), 51)
    if after is not None and (after[0] is None) != (after[1] is None):
        return df.limit(0)
    if after is not None and after[0] is not None:
        at = F.lit(after[0]).cast(dict(df.dtypes)[time])
        df = df.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < F.lit(after[1]))))
    return df.orderBy(F.desc(time), F.desc(key)).limit(page)


def skill_search(stats: DataFrame, query: str, limit: int) -> DataFrame:
    """Skills by relevance of their name, then demand."""
    return stats.withColumn("relevance", relevance(F.col("skill"), query)).filter("relevance is not null").orderBy("relevance", F.desc("posting_count"), "skill").limit(limit)


def feed(posts: DataFrame, jobs: DataFrame, limit: int, insights: DataFrame | None = None) -> DataFrame:
    """One post to two jobs, insights at places 2 and 7 of each page of ten.

    ``posts``, ``jobs`` and ``insights`` have item and rank (from 0).
    Slots leave room for the insights: three items of posts and jobs at a time.
    """
    place = lambda df, kind, slot: df.select("item", F.lit(kind).alias("kind"), slot.cast("double").alias("slot"))
    r = F.col("rank")
    out = place(posts, "post", r * 3).unionByName(place(jobs, "job", F.floor(r / 2) * 3 + 1 + r % 2))
    mixed = out.orderBy("slot").limit(limit)
    if insights is None:
        return mixed
    numbered = mixed.withColumn("n", F.row_number().over(Window.orderBy("slot")) - 1)  # at most ``limit`` rows
    spread = numbered.select("item", "kind", (F.floor(F.col("n") / 8) * 10 + F.element_at(F.array(*map(F.lit, (0, 1, 3, 4, 5, 6, 8, 9))), (F.col("n") % 8 + 1).cast("int"))).cast("double").alias("slot"))
    return spread.unionByName(place(insights, "insight", F.floor(r / 2) * 10 + F.when(r % 2 == 0, 2).otherwise(7))).orderBy("slot").limit(limit)


def popular(posts: DataFrame, tab: str, followed: Sequence = ()) -> DataFrame:
    """Order of a feed's tab: recommended (as it comes, by ``rank``), popular, following or latest."""
    if tab == "recommended":
        return posts.orderBy("rank")
    if tab == "popular":
        return posts.orderBy((F.col("reaction_count") + 2 * F.col("comment_count") + F.col("save_count")).desc(), F.desc("created_at"), "post_id")
    if tab == "following":
        posts = posts.filter(F.col("author_id").isin(*followed))
    return posts.orderBy(F.desc("created_at"), F.desc("post_id"))


def keep_order(prior: DataFrame, ranked: DataFrame) -> DataFrame:
    """Items in their prior order (item, place), new ones appended by rank."""
    return ranked.join(prior, "item", "left").withColumn("_new", F.col("place").isNull()).orderBy("_new", "place", "rank").drop("_new")


def excerpt(c, size: int = 1200):
    return F.substring(F.coalesce(c, F.lit("")), 1, size)


def summaries(postings: DataFrame, groups: DataFrame, body: str | None = None) -> DataFrame:
    """Postings with their three skill arrays and categories (empty where none is confirmed), and the start of their text."""
    arrays = ["required_skills", "preferred_skills", "unspecified_skills", "categories"]
    out = postings.join(groups.select("posting_id", *arrays), "posting_id", "left")
    for a in arrays:
        out = out.withColumn(a, F.coalesce(a, F.array().cast("array<string>")))
    return out.withColumn("excerpt", excerpt(F.col(body))) if body else out


def detail(postings: DataFrame, found: DataFrame, posting_id) -> DataFrame:
    """One posting with its skills as an array, stronger requirements first, then by name; no row for an id that isn't there."""
    rank = F.when(F.col("requirement_type") == "required", 0).when(F.col("requirement_type") == "preferred", 1).otherwise(2)
    skills = found.filter(F.col("posting_id") == posting_id).groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "skill", "category", "requirement_type"))).alias("skills"))
    return postings.filter(F.col("posting_id") == posting_id).join(skills, "posting_id", "left")


def jobs_summary(postings: DataFrame) -> DataFrame:
    """How many postings, of how many companies, and when the latest came."""
    return postings.agg(F.count("*").alias("postings"), F.countDistinct("company_id").alias("companies"), F.max("first_seen_at").alias("latest"))


# Orders of the market's skill list.
SKILL_SORTS = {
    "demand": ["-posting_count", "skill"], "companies": ["-company_count", "-posting_count", "skill"], "required": ["-required_count", "-posting_count", "skill"], "preferred": ["-preferred_count", "-posting_count", "skill"], "name": ["skill"], "rare": ["posting_count", "skill"],
}


def sorted_skills(stats: DataFrame, mode: str) -> DataFrame:
    return stats.orderBy(*(F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in SKILL_SORTS[mode]))


def post_relevance(title, body, tags, query: str):
    """0 title or tag exact, 1 title prefix, 2 in the title, 3 in a tag, 4 in the text; null otherwise."""
    q = query.strip().lower()
    t, low = F.lower(F.trim(title)), F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(x))
    return F.when((t == q) | F.array_contains(low, q), 0).when(F.startswith(t, F.lit(q)), 1).when(F.contains(t, F.lit(q)), 2).when(F.exists(low, lambda x: F.contains(x, F.lit(q))), 3).when(F.contains(F.lower(body), F.lit(q)), 4)


def new_for_searches(matches: DataFrame, newest: int = 5) -> DataFrame:
    """Per user and search its newest postings, then one row per user and posting with the searches' names."""
    w = Window.partitionBy("user_id", "search_id").orderBy(F.desc("first_seen_at"), F.desc("posting_id"))
    few = matches.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= newest)
    return few.groupBy("user_id", "posting_id").agg(F.max("first_seen_at").alias("first_seen_at"), F.array_sort(F.collect_set("name")).alias("names"))


def unseen(page: DataFrame, seen: DataFrame, key: str = "item") -> DataFrame:
    """A page without what an earlier tab has shown."""
    return page.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def in_order(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with its place from 1 in an order over all rows.

    A window over all rows would sort them in one task.  Here they are dealt by
    ranges of the order, and a row's place is that within its partition behind
    the sizes of the partitions before (one number each, all that goes to the driver).
    """
    placed = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    sizes = sorted((r["p"], r["count"]) for r in placed.groupBy(F.shiftright("_m", 33).alias("p")).count().collect())
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    numbered = placed.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(offsets), "_p")
    return numbered.withColumn(name, F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_m", "_p", "_start")
