"""Skill demand, lists of postings, hiring calendar, trends."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import local_date
from tidemark.operators import calendar, evidence, ingest, market, rank
from tidemark.plans.analog import DATED, FOUND, MENTIONS, POSTINGS, mentions, postings, sql, table

OWNED = ["Brand#1", "Brand#2", "Brand#3"]
CAREER = "2-HIGH"
NOW = datetime(1998, 7, 1)
OWNED_SQL = "('Brand#1','Brand#2','Brand#3')"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.best_mentions(mentions(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


def found(spark: SparkSession, sf_dir: str, career: str | None = None) -> DataFrame:
    return evidence.confirmed_open(best(spark, sf_dir), postings(spark, sf_dir, open_only=True), career)


STATS = """SELECT skill, category, count(DISTINCT posting_id) AS posting_count, count(DISTINCT company_id) AS company_count,
  count(DISTINCT CASE WHEN requirement_type = 'required' THEN posting_id END) AS required_count,
  count(DISTINCT CASE WHEN requirement_type = 'preferred' THEN posting_id END) AS preferred_count,
  count(DISTINCT CASE WHEN requirement_type = 'unspecified' THEN posting_id END) AS unspecified_count
FROM {rows} GROUP BY skill, category ORDER BY posting_count DESC, skill LIMIT 500"""


@query(sql("SELECT posting_id, skill, category, requirement_type, confirmed FROM e", MENTIONS))
def best_mention_per_posting_skill(spark, sf_dir):
    return best(spark, sf_dir)


@query(sql(STATS.format(rows="o"), MENTIONS, POSTINGS, FOUND))
def skill_stats(spark, sf_dir):
    return market.skill_stats(found(spark, sf_dir))


@query(sql(STATS.format(rows="o WHERE career_type = '2-HIGH'"), MENTIONS, POSTINGS, FOUND))
def skill_stats_by_career(spark, sf_dir):
    return market.skill_stats(found(spark, sf_dir, CAREER))


@query(sql(STATS.format(rows="o WHERE posting_id IN (SELECT posting_id FROM o WHERE category = 'infra')"), MENTIONS, POSTINGS, FOUND))
def skill_stats_category_scope(spark, sf_dir):
    return market.skill_stats(evidence.in_category(found(spark, sf_dir), "infra"))


@query(sql("SELECT count(*) AS total FROM (SELECT skill, category FROM o GROUP BY 1, 2)", MENTIONS, POSTINGS, FOUND))
def skill_stats_total(spark, sf_dir):
    return market.skill_total(found(spark, sf_dir))


@query(sql("SELECT skill, posting_count, CAST(floor(100.0 * posting_count / greatest(1, max(posting_count) OVER ()) + 0.5) AS BIGINT) AS bar FROM (SELECT skill, count(*) AS posting_count FROM o GROUP BY 1)", MENTIONS, POSTINGS, FOUND))
def market_overview_bars(spark, sf_dir):
    return market.relative_bars(market.skill_stats(found(spark, sf_dir))).select("skill", "posting_count", "bar")


@query(
    sql(
        """SELECT posting_id,
  coalesce(string_agg(CASE WHEN requirement_type = 'required' THEN skill END, ',' ORDER BY skill), '') AS required_skills,
  coalesce(string_agg(CASE WHEN requirement_type = 'preferred' THEN skill END, ',' ORDER BY skill), '') AS preferred_skills,
  coalesce(string_agg(CASE WHEN requirement_type = 'unspecified' THEN skill END, ',' ORDER BY skill), '') AS unspecified_skills,
  array_to_string(list_sort(list_distinct(list(category))), ',') AS categories
FROM o GROUP BY posting_id""",
        MENTIONS, POSTINGS, FOUND,
    )
)
def posting_skill_groups(spark, sf_dir):
    g = evidence.skill_groups(found(spark, sf_dir))
    return g.select("posting_id", *[F.array_join(c, ",").alias(c) for c in ("required_skills", "preferred_skills", "unspecified_skills", "categories")])


@query(sql(
    """SELECT posting_id, title, company_name, location, rank FROM (SELECT o.*, row_number() OVER (ORDER BY CASE requirement_type WHEN 'required' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END, last_verified_at DESC, posting_id) AS rank FROM o WHERE skill = 'Brand#7') WHERE rank <= 20""", MENTIONS, POSTINGS, FOUND
))
def posting_search_documents(spark, sf_dir):
    from tidemark.operators.graph import skill_evidence

    page = skill_evidence(found(spark, sf_dir), "Brand#7", 20)
    from pyspark.sql import Window

    return page.withColumn("rank", F.row_number().over(Window.orderBy("rank", F.desc("last_verified_at"), "posting_id"))).select("posting_id", "title", "company_name", "location", "rank")


LIST = """SELECT posting_id, company_id, company_round FROM
 (SELECT *, (row_number() OVER (PARTITION BY company_id ORDER BY first_seen_at DESC, last_verified_at DESC, posting_id DESC) - 1) // 5 AS company_round FROM {rows})
 ORDER BY company_round, first_seen_at DESC, last_verified_at DESC, posting_id DESC LIMIT {limit} OFFSET {offset}"""
SEARCH = "(contains(lower(title), 'house') OR contains(lower(location), 'house') OR contains(lower(company_name), 'house') OR posting_id IN (SELECT posting_id FROM o WHERE contains(lower(skill), 'house')))"
BRAND = "(contains(lower(title), '#25') OR contains(lower(location), '#25') OR contains(lower(company_name), '#25') OR posting_id IN (SELECT posting_id FROM o WHERE contains(lower(skill), '#25')))"


@query(sql(LIST.format(rows="p WHERE status = 'open'", limit=100, offset=20), POSTINGS))
def posting_list_diverse(spark, sf_dir):
    return rank.diverse(rank.filtered(postings(spark, sf_dir, open_only=True)), 20, 100).select("posting_id", "company_id", "company_round")


@query(sql(LIST.format(rows=f"p WHERE status = 'open' AND {SEARCH}", limit=50, offset=0), MENTIONS, POSTINGS, FOUND))
def posting_list_search(spark, sf_dir):
    rows = rank.filtered(postings(spark, sf_dir, open_only=True), found(spark, sf_dir), query="House")
    return rank.diverse(rows, 0, 50).select("posting_id", "company_id", "company_round")


@query(sql(f"SELECT count(*) AS total FROM p WHERE status = 'open' AND {BRAND}", MENTIONS, POSTINGS, FOUND))
def posting_count_skill_search(spark, sf_dir):
    return rank.filtered(postings(spark, sf_dir, open_only=True), found(spark, sf_dir), query="#25").agg(F.count("*").alias("total"))


@query(sql("SELECT count(*) AS total FROM p WHERE status = 'open' AND company_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND posting_id IN (SELECT posting_id FROM o WHERE category = 'data')", MENTIONS, POSTINGS, FOUND))
def posting_count_filtered(spark, sf_dir):
    return rank.filtered(postings(spark, sf_dir, open_only=True), found(spark, sf_dir), companies=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89], category="data").agg(F.count("*").alias("total"))


MATCH = f"""
ms AS (SELECT posting_id, CAST(sum(CASE WHEN requirement_type = 'required' THEN 1 ELSE 0 END) AS BIGINT) AS required_total,
  CAST(sum(CASE WHEN skill IN {OWNED_SQL} AND requirement_type = 'required' THEN 1 ELSE 0 END) AS BIGINT) AS matched_required,
  CAST(sum(CASE WHEN skill IN {OWNED_SQL} AND requirement_type = 'preferred' THEN 1 ELSE 0 END) AS BIGINT) AS matched_preferred,
  CAST(sum(CASE WHEN skill IN {OWNED_SQL} AND requirement_type = 'unspecified' THEN 1 ELSE 0 END) AS BIGINT) AS matched_unspecified
  FROM o GROUP BY 1),
mt AS (SELECT *, CASE WHEN required_total > 0 THEN matched_required / required_total ELSE 0.0 END AS coverage, matched_required + matched_preferred + matched_unspecified AS matched_total FROM ms)"""


@query(sql("SELECT posting_id, required_total, matched_required, matched_preferred, matched_unspecified, coverage, matched_total FROM mt", MENTIONS, POSTINGS, FOUND, MATCH))
def posting_match_stats(spark, sf_dir):
    return rank.match_stats(found(spark, sf_dir), OWNED)


PERSONAL = """
f AS (SELECT p.*, coalesce(matched_required, 0) AS mr, coalesce(coverage, 0) AS cov, coalesce(matched_preferred, 0) AS mp, coalesce(matched_unspecified, 0) AS mu, coalesce(matched_total, 0) AS mtot,
  coalesce(matched_total, 0) > 0 AS matched FROM p LEFT JOIN mt USING (posting_id) WHERE status = 'open'),
r AS (SELECT *, (row_number() OVER (PARTITION BY matched, company_id ORDER BY mr DESC, cov DESC, mp DESC, mu DESC, mtot DESC, first_seen_at DESC, last_verified_at DESC, posting_id DESC) - 1) // 2 AS company_round FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY matched ORDER BY company_round, mr DESC, cov DESC, mp DESC, mu DESC, mtot DESC, first_seen_at DESC, last_verified_at DESC, posting_id DESC) - 1 AS pos FROM r)"""


@query(sql("SELECT posting_id, matched, company_round FROM (SELECT *, CASE WHEN matched THEN pos + pos // 4 ELSE 5 * pos + 4 END AS slot FROM q) ORDER BY slot, matched DESC LIMIT 60 OFFSET 15", MENTIONS, POSTINGS, FOUND, MATCH, PERSONAL))
def posting_list_personalised(spark, sf_dir):
    page = rank.personalised(postings(spark, sf_dir, open_only=True).filter("status = 'open'"), found(spark, sf_dir), OWNED, 15, 60)
    return page.select("posting_id", "matched", "company_round")


@query(sql("SELECT posting_id, first_seen_at::VARCHAR AS first_seen FROM p WHERE status = 'open' AND (first_seen_at < TIMESTAMP '1998-01-01' OR (first_seen_at = TIMESTAMP '1998-01-01' AND posting_id < 5000)) ORDER BY first_seen_at DESC, posting_id DESC LIMIT 51", POSTINGS))
def posting_keyset_page(spark, sf_dir):
    page = rank.keyset(rank.filtered(postings(spark, sf_dir, open_only=True)), "first_seen_at", "posting_id", ("1998-01-01", 5000), 99)
    return page.select("posting_id", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query(
    sql(
        """SELECT q.company_id, posting_count, location_count, CAST(latest AS DATE)::VARCHAR AS latest, coalesce(skill_count, 0) AS skill_count, coalesce(required_count, 0) AS required_count, coalesce(preferred_count, 0) AS preferred_count, coalesce(unspecified_count, 0) AS unspecified_count
FROM (SELECT company_id, count(*) AS posting_count, count(DISTINCT location) AS location_count, max(first_seen_at) AS latest FROM p WHERE status = 'open' GROUP BY 1) q
LEFT JOIN (SELECT company_id, count(DISTINCT skill) AS skill_count, count(*) FILTER (requirement_type = 'required') AS required_count, count(*) FILTER (requirement_type = 'preferred') AS preferred_count, count(*) FILTER (requirement_type = 'unspecified') AS unspecified_count FROM o GROUP BY 1) USING (company_id)""",
        MENTIONS, POSTINGS, FOUND,
    )
)
def company_profile(spark, sf_dir):
    return market.company_profile(found(spark, sf_dir), postings(spark, sf_dir, open_only=True)).withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@query(
    sql(
        """SELECT company_id, company_name, posting_count, latest_posting, coalesce(top_skills, '') AS top_skills FROM
(SELECT company_id, company_name, count(*) AS posting_count, arg_max(posting_id, (first_seen_at, posting_id)) AS latest_posting FROM p WHERE status = 'open' GROUP BY 1, 2)
LEFT JOIN (SELECT company_id, string_agg(skill, ',' ORDER BY rn) AS top_skills FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, skill) AS rn FROM (SELECT company_id, skill, count(*) AS n FROM o GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1) USING (company_id)""",
        MENTIONS, POSTINGS, FOUND,
    )
)
def company_search_groups(spark, sf_dir):
    return market.company_groups(found(spark, sf_dir), postings(spark, sf_dir, open_only=True))


@query(
    sql(
        """SELECT company_id, skill, posting_count, required_count, preferred_count, unspecified_count, CAST(row_number() OVER (PARTITION BY company_id ORDER BY posting_count DESC, required_count DESC, preferred_count DESC, lower(skill)) AS INT) AS rank
FROM (SELECT company_id, skill, count(*) AS posting_count, count(*) FILTER (requirement_type = 'required') AS required_count, count(*) FILTER (requirement_type = 'preferred') AS preferred_count, count(*) FILTER (requirement_type = 'unspecified') AS unspecified_count FROM o GROUP BY 1, 2)""",
        MENTIONS, POSTINGS, FOUND,
    )
)
def company_skill_counts(spark, sf_dir):
    return market.company_skills(found(spark, sf_dir))


@query(sql("SELECT company_id, posting_count, 'https://jobs.example/' || latest_posting AS source_url FROM (SELECT company_id, count(*) AS posting_count, arg_max(posting_id, (first_seen_at, posting_id)) AS latest_posting FROM p WHERE status = 'open' GROUP BY 1)", POSTINGS))
def company_search_sources(spark, sf_dir):
    jobs = postings(spark, sf_dir, open_only=True).withColumn("source_url", F.concat(F.lit("https://jobs.example/"), F.col("posting_id").cast("string")))
    return market.company_groups(found(spark, sf_dir), jobs, url="source_url").select("company_id", "posting_count", "source_url")


@query(sql("SELECT location AS label, count(*) AS n FROM p WHERE status = 'open' GROUP BY 1", POSTINGS))
def location_distribution(spark, sf_dir):
    return market.distribution(postings(spark, sf_dir, open_only=True).filter("status = 'open'"), "location")


@query(
    sql(
        """SELECT skill, posting_count, relevance FROM (SELECT skill, count(*) AS posting_count, CASE WHEN lower(skill) = 'brand#2' THEN 0 WHEN starts_with(lower(skill), 'brand#2') THEN 1 WHEN contains(lower(skill), 'brand#2') THEN 2 END AS relevance FROM o GROUP BY skill)
WHERE relevance IS NOT NULL ORDER BY relevance, posting_count DESC, skill LIMIT 10""",
        MENTIONS, POSTINGS, FOUND,
    )
)
def skill_search_relevance(spark, sf_dir):
    return rank.skill_search(market.skill_stats(found(spark, sf_dir), None), "Brand#2", 10).select("skill", "posting_count", "relevance")


# Hiring calendar: KST is UTC + 9 h in the whole range.
START, END = date(1998, 7, 1), date(1998, 8, 1)
RANGE = "closes_at >= TIMESTAMP '1998-07-01' - INTERVAL 9 HOUR AND closes_at < TIMESTAMP '1998-08-01' - INTERVAL 9 HOUR"


@query(sql(f"SELECT posting_id, strftime(closes_at, '%Y-%m-%d %H:%M:%S') AS closes FROM d WHERE status = 'open' AND {RANGE} ORDER BY closes_at, first_seen_at DESC, posting_id LIMIT 500", POSTINGS, DATED))
def hiring_deadlines(spark, sf_dir):
    return calendar.deadlines(postings(spark, sf_dir, dated=True, open_only=True), START, END, 500).select("posting_id", F.date_format("closes_at", "yyyy-MM-dd HH:mm:ss").alias("closes"))


@query(
    sql(
        f"""SELECT count(*) FILTER ({RANGE}) AS deadlines, count(*) FILTER (closes_at >= TIMESTAMP '1998-07-01' AND closes_at < TIMESTAMP '1998-07-08') AS closing_7d, count(*) FILTER (closes_at IS NULL) AS undated, count(DISTINCT company_id) AS companies
FROM d WHERE status = 'open'""",
        POSTINGS, DATED,
    )
)
def hiring_summary(spark, sf_dir):
    return calendar.summary(postings(spark, sf_dir, dated=True, open_only=True), START, END, NOW)


@query(
    sql(
        """SELECT company_id, company_name, new_postings, strftime(nearest, '%Y-%m-%d') AS nearest_deadline, open_postings FROM (SELECT company_id, company_name, count(*) FILTER (first_seen_at >= TIMESTAMP '1998-06-01' AND first_seen_at <= TIMESTAMP '1998-07-01') AS new_postings,
  min(closes_at) FILTER (closes_at >= TIMESTAMP '1998-07-01') AS nearest, max(first_seen_at) AS latest, count(*) AS open_postings FROM d WHERE status = 'open' GROUP BY 1, 2) WHERE new_postings > 0 ORDER BY new_postings DESC, latest DESC, company_name LIMIT 12""",
        POSTINGS, DATED,
    )
)
def hiring_active_companies(spark, sf_dir):
    rows = calendar.active_companies(postings(spark, sf_dir, dated=True, open_only=True), NOW, 30)
    return rows.select("company_id", "company_name", "new_postings", F.date_format("nearest_deadline", "yyyy-MM-dd").alias("nearest_deadline"), "open_postings")


GRID = """
g AS (SELECT CAST(DATE '1998-06-29' + CAST(x AS INT) AS DATE) AS day FROM range(42) t(x)),
c AS (SELECT CAST(closes_at + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS deadlines FROM d WHERE status = 'open' GROUP BY 1),
h AS (SELECT CAST(first_seen_at + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS opened FROM d WHERE status = 'open' GROUP BY 1)"""


@query(sql("SELECT strftime(g.day, '%Y-%m-%d') AS day, coalesce(deadlines, 0) AS deadlines, coalesce(opened, 0) AS opened, month(g.day) = 7 AS in_month FROM g LEFT JOIN c ON g.day = c.day LEFT JOIN h ON g.day = h.day", POSTINGS, DATED, GRID))
def hiring_calendar_grid(spark, sf_dir):
    return calendar.month_grid(postings(spark, sf_dir, dated=True, open_only=True), 1998, 7).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# Trends over events: skill = event type, posting = user.
SNAP = "sn AS (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS observed_on, event_type AS skill, count(DISTINCT user_id) AS posting_count FROM events GROUP BY 1, 2)"
WEEKS = """
w AS (SELECT date_trunc('week', observed_on) AS week, max(observed_on) AS observed_on FROM sn GROUP BY 1),
lw AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY week DESC) AS age, count(*) OVER () AS n FROM w) WHERE age <= 4 AND n >= 4),
tr AS (SELECT CAST(lw.week AS DATE) AS week, k.skill, coalesce(sn.posting_count, 0) AS posting_count FROM lw CROSS JOIN (SELECT DISTINCT skill FROM sn) k LEFT JOIN sn ON sn.observed_on = lw.observed_on AND sn.skill = k.skill)"""


def snapshots(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    return ingest.daily_snapshot(events, "ts", "event_type", "user_id")


@query(sql("SELECT strftime(observed_on, '%Y-%m-%d') AS observed_on, skill, posting_count FROM sn", SNAP))
def daily_snapshot(spark, sf_dir):
    return snapshots(spark, sf_dir).withColumn("observed_on", F.date_format("observed_on", "yyyy-MM-dd"))


@query(sql("SELECT strftime(week, '%Y-%m-%d') AS week, skill, posting_count FROM tr", SNAP, WEEKS))
def weekly_trend_series(spark, sf_dir):
    return market.weekly_trend(snapshots(spark, sf_dir), 4).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query(sql("SELECT skill, posting_count AS latest, before, posting_count - before AS delta FROM (SELECT *, lag(posting_count) OVER (PARTITION BY skill ORDER BY week) AS before, row_number() OVER (PARTITION BY skill ORDER BY week DESC) AS age FROM tr) WHERE age = 1", SNAP, WEEKS))
def trend_delta(spark, sf_dir):
    return market.trend_delta(market.weekly_trend(snapshots(spark, sf_dir), 4))


@query("SELECT CAST(ts + INTERVAL 9 HOUR AS DATE)::VARCHAR AS day, count(*) AS n, strftime(min(ts + INTERVAL 9 HOUR), '%G-W%V') AS iso_week FROM events GROUP BY 1")
def local_days(spark, sf_dir):
    from tidemark.functions.time import iso_week

    day = local_date(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(day.alias("d")).agg(F.count("*").alias("n")).select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n", iso_week(F.col("d")).alias("iso_week"))
