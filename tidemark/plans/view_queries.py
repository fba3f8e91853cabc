"""What screens ask for: summaries, details, orders, labels, reports, client checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import evidence, graph, ingest, market, rank, source_health
from tidemark.plans import community_queries, source_queries
from tidemark.plans.analog import DOMAIN, FOUND, MENTIONS, POSTINGS, SOURCES, postings, skill_domains, sources, sql, table
from tidemark.plans.evidence_queries import found
from tidemark.plans.graph_queries import JACCARD, NODES, PAIRS, SPARSE, bottleneck, sparse
from tidemark.sources import markup

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BASE = (MENTIONS, POSTINGS, FOUND)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query(sql("SELECT p.posting_id, p.title, p.company_name, coalesce(required, '') AS required_skills, coalesce(n, 0) AS n_skills FROM p LEFT JOIN (SELECT posting_id, string_agg(skill, ',' ORDER BY skill) FILTER (requirement_type = 'required') AS required, count(*) AS n FROM o GROUP BY 1) USING (posting_id) WHERE status = 'open'", *BASE))
def posting_summary(spark, sf_dir):
    jobs = postings(spark, sf_dir).filter("status = 'open'")
    s = rank.summaries(jobs, evidence.skill_groups(found(spark, sf_dir)))
    return s.select("posting_id", "title", "company_name", F.array_join("required_skills", ",").alias("required_skills"), (F.size("required_skills") + F.size("preferred_skills") + F.size("unspecified_skills")).cast("long").alias("n_skills"))


FIRST = "(SELECT min(posting_id) FROM o WHERE skill = 'Brand#5')"


@query(sql(f"SELECT posting_id, string_agg(skill || ':' || requirement_type, ',' ORDER BY CASE requirement_type WHEN 'required' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END, skill) AS skills FROM o WHERE posting_id = {FIRST} GROUP BY 1", *BASE))
def posting_detail(spark, sf_dir):
    f = found(spark, sf_dir)
    wanted = f.filter("skill = 'Brand#5'").agg(F.min("posting_id")).scalar()
    d = rank.detail(postings(spark, sf_dir), f, wanted)
    return d.select("posting_id", F.array_join(F.transform("skills", lambda s: F.concat(s["skill"], F.lit(":"), s["requirement_type"])), ",").alias("skills"))


@query(sql("SELECT count(*) AS postings, count(DISTINCT company_id) AS companies, strftime(max(first_seen_at), '%Y-%m-%d') AS latest FROM p WHERE status = 'open'", POSTINGS))
def jobs_summary(spark, sf_dir):
    return rank.jobs_summary(postings(spark, sf_dir).filter("status = 'open'")).withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


SORTS = " UNION ALL ".join(f"SELECT '{m}' AS mode, skill, CAST(row_number() OVER (ORDER BY {', '.join((k[1:] + ' DESC') if k.startswith('-') else k for k in keys)}) AS INT) AS place FROM st" for m, keys in rank.SKILL_SORTS.items())


@query(sql(f"SELECT * FROM ({SORTS}) WHERE place <= 5", *BASE, "st AS (SELECT skill, count(*) AS posting_count, count(DISTINCT company_id) AS company_count, count(*) FILTER (requirement_type = 'required') AS required_count, count(*) FILTER (requirement_type = 'preferred') AS preferred_count FROM o GROUP BY 1)"))
def market_skill_sorts(spark, sf_dir):
    stats = market.skill_stats(found(spark, sf_dir), None)
    out = None
    for mode, keys in rank.SKILL_SORTS.items():
        order = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys]
        page = rank.sorted_skills(stats, mode).limit(5).withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(mode).alias("mode"), "skill", "place")
        out = page if out is None else out.unionByName(page)
    return out


@query(sql("SELECT domain, count(*) AS skills, count(*) FILTER (pos = 1) AS primary_skills, CAST(sum(demand_count) AS BIGINT) AS demand FROM (SELECT skill, demand_count, unnest(domains) AS domain, unnest(range(1, len(domains) + 1)) AS pos FROM n JOIN b USING (skill)) GROUP BY 1", *BASE, NODES, DOMAIN))
def graph_domain_counts(spark, sf_dir):
    return graph.domain_counts(graph.nodes(found(spark, sf_dir)), skill_domains(spark, sf_dir))


@query(sql("SELECT skill, domain, lead FROM (SELECT skill, domains[1] AS domain, demand_count, row_number() OVER (PARTITION BY domains[1] ORDER BY demand_count DESC, skill) = 1 AS lead FROM n JOIN b USING (skill)) ORDER BY lead DESC, demand_count DESC, skill LIMIT 8", *BASE, NODES, DOMAIN))
def graph_domain_labels(spark, sf_dir):
    return graph.domain_labels(graph.nodes(found(spark, sf_dir)), skill_domains(spark, sf_dir), 8)


@query(sql("SELECT skill, tier FROM (SELECT skill, 0 AS tier, demand_count FROM n WHERE contains(lower(skill), '#2') UNION ALL SELECT skill, 1, demand_count FROM n WHERE NOT contains(lower(skill), '#2') AND (skill IN (SELECT target FROM ej WHERE contains(source, '#2')) OR skill IN (SELECT source FROM ej WHERE contains(target, '#2')))) ORDER BY tier, demand_count DESC, skill LIMIT 15", *BASE, NODES, PAIRS, JACCARD))
def graph_query_nodes(spark, sf_dir):
    f = found(spark, sf_dir)
    return graph.query_nodes(graph.nodes(f), graph.edges(f), "#2", 15).select("skill", "tier")


OTHERS = "ot AS (SELECT * FROM sp WHERE source <> 'Brand#1' AND target <> 'Brand#1')"


@query(
    sql(
        """SELECT source, target, support, score, CAST(tier AS INT) AS tier FROM (SELECT source, target, support, score, 0 AS tier FROM sp WHERE source = 'Brand#1' OR target = 'Brand#1' UNION ALL SELECT source, target, support, score, CASE WHEN tree THEN 1 ELSE 2 END FROM fo)
ORDER BY tier, score DESC, support DESC, source || '::' || target LIMIT 40""",
        *BASE, NODES, PAIRS, JACCARD, SPARSE, OTHERS, bottleneck("ot"),
    )
)
def graph_focus_view(spark, sf_dir):
    return graph.focus_view(sparse(graph.edges(found(spark, sf_dir))), "Brand#1", 40)


@query("SELECT zoom, CASE WHEN zoom < 0.72 THEN 'node-only' WHEN zoom < 1.35 THEN 'hub-labels' ELSE 'neighborhood-detail' END AS level FROM (SELECT DISTINCT (event_id % 40) / 16.0::DOUBLE AS zoom FROM events)")
def graph_detail_level(spark, sf_dir):
    z = table(spark, sf_dir, "events").select((F.col("event_id") % 40 / 16.0).alias("zoom")).distinct()
    return z.withColumn("level", graph.detail_level(F.col("zoom")))


@query(sql("SELECT user_id, posting_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY user_id, search_id ORDER BY first_seen_at DESC, posting_id DESC) AS r FROM (SELECT sm.*, ['urgent','house','infra','place','brand'][search_id] AS name FROM sm)) WHERE r <= 5 GROUP BY 1, 2", *BASE, source_queries.MATCHES))
def saved_search_client_check(spark, sf_dir):
    by_search, _ = source_queries._matches(spark, sf_dir)
    return rank.new_for_searches(by_search).select("user_id", "posting_id", F.array_join("names", ",").alias("names"))


@query(sql("SELECT source_id, CASE WHEN source_id < 100 AND source_id % 10 = 0 THEN 'allowed' ELSE status END AS status, CASE WHEN source_id < 100 AND source_id % 10 = 0 THEN NULL ELSE last_error_code END AS last_error_code FROM s", SOURCES))
def source_set_status(spark, sf_dir):
    return ingest.set_status(sources(spark, sf_dir), [*range(0, 100, 10)], "allowed").select("source_id", "status", "last_error_code")


@query(
    sql(
        """SELECT source_id, CASE WHEN source_id % 5 = 1 THEN base_url || '/new' ELSE base_url END AS base_url, CASE WHEN source_id % 5 = 2 THEN 'stopped' ELSE status END AS status FROM s
UNION ALL SELECT 1000000 + x, 'https://new.example.org/' || x, 'needs_connector' FROM range(3) t(x)""",
        SOURCES,
    )
)
def seed_catalog(spark, sf_dir):
    state = sources(spark, sf_dir).select("source_id", "base_url", "family", "status")
    k = F.col("source_id")
    moved = F.when(k % 5 == 1, F.concat("base_url", F.lit("/new"))).otherwise(F.col("base_url"))
    catalog = state.select(k, moved.alias("base_url"), F.when(k % 5 == 1, F.col("base_url")).alias("former_url"), "family", (k % 5 == 2).alias("retired"))
    new = spark.range(3).select((F.col("id") + 1_000_000).alias("source_id"), F.concat(F.lit("https://new.example.org/"), F.col("id").cast("string")).alias("base_url"), F.lit(None).cast("string").alias("former_url"), F.lit("family0").alias("family"), F.lit(False).alias("retired"))
    after, _ = ingest.seed(state, catalog.unionByName(new), postings(spark, sf_dir, sourced=True))
    return after.select("source_id", "base_url", "status")


@query("SELECT o_custkey AS company_id, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) ELSE 'mixed' END AS career_type, min(CAST(substr(o_orderpriority, 1, 1) AS INT)) AS career_min, max(CAST(substr(o_orderpriority, 1, 1) AS INT) + 2) AS career_max FROM orders GROUP BY 1")
def position_summaries(spark, sf_dir):
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.collect_set(F.struct(F.col("o_orderpriority").alias("type"), p.alias("low"), (p + 2).alias("high"))).alias("ps"))
    return rows.select("company_id", ingest.position_summary(F.col("ps")).alias("s")).select("company_id", "s.*")


#: Ends of listing pages, and the next page each names (%d the page).
ENDS = (
    ('<a href="/a">1</a><a rel="next" href="/p?page=%1$d">&gt;</a>', "https://x.example/p?page="), ('<div class="pagination"><a class="next disabled" href="/p?page=%1$d">next</a></div>', None), ('<a class="btn next" href="https://x.example/%1$d">next</a>', "https://x.example/"),
    ('<a class="next" aria-disabled="true" href="/%1$d">next</a>', None),
)


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://x.example/p?page=' || page_id WHEN 2 THEN 'https://x.example/' || page_id END AS next_url FROM pages")
def listing_next_page(spark, sf_dir):
    k, end = F.col("page_id"), F.lit("")
    for i, (html, _) in enumerate(ENDS):
        end = F.when(k % 5 == i, F.format_string(html, k)).otherwise(end)
    return table(spark, sf_dir, "pages").select("page_id", markup.html_next_page(F.concat("html", end), F.lit("https://x.example/list")).alias("next_url"))


@query(sql("SELECT family AS f, '| ' || family || ' | ' || n || ' |' AS line FROM (SELECT family, count(*) AS n FROM s GROUP BY 1)", SOURCES))
def source_report_markdown(spark, sf_dir):
    rows = sources(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"))
    lines = source_health.report_markdown(rows)
    return lines.select(F.regexp_extract("line", r"^\| (\w+)", 1).alias("f"), "line")


@query(
    sql(
        f"""SELECT CAST(to_json(struct_pack(totals := (SELECT t FROM (SELECT {source_queries.FAMILY} FROM it) t), families := (SELECT list(f ORDER BY f.family) FROM (SELECT family, {source_queries.FAMILY} FROM it GROUP BY 1) f))) AS VARCHAR) AS report""",
        *source_queries.MONITOR,
    )
)
def source_report_json(spark, sf_dir):
    families = source_health.family_health(source_queries._items(spark, sf_dir))
    return source_health.report_json(families.filter("is_total").drop("family", "is_total"), families.filter("not is_total").drop("is_total"))


@query(sql("SELECT post_id, rel FROM (SELECT post_id, created_at, CASE WHEN lower(trim(title)) = 'the' THEN 0 WHEN starts_with(lower(trim(title)), 'the') THEN 1 WHEN contains(lower(trim(title)), 'the') THEN 2 WHEN contains(lower(body), 'the') THEN 4 END AS rel FROM po) WHERE rel IS NOT NULL", community_queries.POSTS))
def community_relevance(spark, sf_dir):
    p = community_queries.posts(spark, sf_dir)
    return p.select("post_id", rank.post_relevance(F.col("title"), F.col("body"), F.lit(None).cast("array<string>"), "the").alias("rel")).filter("rel is not null")


@query("SELECT item, CAST(row_number() OVER (ORDER BY CASE WHEN place IS NULL THEN 1 ELSE 0 END, place, rank) AS INT) AS at FROM (SELECT conv_id AS item, conv_id % 17 * 1000 + conv_id AS rank, CASE WHEN conv_id % 3 = 0 THEN 100000 - conv_id END AS place FROM conversations WHERE turn = 0)")
def feed_keeps_order(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("item"), (F.col("conv_id") % 17 * 1000 + F.col("conv_id")).alias("rank"))
    prior = items.filter("item % 3 = 0").select("item", (100000 - F.col("item")).alias("place"))
    kept = rank.keep_order(prior, items)
    return rank.in_order(kept, "at", F.col("place").isNull(), "place", "rank").select("item", F.col("at").cast("int").alias("at"))
