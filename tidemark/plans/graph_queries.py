"""Skill graph, fit and career."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import career, fit, graph, market
from tidemark.plans.analog import DOMAIN, FOUND, MENTIONS, POSTINGS, postings, skill_domains, sql, table
from tidemark.plans.evidence_queries import OWNED, OWNED_SQL, found

SEED = "Brand#1"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


BASE = (MENTIONS, POSTINGS, FOUND)
NODES = """
n AS (SELECT skill, count(*) AS demand_count, count(*) FILTER (requirement_type = 'required') AS required_count, count(*) FILTER (requirement_type = 'preferred') AS preferred_count,
             count(*) FILTER (requirement_type = 'unspecified') AS unspecified_count FROM o GROUP BY 1)"""
PAIRS = """
wt AS (SELECT posting_id, skill, requirement_type, CASE requirement_type WHEN 'required' THEN 10 WHEN 'preferred' THEN 7 ELSE 4 END AS w FROM o),
pr AS (SELECT a.skill AS source, b.skill AS target, count(*) AS support, sum(a.w + b.w) AS strength, count(*) FILTER (a.requirement_type = 'required' AND b.requirement_type = 'required') AS required_pairs
       FROM wt a JOIN wt b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY 1, 2)"""
EDGES = """
{name} AS (SELECT source, target, support, required_pairs, floor(least(1.0, support * (strength / (20.0 * support)::DOUBLE) * shared * (1.0::DOUBLE / sqrt(greatest(ns, nt)::DOUBLE))) * 10000.0 + 0.5) / 10000.0 AS score
  FROM (SELECT pr.*, a.demand_count AS ns, b.demand_count AS nt, {shared} AS shared FROM pr JOIN n a ON a.skill = source JOIN n b ON b.skill = target))"""
JACCARD = EDGES.format(name="ej", shared="support::DOUBLE / (a.demand_count + b.demand_count - support)")
SEEDED = EDGES.format(name="es", shared="CASE WHEN source = 'Brand#1' THEN support::DOUBLE / a.demand_count WHEN target = 'Brand#1' THEN support::DOUBLE / b.demand_count ELSE support::DOUBLE / (a.demand_count + b.demand_count - support) END")
DIRECT = """
dn AS (SELECT CASE WHEN source = 'Brand#1' THEN target ELSE source END AS skill, row_number() OVER (ORDER BY score DESC, support DESC, source || '::' || target) AS rank FROM es WHERE source = 'Brand#1' OR target = 'Brand#1')"""


@query(sql("SELECT * FROM n", *BASE, NODES))
def graph_nodes(spark, sf_dir):
    return graph.nodes(found(spark, sf_dir))


@query(sql("SELECT source, target, support, required_pairs, score FROM ej", *BASE, NODES, PAIRS, JACCARD))
def graph_edges_jaccard(spark, sf_dir):
    return graph.edges(found(spark, sf_dir))


@query(sql("SELECT source, target, support, required_pairs, score FROM es", *BASE, NODES, PAIRS, SEEDED))
def graph_edges_seeded(spark, sf_dir):
    return graph.edges(found(spark, sf_dir), SEED)


@query(sql("SELECT skill, CAST(rank AS INT) AS place FROM dn WHERE rank <= 11 UNION ALL SELECT 'Brand#1', 0", *BASE, NODES, PAIRS, SEEDED, DIRECT))
def graph_seed_neighbours(spark, sf_dir):
    f = found(spark, sf_dir)
    return graph.selection(f, graph.edges(f, SEED), SEED, 1, 12).select("skill", (F.col("place") - 1).alias("place"))


HOPS = """
fd AS (SELECT skill FROM dn WHERE rank <= 7),
hp AS (SELECT skill, row_number() OVER (ORDER BY min(o)) AS rank FROM
        (SELECT CASE WHEN source IN (SELECT skill FROM fd) THEN target ELSE source END AS skill, row_number() OVER (ORDER BY score DESC, support DESC, source || '::' || target) AS o
         FROM es WHERE (source IN (SELECT skill FROM fd)) <> (target IN (SELECT skill FROM fd)))
       WHERE skill <> 'Brand#1' AND skill NOT IN (SELECT skill FROM dn) GROUP BY skill),
al AS (SELECT 'Brand#1' AS skill, 0 AS tier, 0 AS rank UNION ALL SELECT skill, 1, rank FROM dn WHERE rank <= 7
       UNION ALL SELECT skill, CASE WHEN rank <= 4 THEN 2 ELSE 4 END, rank FROM hp UNION ALL SELECT skill, 3, rank FROM dn WHERE rank > 7)"""


@query(sql("SELECT skill, CAST(place AS INT) AS place FROM (SELECT skill, row_number() OVER (ORDER BY tier, rank) AS place FROM al) WHERE place <= 12", *BASE, NODES, PAIRS, SEEDED, DIRECT, HOPS))
def graph_seed_depth2(spark, sf_dir):
    f = found(spark, sf_dir)
    return graph.selection(f, graph.edges(f, SEED), SEED, 2, 12).select("skill", "place")


@query(sql("SELECT source, target, support, score FROM ej WHERE source IN (SELECT skill FROM n ORDER BY demand_count DESC, required_count DESC, lower(skill) LIMIT 8) AND target IN (SELECT skill FROM n ORDER BY demand_count DESC, required_count DESC, lower(skill) LIMIT 8)", *BASE, NODES, PAIRS, JACCARD))
def graph_demand_leaders(spark, sf_dir):
    f = found(spark, sf_dir)
    return graph.visible(graph.edges(f), graph.leaders(graph.nodes(f), 8)).select("source", "target", "support", "score")


@query(sql("SELECT skill, CAST(row_number() OVER (ORDER BY demand_count DESC, required_count DESC, lower(skill)) AS INT) AS place, FALSE AS seeded FROM n QUALIFY place <= 8", *BASE, NODES))
def graph_unknown_seed(spark, sf_dir):
    f = found(spark, sf_dir)
    return graph.shown_skills(f, graph.edges(f), graph.nodes(f), "No such skill", 2, 8)


@query(sql("SELECT posting_id, company_name, requirement_type, (SELECT count(*) FROM o WHERE skill = 'Brand#3') AS total FROM (SELECT *, row_number() OVER (ORDER BY CASE requirement_type WHEN 'required' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END, last_verified_at DESC, posting_id) AS rn FROM o WHERE skill = 'Brand#3') WHERE rn <= 20", *BASE))
def graph_evidence(spark, sf_dir):
    return graph.skill_evidence(found(spark, sf_dir), "Brand#3", 20).select("posting_id", "company_name", "requirement_type", "total")


@query(sql("SELECT skill, count(*) AS degree FROM (SELECT source AS skill FROM ej WHERE support >= 40 UNION ALL SELECT target FROM ej WHERE support >= 40) GROUP BY 1", *BASE, NODES, PAIRS, JACCARD))
def graph_degree(spark, sf_dir):
    return graph.degrees(graph.edges(found(spark, sf_dir)).filter("support >= 40"))


@query(sql("SELECT CASE WHEN source = 'Brand#1' THEN target ELSE source END AS other, support, sqrt(support / (SELECT max(support) FROM ej WHERE source = 'Brand#1' OR target = 'Brand#1')) AS ratio FROM ej WHERE source = 'Brand#1' OR target = 'Brand#1'", *BASE, NODES, PAIRS, JACCARD))
def graph_relations(spark, sf_dir):
    return graph.relations(graph.edges(found(spark, sf_dir)), SEED)


SPARSE = "sp AS (SELECT * FROM ej WHERE score >= (SELECT score FROM ej ORDER BY score DESC, support DESC, source || '::' || target LIMIT 1 OFFSET 59))"


def sparse(edge):
    """The 60 strongest edges and their equals: a graph with paths longer than one edge."""
    edge = graph.held(edge)
    cut = edge.orderBy(*graph.edge_order()).limit(60).agg(F.min("score")).scalar()
    return edge.filter(F.col("score") >= cut)


def bottleneck(edges: str) -> str:
    """fo: the edges with ``tree``: an edge is in the maximum spanning forest if no path of stronger edges joins its ends."""
    steps = "".join(f", b{i} AS (SELECT a.u, b.v, min(greatest(a.r, b.r)) AS r FROM b{i - 1} a JOIN b{i - 1} b ON a.v = b.u GROUP BY 1, 2)" for i in range(1, 6))  # paths of up to 32 edges
    return f"""
rk AS (SELECT source, target, score, support, row_number() OVER (ORDER BY score DESC, support DESC, source || '::' || target) AS r FROM {edges}),
b0 AS (SELECT u, v, min(r) AS r FROM (SELECT source AS u, target AS v, r FROM rk UNION ALL SELECT target, source, r FROM rk UNION ALL SELECT source, source, 0 FROM rk UNION ALL SELECT target, target, 0 FROM rk) GROUP BY 1, 2){steps},
fo AS (SELECT rk.*, rk.r <= b5.r AS tree FROM rk JOIN b5 ON b5.u = source AND b5.v = target)"""


@query(sql("SELECT source, target, score, support, tree AS in_tree FROM fo ORDER BY tree DESC, r LIMIT 30", *BASE, NODES, PAIRS, JACCARD, bottleneck("ej")))
def graph_backbone(spark, sf_dir):
    return graph.backbone(graph.edges(found(spark, sf_dir)), 30)


@query(sql("SELECT source, target FROM fo WHERE tree", *BASE, NODES, PAIRS, JACCARD, SPARSE, bottleneck("sp")))
def graph_forest_sparse(spark, sf_dir):
    return graph.forest(sparse(graph.edges(found(spark, sf_dir))))


FOCUS_LIMIT = 12
FOCUS = f"""
nd AS (SELECT CASE WHEN source = 'Brand#1' THEN target ELSE source END AS skill, row_number() OVER (ORDER BY score DESC, support DESC, source || '::' || target) AS rank FROM sp WHERE source = 'Brand#1' OR target = 'Brand#1'),
cn AS (SELECT *, row_number() OVER (ORDER BY score DESC, support DESC, id) AS i FROM (SELECT score, support, source || '::' || target AS id, CASE WHEN source IN (SELECT skill FROM nd) THEN source ELSE target END AS parent, CASE WHEN source IN (SELECT skill FROM nd) THEN target ELSE source END AS skill
       FROM sp WHERE source <> 'Brand#1' AND target <> 'Brand#1' AND (source IN (SELECT skill FROM nd)) <> (target IN (SELECT skill FROM nd)))),
gr(i, second, parents) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL
  SELECT cn.i, CASE WHEN ok THEN list_append(second, skill) ELSE second END, CASE WHEN ok AND NOT list_contains(parents, parent) THEN list_append(parents, parent) ELSE parents END
  FROM gr JOIN cn ON cn.i = gr.i + 1 CROSS JOIN LATERAL (SELECT len(second) < {max(1, int((FOCUS_LIMIT - 1) * 0.35))} AND NOT list_contains(second, skill) AND len(second) + len(parents) + CASE WHEN list_contains(parents, parent) THEN 1 ELSE 2 END <= {FOCUS_LIMIT - 1} AS ok)),
tk AS (SELECT second, parents FROM gr ORDER BY i DESC LIMIT 1),
dr AS (SELECT skill, row_number() OVER (ORDER BY NOT list_contains((SELECT parents FROM tk), skill), rank) AS rank FROM nd),
fn AS (SELECT 'Brand#1' AS skill, 0 AS hop, 0 AS rank UNION ALL SELECT skill, 1, rank FROM dr WHERE rank <= {FOCUS_LIMIT - 1} - len((SELECT second FROM tk)) UNION ALL SELECT unnest(second), 2, unnest(range(len(second))) FROM tk)"""


@query(sql("SELECT skill, CAST(row_number() OVER (ORDER BY hop, rank) AS INT) AS place, hop FROM fn", *BASE, NODES, PAIRS, JACCARD, SPARSE, FOCUS).replace("WITH ", "WITH RECURSIVE ", 1))
def graph_focus_nodes(spark, sf_dir):
    f = found(spark, sf_dir)
    return graph.focus_nodes(graph.nodes(f), sparse(graph.edges(f)), SEED, FOCUS_LIMIT)


@query(sql("SELECT skill, CAST(row_number() OVER (ORDER BY demand_count DESC, required_count DESC, lower(skill)) AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY demand_count DESC, required_count DESC, lower(skill)) AS r, count(*) OVER () AS c FROM n) WHERE r <= 7 OR r = c", *BASE, NODES))
def graph_atlas_nodes(spark, sf_dir):
    """Eight leading nodes, the last of all nodes forced among them."""
    node = graph.held(graph.nodes(found(spark, sf_dir)))
    last = node.orderBy("demand_count", "required_count", F.lower("skill").desc()).first()["skill"]
    return graph.atlas_nodes(node, f" {last.upper()} ", 8)


@query(sql("SELECT source, target, array_to_string(list(posting_id ORDER BY posting_id)[1:5], ',') AS posting_ids FROM (SELECT DISTINCT a.skill AS source, b.skill AS target, a.posting_id FROM o a JOIN o b ON a.posting_id = b.posting_id AND a.skill < b.skill) GROUP BY 1, 2", *BASE))
def graph_edge_support(spark, sf_dir):
    return market.supporting(found(spark, sf_dir)).select("source", "target", F.array_join(F.col("posting_ids").cast("array<string>"), ",").alias("posting_ids"))


@query(
    sql(
        """SELECT skill, cost, path FROM (SELECT skill, cost, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY skill ORDER BY cost, path) AS rn FROM walk WHERE skill = 'Brand#25') WHERE rn = 1""",
        *BASE, NODES, PAIRS, JACCARD, SPARSE,
        """bo AS (SELECT source, target, 1.0::DOUBLE + 4.0 * (1.0 - score) + 1.0 / sqrt(support + 1.0::DOUBLE) AS step FROM sp UNION ALL SELECT target, source, 1.0::DOUBLE + 4.0 * (1.0 - score) + 1.0 / sqrt(support + 1.0::DOUBLE) FROM sp),
walk(skill, cost, path, hops) AS (SELECT 'Brand#1', 0.0::DOUBLE, ['Brand#1'], 0 UNION ALL SELECT target, cost + step, list_append(path, target), hops + 1 FROM walk JOIN bo ON source = skill WHERE hops < 4 AND NOT list_contains(path, target))""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def graph_strongest_path(spark, sf_dir):
    return graph.strongest_path(sparse(graph.edges(found(spark, sf_dir))), [SEED], "Brand#25", 4)


SIZED = """
sz AS (SELECT *, least(12.5, greatest(4.0, 3.8::DOUBLE + ln(1 + demand_count::DOUBLE) / ln(1 + greatest(1, mx)::DOUBLE) * 8.7)) AS size FROM (SELECT n.*, (SELECT count(*) FROM ej WHERE source = skill OR target = skill) AS degree, max(demand_count) OVER () AS mx FROM n))"""


@query(
    sql(
        """SELECT skill, demand_count, degree, round(size, 6) AS size, floor(cos(a) * r * 1000 + 0.5) / 1000 AS x, floor(sin(a) * r * 1000 + 0.5) / 1000 AS y
FROM (SELECT *, i::DOUBLE / c * (2 * pi()) AS a, 120.0::DOUBLE + sqrt(i + 1) * 18.0 AS r FROM (SELECT *, row_number() OVER (ORDER BY demand_count DESC, required_count DESC, lower(skill)) - 1 AS i, count(*) OVER () AS c FROM sz))""",
        *BASE, NODES, PAIRS, JACCARD, SIZED,
    )
)
def graph_layout(spark, sf_dir):
    f = found(spark, sf_dir)
    return graph.layout(graph.nodes(f), graph.edges(f))


@query(sql("SELECT source, target, round(least(1.0, greatest(0.6, 0.6::DOUBLE + least(1.0, greatest(0.0, score)) * 0.4)), 6) AS weight, 'cooccurrence' AS kind FROM ej UNION ALL SELECT skill, posting_id::VARCHAR, 1.0, 'evidence' FROM o WHERE skill = 'Brand#1' AND posting_id % 50 = 0", *BASE, NODES, PAIRS, JACCARD))
def graph_links(spark, sf_dir):
    f = found(spark, sf_dir)
    evidence = f.filter((F.col("skill") == SEED) & (F.col("posting_id") % 50 == 0)).select(F.col("skill").alias("source"), F.col("posting_id").cast("string").alias("target"), F.lit(2.0).alias("score"))
    return graph.links(graph.edges(f), evidence)


@query(sql("SELECT skill, round(3 * degree + demand_count + 2 * size + CASE WHEN skill IN ('Brand#1','Brand#2','Brand#3') THEN 10 ELSE 0 END, 6) AS label_score FROM sz ORDER BY label_score DESC, skill LIMIT 24", *BASE, NODES, PAIRS, JACCARD, SIZED))
def graph_hub_labels(spark, sf_dir):
    f = found(spark, sf_dir)
    return graph.hub_labels(graph.nodes(f), graph.edges(f), OWNED)


@query(
    sql(
        """SELECT 'node' AS kind, skill AS key, NULL AS other, demand_count::DOUBLE AS value FROM n WHERE skill IN (SELECT skill FROM sh) UNION ALL SELECT 'edge', source, target, score FROM es WHERE source IN (SELECT skill FROM sh) AND target IN (SELECT skill FROM sh)
UNION ALL SELECT DISTINCT 'evidence', unnest(ids[1:5])::VARCHAR, NULL, NULL FROM (SELECT a.skill AS source, b.skill AS target, list(DISTINCT a.posting_id ORDER BY a.posting_id) AS ids FROM o a JOIN o b ON a.posting_id = b.posting_id AND a.skill < b.skill WHERE a.skill IN (SELECT skill FROM sh) AND b.skill IN (SELECT skill FROM sh) GROUP BY 1, 2)""",
        *BASE, NODES, PAIRS, SEEDED, DIRECT, "sh AS (SELECT skill FROM dn WHERE rank <= 7 UNION ALL SELECT 'Brand#1')",
    )
)
def graph_answer(spark, sf_dir):
    return graph.answer(found(spark, sf_dir), SEED, 1, 8)


@query(sql("SELECT source, target, support AS posting_count FROM pr WHERE lower(source) = 'brand#5' OR lower(target) = 'brand#5' ORDER BY support DESC, source || '::' || target LIMIT 6", *BASE, PAIRS))
def skill_combinations(spark, sf_dir):
    return market.combinations(found(spark, sf_dir), 6, " brand#5 ")


@query(sql("SELECT source, target, support FROM pr ORDER BY support DESC, source, target LIMIT 20", *BASE, PAIRS))
def skill_pairs_top(spark, sf_dir):
    return market.pairs(found(spark, sf_dir)).select("source", "target", "support").orderBy(F.desc("support"), "source", "target").limit(20)


# Fit: domains requested are backend and data.
REQUESTED = ["backend", "data"]
FIT = f"""
pp AS (SELECT posting_id, list(skill) FILTER (skill IN {OWNED_SQL}) AS covered,
  list(skill) FILTER (skill NOT IN {OWNED_SQL} AND requirement_type = 'required') AS mreq, list(skill) FILTER (skill NOT IN {OWNED_SQL} AND requirement_type = 'preferred') AS mpref,
  count(*) FILTER (requirement_type = 'required') AS rt, count(*) FILTER (requirement_type = 'required' AND skill IN {OWNED_SQL}) AS rc,
  flatten(list(domains) FILTER (skill NOT IN {OWNED_SQL} AND requirement_type IN ('required', 'preferred'))) AS md, flatten(list(domains) FILTER (skill IN {OWNED_SQL})) AS cd
  FROM o JOIN b USING (skill) GROUP BY 1),
mm AS (SELECT *, list_intersect(list_distinct(CASE WHEN len(coalesce(md, [])) > 0 THEN md ELSE cd END), ['backend', 'data']) AS dom FROM pp WHERE len(covered) > 0),
mp AS (SELECT * FROM mm WHERE len(dom) > 0),
ms AS (SELECT posting_id, dom, skill, kind, b.domains FROM (SELECT posting_id, dom, unnest(mreq) AS skill, 'required' AS kind FROM mp UNION ALL SELECT posting_id, dom, unnest(mpref), 'preferred' FROM mp) JOIN b USING (skill))"""


def _fit(spark, sf_dir):
    domains = skill_domains(spark, sf_dir)
    return fit.matched_postings(found(spark, sf_dir), OWNED, domains, REQUESTED), domains


@query(sql("SELECT count(*) AS matching_postings, count(*) FILTER (rt > 0 AND 2 * rc >= rt) AS strong_fit_postings FROM mp", *BASE, DOMAIN, FIT))
def fit_coverage(spark, sf_dir):
    return fit.coverage(_fit(spark, sf_dir)[0])


@query(
    sql(
        """SELECT dm.domain, coalesce(n, 0) AS supporting_postings, coalesce(cs, '') AS covered_skills, coalesce(mr, '') AS missing_required, coalesce(mpf, '') AS missing_preferred FROM (SELECT unnest(['backend', 'data']) AS domain) dm
LEFT JOIN (SELECT domain, count(*) AS n FROM (SELECT unnest(dom) AS domain FROM mp) GROUP BY 1) USING (domain)
LEFT JOIN (SELECT domain, string_agg(DISTINCT skill, ',' ORDER BY skill) AS cs FROM (SELECT skill, unnest(list_intersect(dom, domains)) AS domain FROM (SELECT dom, unnest(covered) AS skill FROM mp) JOIN b USING (skill)) GROUP BY 1) USING (domain)
LEFT JOIN (SELECT domain, string_agg(skill, ',' ORDER BY rn) FILTER (kind = 'required') AS mr, string_agg(skill, ',' ORDER BY rn) FILTER (kind = 'preferred') AS mpf FROM
  (SELECT *, row_number() OVER (PARTITION BY domain, kind ORDER BY n DESC, skill) AS rn FROM (SELECT domain, kind, skill, count(*) AS n FROM (SELECT kind, skill, unnest(list_intersect(dom, domains)) AS domain FROM ms) GROUP BY 1, 2, 3)) WHERE rn <= 10 GROUP BY 1) USING (domain)""",
        *BASE, DOMAIN, FIT,
    )
)
def fit_domain_branches(spark, sf_dir):
    matched, domains = _fit(spark, sf_dir)
    return fit.branches(matched, domains, REQUESTED)


@query(
    sql(
        """SELECT * FROM (SELECT skill, count(*) FILTER (kind = 'required') AS required_count, count(*) FILTER (kind = 'preferred') AS preferred_count, count(*) AS support FROM ms WHERE list_has_any(domains, ['backend', 'data']) GROUP BY 1 ORDER BY support DESC, skill LIMIT 7)
ORDER BY required_count DESC, support DESC, skill LIMIT 4""",
        *BASE, DOMAIN, FIT,
    )
)
def fit_next_skills(spark, sf_dir):
    matched, domains = _fit(spark, sf_dir)
    return fit.next_skills(fit.missing(matched, domains, REQUESTED), 7, 4)


# Career: five domains over titles (sector and priority), places and skills.
RULES = (
    career.Domain("machines", "Machines", ("machinery",), ("nation_1",), ("brand#1", "brand#2"), ("brand#3", "brand#4"), ("development",)),
    career.Domain("homes", "Homes", ("household",), ("nation_2",), ("brand#5", "brand#6"), ("brand#7",), ("operations",)),
    career.Domain("cars", "Cars", (), ("nation_3", "nation_13"), ("brand#8", "brand#9"), ("brand#10", "brand#11"), ("development",)),
    career.Domain("buildings", "Buildings", (), ("nation_4",), ("brand#12", "brand#13"), ("brand#14", "brand#15", "brand#16")),
    career.Domain("wares", "Wares", (), ("nation_5",), ("brand#17", "brand#18"), ("brand#19",)),
)
PROFILE = {"current_role": "Machinery lead", "responsibilities": "planned nation_3 lines", "experience_years": 5, "career_level": "senior", "employment_types": ["full_time"], "preferred_locations": ["NATION_3", "NATION_13"], "excluded_domains": ["wares"], "interest_domains": ["homes", "buildings"]}
OWNED_CAREER = ["Brand#1", "Brand#8", "Brand#10"]


def _in(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _terms(column, terms):
    return "(" + " + ".join(f"CASE WHEN contains({column}, '{t}') THEN 1 ELSE 0 END" for t in terms) + ")" if terms else "0"


CASES = " UNION ALL ".join(
    f"SELECT posting_id, '{d.id}' AS domain, '{d.label}' AS label, {_terms('lower(title)', d.title_terms)} AS tt, {_terms('lower(location)', d.responsibility_terms)} AS rt, len(list_intersect(sk, {_in(d.strong_skills)})) AS ss, len(list_intersect(sk, {_in(d.supporting_skills)})) AS us FROM ps" for d in RULES
)
CLASSES = f"""
ps AS (SELECT p.posting_id, title, location, coalesce(sk, []) AS sk FROM p LEFT JOIN (SELECT posting_id, list(lower(skill)) AS sk FROM o GROUP BY 1) USING (posting_id) WHERE status = 'open'),
ca AS ({CASES}),
ct AS (SELECT *, CASE WHEN tt > 0 THEN 1 WHEN (rt > 0 AND (ss + us > 0 OR rt >= 2)) OR ss >= 2 OR (ss > 0 AND us > 0) THEN 2 ELSE 0 END AS tier FROM ca),
cl AS (SELECT * FROM ct WHERE tier = 1 OR (tier = 2 AND posting_id NOT IN (SELECT posting_id FROM ct WHERE tier = 1)))"""


def classified(spark, sf_dir):
    f = found(spark, sf_dir)
    skills = f.groupBy("posting_id").agg(F.array_sort(F.collect_list("skill")).alias("skills"), F.array_sort(F.collect_list(F.when(F.col("requirement_type") == "required", F.col("skill")))).alias("required_skills"))
    open_ = postings(spark, sf_dir, open_only=True).join(skills, "posting_id", "left").withColumn("body", F.col("location"))
    return career.classify(open_, RULES), f


@query(sql("SELECT posting_id, domain, tier = 1 AS explicit FROM cl", *BASE, CLASSES))
def domain_classification(spark, sf_dir):
    return career.domain_rows(classified(spark, sf_dir)[0]).select("posting_id", "domain", "explicit")


FIELDS = "cf AS (SELECT cl.posting_id, domain, company_id, career_type, location FROM cl JOIN p USING (posting_id))"


@query(sql("SELECT domain, count(*) AS posting_count, count(DISTINCT company_id) AS company_count, 0 AS new_comer, 0 AS experienced, count(*) AS mixed_or_unknown, CASE WHEN count(*) >= 10 AND count(DISTINCT company_id) >= 3 THEN 'comparable' ELSE 'limited' END AS sample_status FROM cf GROUP BY 1", *BASE, CLASSES, FIELDS))
def market_fields(spark, sf_dir):
    c, f = classified(spark, sf_dir)
    return market.market_fields(career.domain_rows(c), f)[0]


@query(sql("SELECT domain, location, posting_count, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY posting_count DESC, location) AS rank FROM (SELECT domain, location, count(*) AS posting_count FROM cf GROUP BY 1, 2)) WHERE rank <= 5", *BASE, CLASSES, FIELDS))
def market_field_locations(spark, sf_dir):
    c, f = classified(spark, sf_dir)
    return market.market_fields(career.domain_rows(c), f)[1]


@query(sql("SELECT domain, skill, posting_count, company_count, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY company_count DESC, posting_count DESC, lower(skill)) AS rank FROM (SELECT domain, skill, count(*) AS posting_count, count(DISTINCT cf.company_id) AS company_count FROM cf JOIN o USING (posting_id) GROUP BY 1, 2)) WHERE rank <= 8", *BASE, CLASSES, FIELDS))
def market_field_skills(spark, sf_dir):
    c, f = classified(spark, sf_dir)
    return market.market_fields(career.domain_rows(c), f)[2]


def _connected(spark, sf_dir):
    c, _ = classified(spark, sf_dir)
    priority = F.substring("career_type", 1, 1).cast("int")
    c = c.withColumn("career_min", F.when(priority <= 2, 7 - priority)).withColumn("career_max", F.when(priority >= 4, priority * 2))
    c = c.withColumn("employment_type", F.when(F.col("o_totalprice") >= 100000, "regular").when(F.col("o_totalprice") >= 20000, "contract"))
    return career.connections(c, PROFILE, OWNED_CAREER, career.profile_kinds(PROFILE, RULES, OWNED_CAREER))


CONDITIONS = """
cc AS (SELECT posting_id,
  CASE WHEN (pn <= 2 AND 5 < 7 - pn) OR (pn >= 4 AND 5 > pn * 2) THEN 'changes' ELSE 'continues' END AS career_condition,
  CASE WHEN o_totalprice >= 100000 THEN 'continues' WHEN o_totalprice >= 20000 THEN 'changes' ELSE 'check' END AS employment_condition,
  CASE WHEN location IN ('NATION_3', 'NATION_13') THEN 'continues' ELSE 'changes' END AS location_condition
  FROM (SELECT *, CAST(substr(career_type, 1, 1) AS INT) AS pn FROM p WHERE status = 'open'))"""


@query(sql("SELECT * FROM cc", POSTINGS, CONDITIONS))
def career_conditions(spark, sf_dir):
    return _connected(spark, sf_dir).select("posting_id", "career_condition", "employment_condition", "location_condition")


RECOMMEND = """
mk AS (SELECT p.posting_id, p.location, p.last_verified_at, coalesce(ms, 0) AS ms, coalesce(mr, 0) AS mr, coalesce(rq, 0) AS rq FROM p LEFT JOIN
  (SELECT posting_id, count(*) FILTER (skill IN ('Brand#1','Brand#8','Brand#10')) AS ms, count(*) FILTER (requirement_type = 'required' AND skill IN ('Brand#1','Brand#8','Brand#10')) AS mr, count(*) FILTER (requirement_type = 'required') AS rq FROM o GROUP BY 1) USING (posting_id) WHERE status = 'open'),
be AS (SELECT cl.posting_id, domain, tier, CASE domain WHEN 'machines' THEN 0 WHEN 'cars' THEN 1 ELSE 2 END AS kind,
  row_number() OVER (PARTITION BY cl.posting_id ORDER BY CASE domain WHEN 'machines' THEN 0 WHEN 'cars' THEN 1 ELSE 2 END, tier, tt DESC, rt DESC, ss DESC, us DESC, label) AS rn FROM cl WHERE domain <> 'wares'),
el AS (SELECT mk.*, domain AS direction, kind, cc.* EXCLUDE (posting_id) FROM be JOIN mk USING (posting_id) JOIN cc USING (posting_id)
  WHERE rn = 1 AND tier = 1 AND (ms > 0 OR location = 'NATION_3') AND career_condition <> 'changes' AND employment_condition <> 'changes')"""


@query(sql("SELECT posting_id, direction, rq - mr AS missing_required, location_condition FROM el ORDER BY kind, rq - mr, CASE WHEN location_condition = 'changes' THEN 1 ELSE 0 END, last_verified_at DESC, posting_id LIMIT 50 OFFSET 10", *BASE, CLASSES, CONDITIONS, RECOMMEND))
def career_recommendations(spark, sf_dir):
    page = career.recommendations(_connected(spark, sf_dir), postings(spark, sf_dir), 50, 10)
    return page.select("posting_id", "direction", (F.col("required_count") - F.col("matched_required")).cast("long").alias("missing_required"), "location_condition")


@query(
    sql(
        """SELECT direction, kind AS kind_rank, count(*) AS posting_count, count(*) FILTER (eligible) AS eligible_count FROM (SELECT be.domain AS direction, kind, tier = 1 AND (ms > 0 OR location = 'NATION_3') AND career_condition <> 'changes' AND employment_condition <> 'changes' AS eligible
FROM be JOIN mk USING (posting_id) JOIN cc USING (posting_id) WHERE rn = 1) GROUP BY 1, 2 ORDER BY kind_rank, posting_count DESC, direction LIMIT 8""",
        *BASE, CLASSES, CONDITIONS, RECOMMEND,
    )
)
def career_directions(spark, sf_dir):
    return career.directions(_connected(spark, sf_dir))


@query()
def career_snapshot_id(spark, sf_dir):
    return career.snapshot_id(table(spark, sf_dir, "orders"))
