"""The skill graph: co-occurrence edges, scores, selection of nodes, forest, paths.

The dictionary of skills bounds the graph (hundreds of nodes); postings do not,
so everything up to the edge table is a distributed aggregation and what comes
after works on the small edge table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.operators.market import pairs, supporting
from tidemark.sources.store import cut


def nodes(found: DataFrame) -> DataFrame:
    """Demand per skill by requirement; anything else counts as unspecified."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kind = F.col("requirement_type")
    return found.groupBy("skill").agg(
        F.count("*").alias("demand_count"), n(kind == "required").alias("required_count"), n(kind == "preferred").alias("preferred_count"), n(~kind.isin("required", "preferred")).alias("unspecified_count")
    )


def rounded(c: Column, digits: int = 4) -> Column:
    """Half up on the scaled value."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


#: Rows of a node or edge table that may come to the driver: pairs of a dictionary of some 600 skills.
HELD = 200_000


def bounded(df: DataFrame) -> list[Row]:
    """The rows of a node or edge table, which the dictionary of skills bounds; a table beyond that is refused, not gathered."""
    rows = df.limit(HELD + 1).collect()
    if len(rows) > HELD:
        raise ValueError(f"a graph table of more than {HELD} rows is none of a dictionary's")
    return rows


def held(df: DataFrame) -> DataFrame:
    """A node or edge table, computed once."""
    return df.sparkSession.createDataFrame(bounded(df), df.schema)


def edges(found: DataFrame, seed: str | None = None) -> DataFrame:
    """source < target, support, required_pairs, score.

    Score: support x mean strength x (share of the seed's postings on its edges,
    Jaccard on others) / sqrt(larger demand), at most 1, four digits.
    """
    demand = found.groupBy("skill").agg(F.count("*").alias("n"))
    both = pairs(found).join(demand.select(F.col("skill").alias("source"), F.col("n").alias("n_source")), "source").join(demand.select(F.col("skill").alias("target"), F.col("n").alias("n_target")), "target")
    shared = F.col("support") / (F.col("n_source") + F.col("n_target") - F.col("support"))
    if seed:
        shared = F.when(F.col("source") == seed, F.col("support") / F.col("n_source")).when(F.col("target") == seed, F.col("support") / F.col("n_target")).otherwise(shared)
    strength = F.col("strength") / (F.lit(20.0) * F.col("support"))
    raw = F.col("support") * strength * shared * (F.lit(1.0) / F.sqrt(F.greatest("n_source", "n_target").cast("double")))
    return both.withColumn("score", rounded(F.least(F.lit(1.0), raw))).select("source", "target", "support", "required_pairs", "score")


def edge_order() -> list[Column]:
    return [F.desc("score"), F.desc("support"), F.concat_ws("::", "source", "target").asc()]


def neighbours(edge: DataFrame, seed: str) -> DataFrame:
    """The seed's neighbours (skill, rank) by edge order."""
    touching = edge.filter((F.col("source") == seed) | (F.col("target") == seed))
    return touching.withColumn("skill", F.when(F.col("source") == seed, F.col("target")).otherwise(F.col("source"))).withColumn("rank", F.row_number().over(Window.orderBy(*edge_order()))).select("skill", "rank")


def selection(found: DataFrame, edge: DataFrame, seed: str, depth: int, limit: int) -> DataFrame:
    """The nodes to show around a seed, (skill, place): the seed, direct neighbours, and with depth 2 neighbours of the first 60 % of them.

    What is left of the limit goes to the remaining direct neighbours, then to
    the remaining second hop.  At most 60 rows leave here.
    """
    limit = max(5, min(limit, 60))
    capacity = limit - 1
    edge = held(edge)
    direct = neighbours(edge, seed)
    start = found.filter(F.col("skill") == seed).select("skill").limit(1).select("skill", F.lit(0).alias("tier"), F.lit(0).alias("rank"))
    if depth == 1:
        chosen = direct.filter(F.col("rank") <= capacity).select("skill", F.lit(1).alias("tier"), "rank")
        return _placed(start.unionByName(chosen), limit)
    target = max(1, round(capacity * 0.6))
    first = direct.filter(F.col("rank") <= target)
    near = first.select("skill")
    a = edge.join(near.withColumnRenamed("skill", "source"), "source", "left_semi").select(F.col("target").alias("skill"), "source", "target", "score", "support")
    b = edge.join(near.withColumnRenamed("skill", "target"), "target", "left_semi").select(F.col("source").alias("skill"), "source", "target", "score", "support")
    hop = a.unionByName(b).join(direct.select("skill"), "skill", "left_anti").filter(F.col("skill") != seed)
    best = hop.withColumn("o", F.row_number().over(Window.orderBy(*edge_order()))).groupBy("skill").agg(F.min("o").alias("o"))
    second = best.withColumn("rank", F.row_number().over(Window.orderBy("o"))).select("skill", "rank")
    n_first = first.agg(F.count("*")).scalar()
    room = F.lit(capacity) - n_first
    parts = [
        start,
        first.select("skill", F.lit(1).alias("tier"), "rank"),
        second.select("skill", F.when(F.col("rank") <= room, 2).otherwise(4).alias("tier"), "rank"),
        direct.filter(F.col("rank") > target).select("skill", F.lit(3).alias("tier"), "rank"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _placed(out, limit)


def _placed(df: DataFrame, limit: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.orderBy("tier", "rank"))).filter(F.col("place") <= limit).select("skill", "tier", "place")


def shown_skills(found: DataFrame, edge: DataFrame, node: DataFrame, seed: str | None, depth: int, limit: int) -> DataFrame:
    """(skill, place, seeded): the nodes around a seed; without one, or for a seed that no posting names, the leaders, which stand without edges."""
    if seed is not None and not found.filter(F.col("skill") == seed).isEmpty():
        return selection(found, edge, seed, depth, limit).select("skill", "place", F.lit(True).alias("seeded"))
    order = Window.orderBy(F.desc("demand_count"), F.desc("required_count"), F.lower("skill"))  # over at most 60 rows
    return leaders(node, limit).withColumn("place", F.row_number().over(order)).select("skill", "place", F.lit(False).alias("seeded"))


def leaders(node: DataFrame, limit: int) -> DataFrame:
    """Skills by demand, for a graph without a seed."""
    return node.orderBy(F.desc("demand_count"), F.desc("required_count"), F.lower("skill")).limit(max(5, min(limit, 60)))


def visible(edge: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges between shown skills."""
    s = shown.select("skill")
    return edge.join(s.withColumnRenamed("skill", "source"), "source", "left_semi").join(s.withColumnRenamed("skill", "target"), "target", "left_semi")


def skill_evidence(found: DataFrame, skill: str, limit: int) -> DataFrame:
    """Postings that ask for a skill, the strongest requirement first, with the total."""
    mine = found.filter(F.col("skill") == skill)
    rank = F.when(F.col("requirement_type") == "required", 0).when(F.col("requirement_type") == "preferred", 1).otherwise(2)
    page = mine.withColumn("rank", rank).orderBy("rank", F.desc("last_verified_at"), "posting_id").limit(limit)
    return page.withColumn("total", mine.agg(F.count("*")).scalar())


def degrees(edge: DataFrame) -> DataFrame:
    ends = edge.select(F.explode(F.array("source", "target")).alias("skill"))
    return ends.groupBy("skill").agg(F.count("*").alias("degree"))


def bounded_to(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def node_size(demand: Column, largest: Column) -> Column:
    """3.8 to 12.5 by the logarithm of demand against the largest, at least 4."""
    share = F.log1p(F.greatest(F.coalesce(demand, F.lit(0)), F.lit(0)).cast("double")) / F.log1p(F.greatest(F.lit(1), largest).cast("double"))
    return bounded_to(F.lit(3.8) + share * 8.7, 4.0, 12.5)


def link_weight(score: Column) -> Column:
    """0.6 to 1 by score; what is no number counts as 0."""
    plain = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)
    return bounded_to(F.lit(0.6) + bounded_to(plain, 0.0, 1.0) * 0.4, 0.6, 1.0)


def sized(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes with degree and size."""
    largest = node.agg(F.max("demand_count")).scalar()
    return node.join(degrees(edge), "skill", "left").fillna({"degree": 0}).withColumn("size", node_size(F.col("demand_count"), largest))


def layout(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Degree, size and place of every node: by demand around a circle once, each farther out by the root of its number."""
    total = node.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    ranked = sized(node, edge).withColumn("i", F.row_number().over(Window.orderBy(F.desc("demand_count"), F.desc("required_count"), F.lower("skill"))) - 1)  # a dictionary's nodes
    angle, radius = F.col("i") / total * (2 * math.pi), F.lit(120.0) + F.sqrt(F.col("i") + 1) * 18.0
    return ranked.select("skill", "demand_count", "degree", F.round("size", 6).alias("size"), rounded(F.cos(angle) * radius, 3).alias("x"), rounded(F.sin(angle) * radius, 3).alias("y"))


def links(edge: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(source, target, weight, kind) of what is drawn: edges of the graph and, if given, those from a skill to its evidence."""
    out = edge.select("source", "target", F.round(link_weight(F.col("score")), 6).alias("weight"), F.lit("cooccurrence").alias("kind"))
    return out if evidence is None else out.unionByName(evidence.select("source", "target", F.round(link_weight(F.col("score")), 6).alias("weight"), F.lit("evidence").alias("kind")))


def hub_labels(node: DataFrame, edge: DataFrame, owned: list[str], n: int = 24) -> DataFrame:
    """The nodes to label: three times the degree, demand, twice the size, and ten for what the user has."""
    score = 3 * F.col("degree") + F.col("demand_count") + 2 * F.col("size") + 10 * F.col("skill").isin(*owned).cast("int")
    return sized(node, edge).withColumn("label_score", F.round(score, 6)).orderBy(F.desc("label_score"), "skill").limit(n).select("skill", "label_score")


def by_rank() -> Column:
    """An edge's rank as a value: the smallest is the first by ``edge_order``."""
    return F.struct((-F.col("score")).alias("a"), (-F.col("support")).alias("b"), F.concat_ws("::", "source", "target").alias("c"))


def forest(edge: DataFrame) -> DataFrame:
    """(source, target) of the maximum spanning forest, by Boruvka's rounds.

    In a round every component takes its first edge to another one.  The edges
    taken join components to trees with one edge that both its ends took; the
    smaller end of it is the root, and pointers are doubled until all name their
    root.  At least half of the components go in a round, so rounds are few;
    each is joins over the edges left, cut by a checkpoint, and only counts come
    to the driver.  Edges are told apart by their names, so equal scores are no
    cycle.
    """
    left = cut(edge.filter("source <> target").select("source", "target", by_rank().alias("o"), F.col("source").alias("s"), F.col("target").alias("t")))
    tree = None
    while not left.isEmpty():
        ends = left.select("source", "target", "o", F.explode(F.array(F.struct(F.col("s").alias("c"), F.col("t").alias("parent")), F.struct(F.col("t").alias("c"), F.col("s").alias("parent")))).alias("e"))
        first = cut(ends.groupBy("e.c").agg(F.min_by(F.struct("source", "target", "e.parent"), "o").alias("f")).select("c", "f.*"))
        taken = first.select("source", "target").distinct()
        tree = taken if tree is None else tree.unionByName(taken)
        back = first.select(F.col("c").alias("parent"), F.col("parent").alias("back"))
        up = first.select("c", "parent").join(back, "parent").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("parent")), F.col("c")).otherwise(F.col("parent")).alias("parent"))
        while True:
            up = cut(up)
            grand = up.select(F.col("c").alias("parent"), F.col("parent").alias("grand"))
            further = up.join(grand, "parent")
            if further.filter("parent <> grand").isEmpty():
                break
            up = further.select("c", F.col("grand").alias("parent"))
        root = lambda end: up.select(F.col("c").alias(end), F.col("parent").alias(f"{end}_root"))
        left = cut(left.join(root("s"), "s").join(root("t"), "t").filter("s_root <> t_root").select("source", "target", "o", F.col("s_root").alias("s"), F.col("t_root").alias("t")))
    return tree if tree is not None else edge.select("source", "target").limit(0)


def backbone(edge: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with ``in_tree``: the maximum spanning forest in order of rank and, up to ``limit``, the strongest others.  Without a limit the forest alone."""
    marked = edge.select("source", "target", "score", "support").join(forest(edge).withColumn("in_tree", F.lit(True)), ["source", "target"], "left").withColumn("in_tree", F.coalesce("in_tree", F.lit(False)))
    if limit is None:
        return marked.filter("in_tree")
    return marked.orderBy(F.desc("in_tree"), *edge_order()).limit(limit)


def strongest_path(edge: DataFrame, starts: list[str], goal: str, hops: int = 4) -> DataFrame:
    """The cheapest path from any start to the goal in at most ``hops`` edges; an edge costs 1 + 4 (1 - score) + 1 / sqrt(support + 1).

    One join per hop over the small edge table, keeping each skill's cheapest path (ties: the smaller path).
    """
    cost = F.lit(1.0) + 4.0 * (1.0 - F.col("score")) + 1.0 / F.sqrt(F.col("support") + 1.0)
    one = held(edge).select("source", "target", cost.alias("step"))
    both = one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "step"))
    reached = edge.sparkSession.createDataFrame([(s, 0.0, [s]) for s in starts], "skill string, cost double, path array<string>")
    for _ in range(min(hops, 8)):
        further = reached.join(both, reached["skill"] == both["source"]).filter(~F.array_contains("path", F.col("target"))).select(F.col("target").alias("skill"), (F.col("cost") + F.col("step")).alias("cost"), F.array_append("path", F.col("target")).alias("path"))
        reached = held(reached.unionByName(further).groupBy("skill").agg(F.min(F.struct("cost", "path")).alias("b")).select("skill", "b.cost", "b.path"))
    return reached.filter(F.col("skill") == goal).select("skill", "cost", F.array_join("path", ">").alias("path"))


def within(edge: DataFrame, starts: list[str], hops: int) -> DataFrame:
    """Skills within ``hops`` edges of the starts, with their distance."""
    edge = held(edge.select("source", "target"))
    both = edge.unionByName(edge.select(F.col("target").alias("source"), F.col("source").alias("target")))
    reached = edge.sparkSession.createDataFrame([(s, 0) for s in starts], "skill string, distance int")
    for _ in range(hops):
        further = reached.join(both, reached["skill"] == both["source"]).select(F.col("target").alias("skill"), (F.col("distance") + 1).alias("distance"))
        reached = held(reached.unionByName(further).groupBy("skill").agg(F.min("distance").alias("distance")))
    return reached


def relations(edge: DataFrame, skill: str) -> DataFrame:
    """A skill's neighbours with their strength against the strongest: sqrt(support / largest)."""
    mine = edge.filter((F.col("source") == skill) | (F.col("target") == skill)).withColumn("other", F.when(F.col("source") == skill, F.col("target")).otherwise(F.col("source")))
    return mine.withColumn("ratio", F.sqrt(F.col("support") / mine.agg(F.max("support")).scalar())).select("other", "support", "ratio")


def merged(base: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Union of two node or edge tables; where both have a row, that of ``base`` stays."""
    both = base.withColumn("_p", F.lit(0)).unionByName(incoming.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_p"))).filter("_n = 1").drop("_p", "_n")


def focus_view(edge: DataFrame, focus: str, limit: int) -> DataFrame:
    """What a focused graph draws, up to the limit: the focus's own edges, then the forest of the others, then the strongest rest (``tier`` 0, 1, 2)."""
    edge = cut(edge.select("source", "target", "score", "support"))
    own = (F.col("source") == focus) | (F.col("target") == focus)
    other = edge.filter(~own)
    tree = backbone(other).select("source", "target", F.lit(1).alias("tier"))
    ranked = edge.join(tree, ["source", "target"], "left").withColumn("tier", F.when(own, 0).otherwise(F.coalesce("tier", F.lit(2))))
    return ranked.orderBy("tier", *edge_order()).limit(limit).select("source", "target", "support", "score", "tier")


#: Share of a focused graph that is for nodes two edges away.
SECOND_SHARE = 0.35


def focus_nodes(node: DataFrame, edge: DataFrame, focus: str, limit: int) -> DataFrame:
    """(skill, place, hop): the focus, its neighbours, and nodes of the second hop, each with a neighbour it hangs on.

    Second-hop nodes get up to 35 % of the places.  They are taken in order of
    the edge that reaches them, and each needs its parent: one that would need
    a further parent must leave room for both.  The parents of those taken come
    first among the neighbours, then the others in order.  A focus that is no
    node gives the leaders.

    Only the first few connections of each parent can be taken (a place behind
    twice the quota is behind as many taken or known ones), so what is folded in
    order is neighbours times that.
    """
    names = node.select("skill").distinct()
    if names.filter(F.col("skill") == focus).isEmpty():
        order = Window.orderBy(F.desc("demand_count"), F.desc("required_count"), F.lower("skill"))  # over at most 60 rows
        return leaders(node, limit).withColumn("place", F.row_number().over(order)).select("skill", "place", F.lit(0).alias("hop"))
    edge = edge.join(names.withColumnRenamed("skill", "source"), "source", "left_semi").join(names.withColumnRenamed("skill", "target"), "target", "left_semi")
    capacity = max(0, limit - 1)
    quota = max(1, int(capacity * SECOND_SHARE))
    direct = cut(neighbours(edge, focus))
    sided = edge.filter((F.col("source") != focus) & (F.col("target") != focus)).withColumn("o", by_rank())
    either = sided.select(F.col("source").alias("parent"), F.col("target").alias("skill"), "o").unionByName(sided.select(F.col("target").alias("parent"), F.col("source").alias("skill"), "o"))
    reached = either.join(direct.select(F.col("skill").alias("parent")), "parent", "left_semi").join(direct.select("skill"), "skill", "left_anti")
    likely = reached.withColumn("n", F.row_number().over(Window.partitionBy("parent").orderBy("o"))).filter(F.col("n") <= 2 * quota)

    def step(held, c):
        second, parents = held["second"], held["parents"]
        known = F.array_contains(parents, c["parent"])
        fits = (F.size(second) < quota) & ~F.array_contains(second, c["skill"]) & (F.size(second) + F.size(parents) + F.when(known, 1).otherwise(2) <= capacity)
        return F.struct(F.when(fits, F.array_append(second, c["skill"])).otherwise(second).alias("second"), F.when(fits & ~known, F.array_append(parents, c["parent"])).otherwise(parents).alias("parents"))

    none = F.array().cast("array<string>")
    taken = cut(likely.agg(F.array_sort(F.collect_list(F.struct("o", "skill", "parent"))).alias("c")).select(F.aggregate("c", F.struct(none.alias("second"), none.alias("parents")), step).alias("t")).select("t.*"))
    near = direct.join(taken.select(F.explode("parents").alias("skill"), F.lit(0).alias("late")), "skill", "left").withColumn("late", F.coalesce("late", F.lit(1)))
    room = F.lit(capacity) - taken.select(F.size("second")).scalar()
    first = near.withColumn("rank", F.row_number().over(Window.orderBy("late", "rank"))).filter(F.col("rank") <= room)  # the focus's neighbours
    rows = [
        names.filter(F.col("skill") == focus).select("skill", F.lit(0).alias("hop"), F.lit(0).alias("rank")),
        first.select("skill", F.lit(1).alias("hop"), "rank"),
        taken.select(F.posexplode("second").alias("rank", "skill")).select("skill", F.lit(2).alias("hop"), "rank"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("place", F.row_number().over(Window.orderBy("hop", "rank"))).select("skill", "place", "hop")


def atlas_nodes(node: DataFrame, selected: str | None, limit: int) -> DataFrame:
    """(skill, place): the leading nodes; a selected node that isn't among them takes the last place."""
    order = [F.desc("demand_count"), F.desc("required_count"), F.lower("skill")]
    forced = F.lower(F.regexp_replace("skill", r"\s+", "")) == F.lit("".join((selected or "").lower().split()))
    lead = node.orderBy(*order).limit(limit).withColumn("kept", F.row_number().over(Window.orderBy(*order)))  # limit rows
    mine = node.filter(forced).orderBy(*order).limit(1)
    missing = mine.join(lead.select("skill"), "skill", "left_anti")
    room = F.lit(limit) - missing.agg(F.count("*")).scalar()
    both = lead.filter(F.col("kept") <= room).drop("kept").unionByName(missing)
    return both.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("skill", "place")


def query_nodes(node: DataFrame, edge: DataFrame, query: str, limit: int) -> DataFrame:
    """Skills whose name holds the query, by demand, and then their neighbours."""
    q = query.strip().lower()
    hit = node.filter(F.contains(F.lower("skill"), F.lit(q))).select("skill", F.lit(0).alias("tier"), "demand_count")
    both = edge.select("source", "target").unionByName(edge.select(F.col("target").alias("source"), F.col("source").alias("target")))
    near = both.join(hit.select(F.col("skill").alias("source")), "source", "left_semi").select(F.col("target").alias("skill")).distinct().join(hit.select("skill"), "skill", "left_anti").join(node, "skill").select("skill", F.lit(1).alias("tier"), "demand_count")
    return hit.unionByName(near).orderBy("tier", F.desc("demand_count"), "skill").limit(limit)


def domain_counts(node: DataFrame, skill_domains: DataFrame) -> DataFrame:
    """Skills and demand per domain; a skill counts in each of its domains, and once as its first."""
    each = node.join(skill_domains, "skill").select("skill", "demand_count", F.posexplode("domains").alias("pos", "domain"))
    return each.groupBy("domain").agg(F.count("*").alias("skills"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("primary_skills"), F.sum("demand_count").alias("demand"))


def domain_labels(node: DataFrame, skill_domains: DataFrame, n: int) -> DataFrame:
    """Labels to show: the leading skill of each first domain, then by demand."""
    first = node.join(skill_domains.select("skill", F.col("domains")[0].alias("domain")), "skill")
    led = first.withColumn("lead", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("demand_count"), "skill")) == 1)
    return led.orderBy(F.desc("lead"), F.desc("demand_count"), "skill").limit(n).select("skill", "domain", "lead")


def detail_level(zoom):
    """How much of the graph a zoom shows."""
    return F.when(zoom < 0.72, "node-only").when(zoom < 1.35, "hub-labels").otherwise("neighborhood-detail")


def answer(found: DataFrame, seed: str | None, depth: int, limit: int, evidence: int = 5) -> DataFrame:
    """One answer about the graph, as rows (kind, key, other, value): its nodes with demand, the edges between them with score, and the postings that support those."""
    node, edge = nodes(found), cut(edges(found, seed))
    shown = cut(shown_skills(found, edge, node, seed, depth, limit).select("skill"))
    drawn = cut(visible(edge, shown))
    ids = supporting(found, evidence).join(drawn.select("source", "target"), ["source", "target"], "left_semi").select(F.explode("posting_ids").alias("id")).distinct()
    none = F.lit(None)
    return (
        node.join(shown, "skill", "left_semi").select(F.lit("node").alias("kind"), F.col("skill").alias("key"), none.cast("string").alias("other"), F.col("demand_count").cast("double").alias("value"))
        .unionByName(drawn.select(F.lit("edge").alias("kind"), F.col("source").alias("key"), F.col("target").alias("other"), F.col("score").alias("value")))
        .unionByName(ids.select(F.lit("evidence").alias("kind"), F.col("id").cast("string").alias("key"), none.cast("string").alias("other"), none.cast("double").alias("value")))
    )
