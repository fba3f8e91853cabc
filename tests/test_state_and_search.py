"""Index, forest, focus, paged listings, quotas, accounts and resync on small tables with odd rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import accounts, graph, ingest, market, quota, rank, resync, text_index, views
from tidemark.sources import paged
from tidemark.sources.store import fresh_table


def ids(df):
    return sorted((r["query_id"], r["id"]) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    path = fresh_table(spark, "test-index")
    schema = "doc_id long, text string"
    text_index.add(spark, path, 1, spark.createDataFrame([(1, "Red red fox"), (2, "the fox, the RED hen"), (5000, "red fox den"), (-7, "fox red"), (8, None), (9, ""), (None, "red fox")], schema))
    text_index.add(spark, path, 2, spark.createDataFrame([(2, "a blue hen"), (5000, None), (10, "C++ and c# red fox"), (10, "red fox")], schema))
    return path


def test_search_counts_the_newest_segment(spark, index):
    q = spark.createDataFrame([("a", "fox RED"), ("b", "hen"), ("c", "c++"), ("d", " ,. "), ("e", None), ("f", "fox unknown"), ("g", "red red")], "query_id string, text string")
    every = [("a", -7), ("a", 1), ("a", 10), ("b", 2), ("c", 10), ("g", -7), ("g", 1), ("g", 10)]
    assert ids(text_index.search(spark, index, q)) == every
    phrases = {(r["query_id"], r["id"]): r["hits"] for r in text_index.search(spark, index, q, phrase=True).collect()}
    assert phrases == {("a", -7): 1, ("b", 2): 1, ("c", 10): 1, ("g", 1): 1}
    path = fresh_table(spark, "test-index")
    text_index.compacted(spark, index, path)
    assert ids(text_index.search(spark, path, q)) == every
    assert ids(text_index.search(spark, index, q.limit(0))) == []


def test_search_reads_only_its_buckets(spark, index):
    plan = text_index.for_tokens(spark, index, ["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["token"] for r in text_index.for_tokens(spark, index, ["fox"]).collect()} == {"fox"}
    again = text_index.lists(spark.createDataFrame([(i, "hot") for i in range(10_000)], "doc_id long, text string"), "doc_id", "text")
    assert max(r["n"] for r in again.select(F.size("ids").alias("n")).collect()) <= 4096


def test_a_segment_written_again_replaces_itself(spark):
    path, docs = fresh_table(spark, "test-index"), spark.createDataFrame([(1, "one fox")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "fox")], "query_id string, text string")
    for _ in range(2):
        text_index.add(spark, path, 1, docs)
    assert [tuple(r) for r in text_index.search(spark, path, q).collect()] == [("a", 1, 1)]


def test_substrings_meet_by_their_rarest_characters(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("abc ", k=rng.randint(0, 12)))) for i in range(200)] + [(900, None), (901, "abcabc")]
    queries = [(i, "".join(rng.choices("abc ", k=rng.randint(0, 5)))) for i in range(60)] + [(99, "zzz")]
    got = text_index.containing(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame(queries, "q int, s string"), "s")
    assert sorted((r["k"], r["q"]) for r in got.collect()) == sorted((k, q) for k, t in texts for q, s in queries if s and t is not None and s in t)


def kruskal(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    tree = set()
    for s, t, score, support in sorted(edges, key=lambda e: (-e[2], -e[3], f"{e[0]}::{e[1]}")):
        if root(s) != root(t):
            parent[root(s)] = root(t)
            tree.add((s, t))
    return tree


@pytest.mark.parametrize("seed", range(4))
def test_forest_is_kruskals(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = {tuple(sorted(rng.sample(names[:15] if rng.random() < 0.5 else names[15:], 2))) for _ in range(20 + 40 * seed)}
    edges = [(s, t, rng.choice([0.1, 0.5, 0.5, 0.9]), rng.randint(1, 3)) for s, t in pairs] + [("self", "self", 1.0, 9)]
    df = spark.createDataFrame(edges, "source string, target string, score double, support long")
    assert {tuple(r) for r in graph.forest(df).collect()} == kruskal(edges[:-1])
    assert graph.forest(df.limit(0)).count() == 0
    kept = graph.backbone(df.filter("source <> 'self'"), 25).collect()
    assert len(kept) == min(25, len(edges) - 1) and {(r["source"], r["target"]) for r in kept if r["in_tree"]} <= kruskal(edges[:-1])


def focus_by_hand(edges, focus, limit):
    order = sorted(edges, key=lambda e: (-e[2], -e[3], f"{e[0]}::{e[1]}"))
    direct = []
    for s, t, *_ in order:
        if focus in (s, t):
            direct.append(t if s == focus else s)
    second, parents, capacity = [], [], limit - 1
    quota_ = max(1, int(capacity * 0.35))
    for s, t, *_ in order:
        if focus in (s, t) or (s in direct) == (t in direct):
            continue
        p, n = (s, t) if s in direct else (t, s)
        if len(second) < quota_ and n not in second and len(second) + len(parents) + (1 if p in parents else 2) <= capacity:
            second.append(n)
            parents += [] if p in parents else [p]
    first = ([d for d in direct if d in parents] + [d for d in direct if d not in parents])[: capacity - len(second)]
    return [focus, *first, *second]


@pytest.mark.parametrize("seed", range(4))
def test_focus_nodes_hang_on_parents(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(25)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(60)}
    edges = [(s, t, rng.choice([0.2, 0.4, 0.4, 0.8]), rng.randint(1, 4)) for s, t in pairs]
    node = spark.createDataFrame([(n, i, i) for i, n in enumerate(names)], "skill string, demand_count int, required_count int")
    edge = spark.createDataFrame(edges, "source string, target string, score double, support long")
    for limit in (1, 5, 12, 30):
        got = [r["skill"] for r in graph.focus_nodes(node, edge, names[0], limit).orderBy("place").collect()]
        assert got == focus_by_hand(edges, names[0], limit)[: max(limit, 1)] or limit == 1 and got[0] == names[0]
    assert [r["skill"] for r in graph.focus_nodes(node, edge, "unknown", 5).orderBy("place").collect()] == names[:-6:-1]


def test_supporting_ids_are_the_smallest(spark):
    rows = [(p, s) for p in range(30) for s in ("a", "b", "c") if (p + ord(s)) % 3] + [(40, "a"), (40, "a"), (41, "b")]
    df = spark.createDataFrame(rows, "posting_id int, skill string")
    got = {(r["source"], r["target"]): r["posting_ids"] for r in market.supporting(df).collect()}
    have = {s: {p for p, x in rows if x == s} for s in "abc"}
    assert got == {(a, b): sorted(have[a] & have[b])[:5] for a, b in (("a", "b"), ("a", "c"), ("b", "c")) if have[a] & have[b]}
    edge = spark.createDataFrame([("c", "a")], "source string, target string")
    assert sorted(r["posting_id"] for r in views.edge_evidence(edge, df).collect()) == got["a", "c"]


def test_search_matches_have_no_join_without_a_key(spark):
    posts = spark.createDataFrame([(1, "Spark engineer", "Seoul", "Acme", "open", "x", datetime(2024, 5, 2))], "posting_id long, title string, location string, company_name string, status string, career_type string, first_seen_at timestamp")
    found = spark.createDataFrame([(1, "Go", "language")], "posting_id long, skill string, category string")
    searches = spark.createDataFrame([("u", i, q, "", "", datetime(2024, 5, 1), datetime(2024, 5, 1)) for i, q in enumerate(["spark eng", "go", "g", "rust", "", "  ACME "])], "user_id string, search_id int, query_text string, category string, career_type string, last_checked_at timestamp, updated_at timestamp").withColumn("name", F.col("query_text"))
    df = ingest.search_matches(searches, posts, found, datetime(2024, 5, 3))
    assert sorted(r["search_id"] for r in df.collect()) == [0, 1, 2, 4, 5]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


SCHEMA = "source_id int, family string, page int, payload string, affiliate string, affiliates array<string>"


@pytest.mark.parametrize(
    "family,pages,state",
    [
        ("apple", ['{"searchResults":[{"positionId":"1"},{"positionId":"2"}],"totalRecords":3}', '{"searchResults":[{"positionId":"3"}],"totalRecords":3}'], "complete"),
        ("apple", ['{"searchResults":[{"positionId":"1"}],"totalRecords":2}', '{"searchResults":[{"positionId":"1"}],"totalRecords":2}'], "repeated_id"),
        ("apple", ['{"searchResults":[],"totalRecords":2}'], "empty_page"), ("apple", ['{"searchResults":[],"totalRecords":0}'], "empty"), ("apple", ['{"totalRecords":0}'], "missing_list"), ("apple", [None], "invalid_payload"), ("apple", ["[1"], "invalid_payload"),
        ("pcsx", ['{"data":{"positions":[{"id":1},{"displayJobId":1}],"count":2}}'], "complete"), ("pcsx", ['{"data":{"positions":[{"id":1}],"count":2}}', '{"data":{"positions":[{"id":" "}],"count":2}}'], "missing_id"),
        ("workday", ['{"total":2,"jobPostings":[{"externalPath":"/a"}]}', '{"total":0,"jobPostings":[{"externalPath":"/b"}]}'], "complete"), ("workday", ['{"total":2,"jobPostings":[{"externalPath":"/a"}]}', '{"total":3,"jobPostings":[{"externalPath":"/b"}]}'], "moved_total"),
        ("nexon", ['{"list":[{"id":1,"corpName":"A"}],"pagination":{"page":2,"size":1,"total":1}}'], "moved_page"), ("nexon", ['{"list":[{"id":1,"corpName":"Z"}],"pagination":{"page":1,"size":1,"total":1}}'], "unknown_affiliate"),
        ("nexon", ['{"list":[{"id":1,"corpName":"A"}],"pagination":{"page":1,"size":1,"total":2}}', '{"list":[{"id":2,"corpName":"A"}],"pagination":{"page":2,"size":5,"total":2}}'], "moved_size"), ("none", ["{}"], "unsupported_connector"),
    ],
)
def test_paged_states(spark, family, pages, state):
    df = spark.createDataFrame([(1, family, i, p, None, ["A"]) for i, p in enumerate(pages, 1)], SCHEMA)
    assert [r["state"] for r in paged.verdicts(df).collect()] == [state]
    assert (paged.openings(df).count() > 0) == (state == "complete")


def quota_by_hand(rows, most, seconds):
    state, out = {}, []
    for k, c, t, n in sorted(rows, key=lambda r: (r[2], r[0])):
        if c is None:
            out.append((k, True, 0))
            continue
        ends, used = state.get(c, (t, 0))
        if c not in state or t >= ends:
            ends, used = t + timedelta(seconds=seconds), 0
        fits = used + (n or 0) <= most
        state[c] = ends, used + ((n or 0) if fits else 0)
        out.append((k, fits, 0 if fits else max(1, -int(-(ends - t).total_seconds() // 1))))
    return sorted(out)


def test_quota_folds_in_time(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 400)), rng.choice([None, 1, 60, 241])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, c string, t timestamp, n int").repartition(5)
    got = sorted((r["k"], r["allowed"], r["retry_after"]) for r in quota.consumed(df, "c", "t", "k", "n").collect())
    assert got == quota_by_hand(rows, 240, 60)
    assert quota.consumed(df.limit(0), "c", "t", "k", "n").count() == 0


def test_leaving_spreads_along_references(spark):
    t0, now = datetime(2024, 1, 1), datetime(2024, 2, 1)
    make = spark.createDataFrame
    tables = {
        "profiles": make([(1, "a", t0), (2, "b", t0)], "user_id int, nickname string, updated_at timestamp"),
        "posts": make([(10, 1, 2, 1, 0, t0), (11, 2, 1, 0, 0, t0), (12, 2, 0, 0, 1, t0)], "post_id int, author_id int, comment_count long, reaction_count long, save_count long, updated_at timestamp"),
        "comments": make([(100, 10, 2), (101, 10, 1), (102, 11, 1)], "comment_id int, post_id int, author_id int"),
        "reactions": make([(10, 2)], "post_id int, user_id int"), "saves": make([(12, 1)], "post_id int, user_id int"), "follows": make([(1, 2), (2, 1), (2, 3)], "follower_id int, followed_id int"),
    }
    after, feed = accounts.left(tables, make([(1,), (1,), (99,), (None,)], "user_id int"), now)
    assert sorted(map(tuple, after["posts"].collect())) == [(11, 2, 0, 0, 0, now), (12, 2, 0, 0, 0, now)]
    assert sorted(map(tuple, feed.collect())) == [("comments", "100"), ("comments", "101"), ("comments", "102"), ("follows", "1>2"), ("follows", "2>1"), ("posts", "10"), ("profiles", "1"), ("reactions", "10:2"), ("saves", "12:1")]
    same, nothing = accounts.left(tables, make([], "user_id int"), now)
    assert nothing.count() == 0 and same["posts"].exceptAll(tables["posts"]).count() == 0


def test_state_is_not_moved(spark):
    docs = spark.createDataFrame([(i, "t", f"Python {i}") for i in range(40)], "posting_id long, title string, body string")
    state = resync.stored(docs.select("posting_id", resync.digest("title", "body").alias("digest")), "posting_id", 4, "state")
    batch = docs.filter("posting_id > 2").withColumn("body", F.when(F.col("posting_id") == 9, "Go").otherwise(F.col("body"))).unionByName(docs.limit(1).withColumn("posting_id", F.lit(77).cast("long")))
    found = resync.changes(state, batch.withColumn("digest", resync.digest("title", "body")), 4)
    assert sorted(map(tuple, found.collect())) == [(0, "gone"), (1, "gone"), (2, "gone"), (9, "changed"), (77, "new")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    side = plan.split("FileScan")[1] if "FileScan" in plan else ""
    joined = plan.split("SortMergeJoin")[-1]
    assert "Bucketed: true" in plan and joined.index("FileScan") < joined.index("Exchange") and side
    assert resync.changes(state, docs.withColumn("digest", resync.digest("title", "body")), 4).count() == 0


def test_places_in_order_over_partitions(spark):
    rows = [(i, (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    got = [(r["v"], r["k"]) for r in rank.in_order(df, "at", "v", "k").orderBy("at").collect()]
    assert got == sorted((v, k) for k, v in rows)
    assert sorted(r["at"] for r in rank.in_order(df, "at", "v").collect()) == list(range(1, 201)) and rank.in_order(df.limit(0), "at", "v").count() == 0


@pytest.mark.parametrize("held", [0, 8_000_000])
def test_lists_are_dealt_once(spark, tmp_path, monkeypatch, held):
    """Superseded documents are told by block, whether every task holds them or not; neither an index nor its compaction moves a list twice or an entry alone."""
    monkeypatch.setattr(text_index, "HELD_DOCS", held)
    monkeypatch.setattr(text_index, "PER_TASK", 100)
    path, schema = str(tmp_path / "i"), "doc_id long, text string"
    old = [(i, f"red fox n{i % 7} red") for i in range(-5000, 5000, 7)]
    new = [(i, None if i % 2 else "blue fox blue fox") for i in range(-5000, 5000, 35)]
    text_index.add(spark, path, 1, spark.createDataFrame(old, schema))
    text_index.add(spark, path, 2, spark.createDataFrame(new, schema))
    rows = text_index.merged(spark, path)
    want = {}
    for i, text in (dict(old) | dict(new)).items():
        for at, token in enumerate((text or "").split()):
            want.setdefault((token, i), []).append(at)
    got = [((r["token"], r["first"] + i), p) for r in rows.collect() for i, p in zip(r["ids"], r["places"])]
    assert dict(got) == want and len(got) == len(want)
    assert all(r["first"] >> text_index.BLOCK_BITS == r["block"] and r["ids"] == sorted(r["ids"]) for r in rows.collect())
    for plan in (rows, text_index.lists(spark.createDataFrame(old, schema), "doc_id", "text", 8)):
        text = plan.sortWithinPartitions("bucket", "token", "block")._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in text.split("\n") if "Exchange" in line]
        assert sum("REPARTITION_BY_NUM" in x for x in moved) == 1 and not any("token" in x.split("hashpartitioning(")[1].split(",")[0] and "REPARTITION_BY_NUM" not in x for x in moved if "hashpartitioning(" in x) and "explode(arrays_zip" not in text, moved
