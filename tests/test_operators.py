"""Fixtures with known answers for operators whose rules a star schema can't show."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity, skills, text
from tidemark.functions import time as tm
from tidemark.operators import career, community, evidence, fit, graph, ingest, market, rank, source_health, skill_mentions
from tidemark.sources import listing_checks, markup, openings

P = "posting_id long, company_id long, company_name string, status string, career_type string, first_seen_at timestamp, last_verified_at timestamp, location string, title string"


def posting(i, company=1, status="open", career_type="experienced", day=1):
    at = datetime(2026, 7, day)
    return (i, company, f"company {company}", status, career_type, at, at, "Seoul", f"posting {i}")


def found(spark, skills_of, **more):
    rows = [(i, s, c, r, k >= 0.8) for i, own in skills_of.items() for s, c, r, k in own]
    e = spark.createDataFrame(rows, "posting_id long, skill string, category string, requirement_type string, confirmed boolean")
    return evidence.confirmed_open(e, spark.createDataFrame([posting(i, **more.get(str(i), {})) for i in skills_of], P))


@pytest.fixture(scope="module")
def four(spark):
    py = ("Python", "language")
    of = {1: [(*py, "required", 1.0), ("Go", "language", "required", 0.5)], 2: [(*py, "preferred", 1.0), ("AWS", "infra", "unspecified", 0.95)], 3: [(*py, "required", 0.9)], 4: [(*py, "required", 1.0)]}
    return found(spark, of, **{"2": {"career_type": "new_comer"}, "3": {"company": 2}, "4": {"status": "closed"}})


def test_stats(four):
    rows = {r["skill"]: tuple(r)[2:] for r in market.skill_stats(four).collect()}
    assert rows == {"Python": (3, 2, 2, 1, 0), "AWS": (1, 1, 0, 0, 1)} and market.skill_total(four).first()[0] == 2


def test_category_keeps_all_skills_of_its_postings(four):
    rows = {r["skill"]: r["posting_count"] for r in market.skill_stats(evidence.in_category(four, "infra")).collect()}
    assert rows == {"Python": 1, "AWS": 1} and evidence.in_category(four, "ai").count() == 0


def test_scores_of_edges(spark):
    f = found(spark, {1: [("C++", "l", "required", 1.0), ("ROS", "e", "required", 1.0), ("Linux", "i", "preferred", 1.0)]})
    e = {(r["source"], r["target"]): r for r in graph.edges(f, "C++").collect()}
    assert e["C++", "ROS"]["score"] > e["C++", "Linux"]["score"] and e["C++", "ROS"]["required_pairs"] == 1 and set(e) == {("C++", "ROS"), ("C++", "Linux"), ("Linux", "ROS")}


def test_graph_has_five_nodes_at_least(spark):
    of = {i: [("C++", "l", "required", 1.0), (f"S{i}", "l", "required", 1.0)] for i in range(9)}
    f = found(spark, of)
    assert graph.selection(f, graph.edges(f, "C++"), "C++", 1, 2).count() == 5
    assert graph.selection(f, graph.edges(f, "none"), "none", 1, 8).count() == 0


def test_forest_joins_what_it_can(spark):
    e = spark.createDataFrame([("a", "b", 9, 1, 0.9), ("b", "c", 8, 1, 0.8), ("a", "c", 7, 1, 0.7), ("x", "y", 1, 0, 0.1)], "source string, target string, support long, required_pairs long, score double")
    rows = graph.backbone(e, 4).collect()
    assert [(r["source"], r["target"], r["in_tree"]) for r in rows] == [("a", "b", True), ("b", "c", True), ("x", "y", True), ("a", "c", False)]
    assert {r["skill"]: r["distance"] for r in graph.within(e, ["a"], 2).collect()} == {"a": 0, "b": 1, "c": 1}


def test_path_over_weak_edges(spark):
    e = spark.createDataFrame([("a", "b", 50, 1, 1.0), ("b", "c", 50, 1, 1.0), ("a", "c", 1, 1, 0.0)], "source string, target string, support long, required_pairs long, score double")
    assert graph.strongest_path(e, ["a"], "c").first()["path"] == "a>b>c"
    assert graph.strongest_path(e, ["a"], "c", 1).first()["path"] == "a>c" and graph.strongest_path(e, ["a"], "zz").count() == 0


def test_fit(spark):
    of = {1: [("C++", "l", "required", 1.0), ("ROS", "e", "required", 1.0), ("Linux", "i", "required", 1.0), ("SLAM", "e", "preferred", 1.0)], 2: [("C++", "l", "required", 1.0), ("Python", "l", "required", 1.0), ("ROS", "e", "preferred", 1.0)]}
    domains = spark.createDataFrame([(s, ["robotics"]) for s in ("C++", "ROS", "Linux", "SLAM", "Python")], "skill string, domains array<string>")
    m = fit.matched_postings(found(spark, of), ["C++"], domains, ["robotics"])
    assert tuple(fit.coverage(m).first()) == (2, 1)
    assert [tuple(r) for r in fit.next_skills(fit.missing(m, domains, ["robotics"])).limit(1).collect()] == [("ROS", 1, 1, 2)]
    b = fit.branches(m, domains, ["robotics"]).first()
    assert b["covered_skills"] == "C++" and {"ROS", "Linux"} <= set(b["missing_required"].split(","))
    none = fit.matched_postings(found(spark, of), ["C++"], domains, ["games"])
    assert tuple(fit.coverage(none).first()) == (0, 0) and fit.branches(none, domains, ["games"]).first()["supporting_postings"] == 0


def test_personal_order_and_pages(spark):
    cpp = lambda r: ("C++", "l", r, 1.0)
    of = {1: [cpp("required")], 2: [cpp("required"), ("Go", "l", "required", 1.0)], 3: [cpp("preferred")], 4: [cpp("unspecified")], 5: [("Python", "l", "required", 1.0)]}
    jobs = spark.createDataFrame([posting(i, company=i) for i in of], P)
    page = lambda o, n: [r["posting_id"] for r in rank.personalised(jobs, found(spark, of), ["C++"], o, n).collect()]
    assert page(0, 5) == [1, 2, 3, 4, 5] == page(0, 3) + page(3, 3)


@pytest.mark.parametrize("matched,other", [(0, 7), (7, 0), (3, 9), (12, 2), (4, 1), (9, 9)])
def test_four_to_one(spark, matched, other):
    of = {i: [("C++", "l", "required", 1.0)] for i in range(matched)} or {0: []}
    jobs = spark.createDataFrame([posting(i, company=i) for i in range(matched + other)], P)
    rows = found(spark, of) if matched else found(spark, {10_000: [("C++", "l", "required", 1.0)]})
    got = [r["matched"] for r in rank.personalised(jobs, rows, ["C++"], 0, matched + other).collect()]
    want, m, o = [], matched, other
    for i in range(matched + other):
        explore = (i % 5 == 4 and o > 0) or m == 0
        want.append(not explore)
        m, o = m - (not explore), o - explore
    assert got == want


def test_companies_take_turns(spark):
    jobs = spark.createDataFrame([posting(i, company=1, day=20) for i in range(6)] + [posting(9, company=2, day=1)], P)
    assert [r["posting_id"] for r in rank.diverse(jobs, 0, 6).collect()] == [5, 4, 3, 2, 1, 9]


def test_keyset_cursor(spark):
    jobs = spark.createDataFrame([posting(i) for i in range(3)], P)
    ids = lambda a, n: [r["posting_id"] for r in rank.keyset(jobs, "first_seen_at", "posting_id", a, n).collect()]
    assert ids(None, 0) == [2] and ids((None, 1), 5) == [] and ids(("2026-07-01", 2), 5) == [1, 0] and ids((None, None), None) == [2, 1, 0]


def test_domains_named_in_titles_suppress_others(spark):
    rules = (career.Domain("a", "A", ("backend",), ("api",), ("spring",), ("java",)), career.Domain("b", "B", ("data",), ("etl", "pipeline"), ("spark",), ("sql",)))
    rows = [(1, "Backend lead", "etl pipeline", ["Spark", "SQL"]), (2, "Lead", "etl pipeline", []), (3, "Lead", "", ["spark", " SQL "]), (4, "Lead", "api", ["Java"]), (5, None, None, None)]
    df = career.classify(spark.createDataFrame(rows, "posting_id int, title string, body string, skills array<string>"), rules)
    assert {r["posting_id"]: [d["domain"] for d in r["found"]] for r in df.collect()} == {1: ["a"], 2: ["b"], 3: ["b"], 4: ["a"], 5: []}


def test_conditions(spark):
    df = spark.createDataFrame([("experienced", 3, 5, "정규직", "판교"), ("new_comer", None, None, "contract", "부산"), (None, None, None, None, None)], "c string, lo int, hi int, e string, l string")
    profile = {"experience_years": 4, "career_level": "senior", "employment_types": ["full_time"], "preferred_locations": ["성남"]}
    got = df.select(career.career_condition(profile, F.col("c"), F.col("lo"), F.col("hi")), career.employment_condition(profile, F.col("e")), career.location_condition(profile, F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("continues", "continues", "continues"), ("changes", "changes", "changes"), ("continues", "check", "check")]
    assert career.profile_kinds({"current_role": "Backend dev", "interest_domains": ["b"]}, (career.Domain("a", "A", ("backend",), (), (), ()), career.Domain("b", "B", (), (), (), ()), career.Domain("c", "C", (), (), ("x", "y"), ())), ["X", "Y"]) == {"a": "direct", "b": "interest", "c": "adjacent"}


def test_trend_waits_for_enough_weeks(spark):
    mondays = [date(2026, 6, 1 + 7 * i) for i in range(4)]
    demand = spark.createDataFrame([(d, "Python", 11 + i) for i, d in enumerate(mondays)], "observed_on date, skill string, posting_count long")
    assert [r["posting_count"] for r in market.weekly_trend(demand, 12).orderBy("week").collect()] == [11, 12, 13, 14]
    assert market.weekly_trend(demand, 12, minimum=5).count() == 0


def test_absence(spark):
    state = spark.createDataFrame([(1, 1, "open", 2), (2, 1, "open", 2), (3, 2, "open", 2), (4, 1, "closed", 1)], "posting_id long, source_id long, status string, missing_runs int")
    got = ingest.absence(state, spark.createDataFrame([(2,)], "posting_id long"), spark.createDataFrame([(1, True), (2, False)], "source_id long, complete boolean"))
    assert {r["posting_id"]: (r["status"], r["missing_runs"]) for r in got.collect()} == {1: ("closed", 3), 2: ("open", 0), 3: ("open", 2), 4: ("closed", 1)}


def test_quarantine(spark):
    jobs = spark.createDataFrame([(i, i, "open") for i in range(4)] + [(9, 1, "closed")], "posting_id long, source_id long, status string")
    now = datetime(2026, 7, 10)
    sources = spark.createDataFrame([(0, "allowed", None), (1, "blocked", None), (2, "blocked", datetime(2026, 7, 9)), (3, "stopped", datetime(2026, 7, 1))], "source_id long, status string, last_success_at timestamp")
    assert {r["posting_id"]: r["status"] for r in ingest.quarantine(jobs, sources, now).collect()} == {0: "open", 1: "delayed", 2: "open", 3: "delayed", 9: "closed"}


def test_revisions_once(spark):
    seen = spark.createDataFrame([(1, "x")], "posting_id long, content_hash string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x")], "posting_id long, content_hash string")
    assert sorted(map(tuple, ingest.new_revisions(seen, new, "posting_id", "content_hash").collect())) == [(1, "y"), (2, "x")]
    again = spark.createDataFrame([(1, None, "b")], "a int, b string, c string").select(identity.payload_hash("a", "b", "c").alias("h"), identity.payload_hash("c", "b", "a").alias("g")).first()
    assert again["h"] == again["g"]


def test_notice_limit_comes_before_what_was_sent(spark):
    by_company = spark.createDataFrame([("u", i, datetime(2026, 7, 1, i % 24, i)) for i in range(25)], "user_id string, posting_id long, first_seen_at timestamp")
    by_search = spark.createDataFrame([("u", 24, datetime(2026, 7, 1, 0, 24), 7)], "user_id string, posting_id long, first_seen_at timestamp, search_id int")
    none = spark.createDataFrame([], "user_id string, dedupe_key string")
    first = ingest.notifications(by_search, by_company, none).collect()
    assert len(first) == 20 and all(r["followed_company"] for r in first)
    sent = spark.createDataFrame([(r["user_id"], r["dedupe_key"]) for r in first], "user_id string, dedupe_key string")
    assert ingest.notifications(by_search, by_company, sent).count() == 0


def test_skill_resync(spark):
    schema = "posting_id long, skill string, category string, requirement_type string"
    now = spark.createDataFrame([(1, "a", "l", "required"), (1, "b", "l", "required"), (1, "c", "l", "required")], schema)
    new = spark.createDataFrame([(1, "a", "l", "required"), (1, "b", "l", "preferred"), (1, "d", "l", "required")], schema)
    assert sorted((r["skill"], r["action"]) for r in evidence.resync(now, new).collect()) == [("b", "update"), ("c", "delete"), ("d", "insert")]


def test_health_order(spark):
    at = datetime(2026, 7, 2)
    rows = [("blocked", "allowed", at, None), ("allowed", "stopped", at, None), ("allowed", "review", at, None), ("allowed", "allowed", at, "blocked"), ("allowed", "allowed", at, ""), ("allowed", "allowed", None, None), ("needs_browser", "allowed", at, None)]
    df = spark.createDataFrame(rows, "status string, policy_status string, last_success_at timestamp, last_error_code string")
    assert [r[0] for r in df.select(source_health.health(datetime(2026, 7, 1))).collect()] == ["blocked", "stopped", "pending", "failing", "healthy", "stale", "pending"]


def test_client_state(spark):
    df = spark.createDataFrame([(1, ["a", "b", " a ", "", "c" * 201]), (2, [str(i) for i in range(30)])], "user_id int, ids array<string>")
    got = {r["user_id"]: r["ids"] for r in community.keep_last(df, "user_id", "ids").collect()}
    assert got == {1: ["b", "a"], 2: [str(i) for i in range(6, 30)]}
    assert community.keep_first(spark.createDataFrame([(1, ["Go", "go", "AWS"])], "user_id int, s array<string>"), "user_id", "s").first()["s"] == ["AWS", "Go"]


@pytest.fixture(scope="module")
def named(spark):
    """Confidence by skill of each line, all lines in one job."""

    def run(lines):
        df = spark.createDataFrame(list(enumerate(lines)), "posting_id int, body string")
        out = [{} for _ in lines]
        for r in skill_mentions.extract(df, title=None, page=None, text="body").collect():
            out[r["posting_id"]][r["skill"]] = r["confidence"]
        return out

    return run


RISKY_LINES = [
    ("Experience with Go language", "Go", True), ("We go to market", "Go", False), ("run go test daily, a programming task", "Go", True), ("C/C++ developer", "C", True), ("Vitamin C intake", "C", False), ("R&D center", "R", False), ("Python, R users", "R", True), ("C++17 required", "C++", True),
    ("React quickly to change", "React", False), ("frontend with React", "React", True), ("Spring 2026 intern", "Spring", False), ("Java and Spring backend", "Spring", True), ("we can do it", "CAN", False), ("vehicle CAN, LIN", "CAN", True), ("node.js or NodeJS.", "Node.js", True), ("JavaScript", "Java", False), ("쿠버네티스 운영", "Kubernetes", True),
]


def test_risky_names(named):
    more = [("C++20, C++11 and C++23", "C++", True), ("C++18", "C++", False), ("xC++17", "C++", False), ("go.mod file", "Go", False), ("go build in a server", "Go", True), ("go tests", "Go", False), ("Python", "Python", True), ("Python3", "Python", False), ("파이썬을 씁니다", "Python", True), ("İ Python İ", "Python", True)]
    cases = [*RISKY_LINES, *more]
    got = named([line for line, _, _ in cases])
    assert [(line, skill) for (line, skill, ok), found in zip(cases, got) if (found.get(skill, 0) >= skills.CONFIRMED) != ok] == []


def test_dictionary_is_whole(spark):
    assert len(skills.DICTIONARY) == len({s.name for s in skills.DICTIONARY}) == 155 and all(s.kind and s.domains for s in skills.DICTIONARY)
    policies = [a.policy for s in skills.DICTIONARY for a in s.aliases]
    assert (policies.count("contextual"), policies.count("strict")) == (44, 4)
    assert skills.catalog(spark).count() == 155
    typed = spark.createDataFrame([(1, "JS"), (2, "spark"), (3, "노드"), (4, "graphql")], "id int, skill string")
    assert [r["skill"] for r in skills.canonical(typed, "skill").orderBy("id").collect()] == ["JavaScript", "Apache Spark", "Node.js", "GraphQL"]


def test_risky_names_need_their_words(named):
    cases = [(s.name, f"{a.value} {word}", True) for s in skills.DICTIONARY for a in s.aliases if a.policy != "distinct" for word in a.context]
    cases += [(s.name, f"{a.value} zzz", False) for s in skills.DICTIONARY for a in s.aliases if a.policy != "distinct"]
    got = named([line for _, line, _ in cases])
    assert [(name, line) for (name, line, sure), found in zip(cases, got) if (found.get(name, 0) >= skills.CONFIRMED) != sure] == []


def test_distinct_names_are_found(named):
    cases = [(s.name, f"uses {a.value} daily") for s in skills.DICTIONARY for a in s.aliases if a.policy == "distinct"]
    assert [c for c, found in zip(cases, named([line for _, line in cases])) if found.get(c[0]) != 1.0] == []


def test_sections(spark):
    page = "<p><b>자격 요건</b></p><ul><li>one</li><li>two 우대</li></ul><h3>Tech stack</h3><p>three</p><h3>Benefits</h3><div>four</div>"
    df = spark.createDataFrame([(1, "", page, "unread"), (2, " a  title ", "<h2>x</h2>", "Requirements:\none. two required\n\nBenefits\nthree"), (3, None, None, None)], "posting_id int, title string, page string, body string")
    got = {(r["posting_id"], r["position"], r["text"]): (r["requirement_type"], r["technical"], r["list_item"]) for r in skill_mentions.blocks(df, "posting_id", "title", "page", "body").collect()}
    assert got == {
        (1, 0, "one"): ("required", False, True), (1, 1, "two 우대"): ("preferred", False, True), (1, 2, "three"): ("unspecified", True, False), (1, 3, "four"): ("unspecified", False, False),
        (2, 0, "a title"): ("unspecified", False, False), (2, 1, "one."): ("required", False, False), (2, 2, "two required"): ("required", False, False), (2, 3, "three"): ("unspecified", False, False),
    }
    lines = "\n" * 50_000 + "Requirements\n" + "Python\n" * 3000
    assert skill_mentions.blocks(spark.createDataFrame([(1, lines)], "k int, t string"), "k", None, None, "t").filter("requirement_type = 'required'").count() == 3000


def test_structured_text():
    assert markup.structured_text("<h2>A</h2><p>b<br>c</p><ul><li>d <b>e</b></li></ul><script>x</script><h4>F</h4>") == "## A\nb\nc\n• d e\n### F"
    assert markup.structured_text("&lt;p&gt;one&lt;/p&gt;&lt;p&gt;two&lt;/p&gt;") == "one\ntwo"
    assert markup.structured_text("", " a \n\n b ") == "a\nb" and markup.structured_text(None, None) == "" and markup.structured_text("<p>a</p>", "a and more") == "a\nand more"


def test_images():
    page = '<img src="/a.png" alt="body"><img src="http://x.example/b.png"><img data-src="https://x.example/c.jpg"><img src="https://other.example/d.png"><img src="/logo.png"><img src="/e.png" width="20" height="20px"><img id="site-icon" src="/f.png"><img src="https://u:p@x.example/g.png"><img src="/a.png#again">'
    assert [i["url"] for i in markup.images(page, "", "https://x.example/jobs/1")] == ["https://x.example/a.png", "https://x.example/c.jpg"]
    assert markup.images(page, "long " * 200, "https://x.example/") == [] and markup.images(page, "", "http://x.example/") == [] and markup.images(page, "", None) == []
    four = "".join(f'<img src="/{i}.png" width="20">' for i in range(4))
    assert [i["alt"] for i in markup.images(four, "", "https://x.example/")] == [f"채용 공고 상세 내용 이미지 {i}" for i in (1, 2, 3)]


def test_payloads():
    assert openings.decode("cb([1]);") == [1] and listing_checks.verdict(None)["state"] == "listing_parse_error"
    assert listing_checks.verdict('{"data":{"jobs":[{"id":1}]}}')["rows"] == 1
    got = openings.board('{"jobPostings":[{"title":"T","externalPath":"/job/1","bulletFields":["R1"],"locationsText":"Seoul"}]}', "https://w.example/", "workday")[0]
    assert (got["external_id"], got["url"], got["location"]) == ("R1", "https://w.example/job/1", "Seoul")


def test_text_rules(spark):
    df = spark.createDataFrame([("  a \t b ", "[## Nice  to Have!]", "신입/경력")], "a string, h string, c string")
    r = df.select(text.collapsed(F.col("a")), text.heading(F.col("h")), text.career_words(F.col("c")), text.clipped(F.lit("x" * 200)), text.character_sum(F.lit("ab"), 4), text.relevance(F.lit("Python"), "py")).first()
    assert tuple(r) == ("a b", "nice to have", "mixed", "x" * 119 + "…", (97 + 98) % 4, 1)
    day = spark.range(1).select(tm.local_date(F.to_timestamp(F.lit("2026-06-30 15:00:00"))).alias("d"), tm.iso_week(F.to_date(F.lit("2027-01-01"))).alias("w"), tm.local_midnight(F.lit(date(2026, 7, 1))).alias("m"), tm.relative_label(F.to_timestamp(F.lit("2026-01-01")), F.to_timestamp(F.lit("2026-01-03"))).alias("r")).first()
    assert (day["d"], day["w"], day["m"], day["r"]) == (date(2026, 7, 1), "2026-W53", datetime(2026, 6, 30, 15), "2d")


def test_library_stands_without_the_llm_subpackage():
    import ast
    from pathlib import Path

    root = Path(__file__).parents[1]
    for path in [*root.glob("tidemark/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("tidemark.llm", "corpus_pipeline")) for n in names), path


def test_upsert_takes_a_repeated_key_once(spark):
    from tidemark.operators import ingest

    state = spark.createDataFrame([(1, "a", "u1", "A", "open", "2024-01-02", "2024-01-02", 2), (2, "b", "u1", "B", "open", "2024-01-01", "2024-01-01", 0), (3, "c", "u3", "C", "open", "2024-01-03", "2024-01-03", 1)], "source_id int, external_id string, url string, title string, status string, first_seen_at string, last_seen_at string, missing_runs int")
    for c in ("first_seen_at", "last_seen_at"):
        state = state.withColumn(c, F.col(c).cast("timestamp"))
    batch = spark.createDataFrame([(9, "z", "u1", "first", "open", 1), (9, "z", "u1", "last", "open", 2), (9, "y", "u9", "new", "open", 1), (9, "y", "u8", "newer", "open", 3), (3, "c", "u3", "C2", "open", 1), (3, "c", "u3", "C3", "open", 0)], "source_id int, external_id string, url string, title string, status string, at int")
    got = {(r["source_id"], r["external_id"]): r for r in ingest.upsert(state, batch, "2025-01-01", "at").collect()}
    assert {k: (r["title"], r["action"]) for k, r in got.items()} == {(9, "z"): ("last", "move"), (9, "y"): ("newer", "insert"), (3, "c"): ("C2", "update")}
    assert str(got[9, "z"]["first_seen_at"])[:10] == "2024-01-01"
    assert ingest.upsert(state, batch.limit(0), "2025-01-01").count() == 3


def test_a_null_family_is_no_total(spark):
    from tidemark.operators import source_health

    items = spark.createDataFrame([("f", "healthy", 3, 1), (None, "stale", 2, 0)], "family string, health string, open_postings long, tech_open_postings long")
    got = source_health.family_health(items).collect()
    assert sorted((r["is_total"], r["family"] or "", r["sources"]) for r in got) == [(False, "", 1), (False, "f", 1), (True, "", 2)]


@pytest.mark.parametrize("page,want", [("<div class=G-reCAPTCHA>", True), ("Please verify you are human", True), ("CAPTCHA abuse detection experience", False), ("access denied events in logs", False), (None, None)])
def test_challenges(spark, page, want):
    from tidemark.sources import listing_checks

    assert spark.createDataFrame([(page,)], "p string").select(listing_checks.challenge(F.col("p"))).first()[0] is want


def named(df, expression):
    """How often an expression stands in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toJSON().count(f"expressions.{expression}\"")


def test_domains_look_for_terms_once(spark):
    openings = spark.range(2).select(F.concat(F.lit("Title  "), "id").alias("title"), F.concat(F.lit("Body  "), "id").alias("body"), F.array(F.lit("Kafka")).alias("skills"))
    assert named(career.classify(openings), "ArrayFilter") <= 40


def test_domains_read_texts_to_their_end(spark, tmp_path):
    from tests import oracle
    from tidemark.plans import role_queries

    texts = [(3, "x " * 50_000 + "서버 개발, 분산 시스템"), (13, "x" * 1998 + "제품 전략"), (19, "x " * 500 + "서버 개발, 분산 시스템"), (35, "제품 전략"), (4, None), (6, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = role_queries.QUERIES["document_domains"], role_queries.ORACLE["document_domains"]
    found = {(r["doc_id"], r["domain"]) for r in query(spark, str(tmp_path)).collect()}
    assert {(3, "backend"), (13, "product"), (19, "backend")} <= found
    assert oracle.compare(spark, oracle.connect(str(tmp_path)), query, sql, str(tmp_path)) == ""


def test_blocks_strip_a_heading_once_a_unit(spark):
    rows = spark.createDataFrame([(1, "Requirements\nPython\n" + "-" * 120 + " Benefits\nGo must\n" + "Benefits " + "=" * 120 + "\nJava " * 40 + "\nPreferred:\nSQL")], "posting_id long, text string")
    found = skill_mentions.blocks(rows, "posting_id", None, None, "text")
    kinds = [(r["text"][:4].strip(), r["requirement_type"]) for r in found.orderBy("position").collect()]
    assert kinds == [("Pyth", "required"), ("Go m", "required"), *[("Java", "unspecified")] * 40, ("SQL", "preferred")]
    assert named(found, "RegExpReplace") <= 15


def test_names_in_texts_overlap_and_count_once_a_text(spark):
    texts = spark.createDataFrame([("JavaScript and java, Java",), ("a script",), (None,), ("",)], "t string")
    found = skill_mentions.said_in(texts, "t", ["java", "javascript", "script", "go"])
    assert {r["name"]: r["documents"] for r in found.collect()} == {"java": 1, "javascript": 1, "script": 2}
    assert named(found, "Contains") == 0


def test_pages_of_parts_are_dealt_to_all_tasks(spark, sf):
    from tidemark.plans import skill_queries

    assert skill_queries.made_pages(spark, sf).rdd.getNumPartitions() == 4


def test_many_mentions_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(evidence, "ROWS", 10)
    rows = spark.range(100).select((F.col("id") % 30).alias("posting_id"), F.lit("Go").alias("skill"), F.lit("language").alias("category"), F.lit("required").alias("requirement_type"), F.lit(True).alias("confirmed"))
    best = evidence.best_mentions(rows, 100)
    assert best.count() == 30 and "REPARTITION_BY_NUM" in best._jdf.queryExecution().executedPlan().toString() and best.rdd.getNumPartitions() == 10


def test_searches_gather_evidence_of_the_window_only(spark, four):
    jobs = spark.createDataFrame([posting(i) for i in (1, 2, 3, 4)], P)
    searches = spark.createDataFrame([("u", 1, "s", "", "language", "", datetime(2026, 6, 20), datetime(2026, 6, 20))], "user_id string, search_id int, name string, query_text string, category string, career_type string, last_checked_at timestamp, updated_at timestamp")
    plan = ingest.search_matches(searches, jobs, four, datetime(2026, 7, 2))._jdf.queryExecution().analyzed().toString()
    below = plan[plan.index("collect_set(category") :].split("\n")[1:5]
    assert any("Join LeftSemi" in line for line in below), below


def test_many_items_meet_many_parts_in_more_tasks(spark, sf, monkeypatch):
    from tidemark.plans import analog

    few = analog.mentions(spark, sf)
    monkeypatch.setattr(evidence, "ROWS", 500)
    monkeypatch.setattr(analog, "HELD_PARTS", 10)
    many = analog.mentions(spark, sf)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and many.rdd.getNumPartitions() == 12
    assert many.exceptAll(few).isEmpty() and many.count() == few.count()


@pytest.mark.parametrize("more,join", [(0, "BroadcastHashJoin"), (100_001, "ShuffledHashJoin")])
def test_many_items_are_not_sorted_for_parts_that_spark_would_not_broadcast(spark, sf, tmp_path, monkeypatch, more, join):
    from tidemark.plans import analog

    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand")
    part.unionByName(spark.range(more).select((-F.col("id") - 1).alias("p_partkey"), F.lit("Brand#0").alias("p_brand"))).write.parquet(f"{tmp_path}/part.parquet")
    (tmp_path / "lineitem.parquet").symlink_to(f"{sf}/lineitem.parquet")
    few = analog.mentions(spark, sf)
    monkeypatch.setattr(evidence, "ROWS", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = analog.mentions(spark, str(tmp_path))
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert join in plan and "SortMergeJoin" not in plan
        assert many.exceptAll(few).isEmpty() and many.count() == few.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_strict_pages_are_cut_as_by_the_library():
    import random

    from tidemark.plans.skill_queries import MADE

    pieces = ["<p>", "</p>", "<P class=\"a b\">", "<br>", "<br/>", "<img src=\"x?a=1&amp;b\" alt=\"\"/>", "<script>", "</script>", "<script>var a=1&amp;2;</script>", "<script>x='<p>no</p>'", "</scripts>", "</style ", "</SCRIPT>", "<style>p{}</style >", "<template>", "</template>", "<noscript>", "</noscript>", "<!-- c -->", "<!doctype html>", "<title>", "</title>", "a &amp; b", "&lt", "&", " < ", ">", "\n", "<a href=x>", "</a>", "<a href='y'>", "<li >", "<td\nid=\"q\">", "</", "<", "</br>", "<script/>", "<template/>", "<plaintext>", "</p x>", "</script", "\"", "<h1>"]
    rng = random.Random(7)
    pages = ["".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(30_000)]

    def joined(found):
        out = []
        for kind, value in found:
            if out and out[-1][0] == kind in ("text", "hidden"):
                out[-1] = (kind, out[-1][1] + value)
            else:
                out.append((kind, value))
        return out

    for page in pages:
        assert joined(markup.plain_events(page)) == joined((k, v) for k, v, _ in markup.events(page)), page
    called = []
    original, markup.events = markup.events, lambda page: called.append(page)
    try:
        markup.plain_events(MADE)
    finally:
        markup.events = original
    assert not called  # pages of parts never need the library's parser


@pytest.mark.parametrize("name", ["graph_atlas_nodes", "graph_nodes", "graph_query_nodes", "graph_unknown_seed"])
def test_graph_queries_over_many_items_and_parts(spark, sf, monkeypatch, name):
    """The same rows where items and parts are dealt by their number."""
    from tests import oracle
    from tidemark.plans import analog, catalog

    monkeypatch.setattr(evidence, "ROWS", 500)
    monkeypatch.setattr(analog, "HELD_PARTS", 10)
    assert oracle.compare(spark, oracle.connect(sf), catalog.QUERIES[name], catalog.ORACLE[name], sf) == ""


@pytest.mark.parametrize("name", ["graph_nodes", "graph_query_nodes", "graph_unknown_seed"])
def test_graph_queries_sort_no_items_for_parts(spark, sf, monkeypatch, name):
    """The same rows where items are many and Spark would broadcast nothing by itself."""
    from tests import oracle
    from tidemark.plans import catalog

    met, best = [], evidence.best_mentions
    monkeypatch.setattr(evidence, "ROWS", 500)
    monkeypatch.setattr(evidence, "best_mentions", lambda mentions, rows=None: best(met.append(mentions) or mentions, rows))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert oracle.compare(spark, oracle.connect(sf), catalog.QUERIES[name], catalog.ORACLE[name], sf) == ""
        assert met and all("SortMergeJoin" not in m._jdf.queryExecution().executedPlan().toString() for m in met)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
