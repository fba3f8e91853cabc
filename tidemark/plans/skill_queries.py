"""Skill mentions over documents and pages made from parts, with SQL that looks for every spelling by its own regex."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import skills
from tidemark.functions.skills import DICTIONARY
from tidemark.operators import skill_mentions as sm
from tidemark.plans.analog import spread, table
from tidemark.sources import markup

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


#: What postings say below a document's text, by number modulo their count.
SAID = (
    "# Requirements #\nPython, Go and PostgreSQL\nC/C++17 experience. C++ required!\n\nPreferred:\nKafka",
    "[자격 요건]\nPython, R 활용 필수\n우대 사항\nSQL 가능자\n주요 업무\nR&D 지원",
    "React quickly to requests. A spring 2026 intern.\nWe go to market with go test, a programming task",
    "기술 스택\nJava, Spring, 쿠버네티스\nBenefits\nVitamin C and swift payment; CAN bus",
    "Nice to have\nC++11 / C++14 / C++20 and Node.js\nResponsibilities\nrust-proof paint, Rust developer",
    "이런 기술이 필요해요\nReact와 TypeScript\n이런 분이면 더 좋아요\nDocker or K8s is a plus. AWS must",
    "R & D\nData analytics in R. Vehicle CAN, LIN networks\nreact",
)


def postings(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.pmod("doc_id", F.lit(len(SAID))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("posting_id"), F.substring("text", 1, 60).alias("title"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("body"))


def quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


SPACE = r"[\s\p{Z}\x0b\x{85}]"
WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
HEADING = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '^#+{SPACE}*', ''), '^[\\[\\]【】(){{}}]+|[\\[\\]【】(){{}}]+$', '', 'g'), '^[^{WORD}]+|[^{WORD}]+$', '', 'g'), '{SPACE}+', ' ', 'g'))"


def has(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in phrases) + ")"


def blocks_sql(units: str) -> str:
    """Blocks of (key, i, kind, t): kind title, line, heading, item, label or text; i in order."""
    return f"""
      u AS (SELECT key, i, kind, t, {HEADING} AS h FROM ({units})),
      m AS (SELECT *, CASE WHEN kind = 'heading' OR (kind NOT IN ('item', 'title') AND length(t) <= CASE kind WHEN 'line' THEN 100 ELSE 80 END) THEN CASE WHEN {has('h', sm.PREFERRED)} THEN 'preferred' WHEN {has('h', sm.REQUIRED)} THEN 'required' WHEN {has('h', sm.TECHNICAL)} THEN 'technical' END END AS opens FROM u),
      n AS (SELECT *, opens IS NOT NULL OR kind = 'heading' OR (kind = 'line' AND list_contains({listed(sm.RESET)}, h)) AS heads FROM m),
      s AS (SELECT *, last_value(CASE WHEN heads THEN struct_pack(o := coalesce(opens, 'none'), w := opens = 'required' AND contains(h, '{sm.WANTED_SKILLS}')) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM n),
      b AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS INT) AS position, t AS text, kind = 'item' AS list_item, kind <> 'title' AND (coalesce(sec.o = 'technical', FALSE) OR coalesce(sec.w, FALSE)) AS technical,
              CASE WHEN kind = 'title' THEN 'unspecified' WHEN regexp_matches(t, '{sm.SAYS_PREFERRED}') THEN 'preferred' WHEN regexp_matches(t, '{sm.SAYS_REQUIRED}') THEN 'required' WHEN sec.o IN ('preferred', 'required') THEN sec.o ELSE 'unspecified' END AS requirement_type
            FROM s WHERE NOT heads AND kind <> 'label')"""


def lines_sql(key: str, title: str, body: str, source: str) -> str:
    split = rf"string_split(regexp_replace({body}, '([.!?。]){SPACE}+', '\1' || chr(10), 'g'), chr(10))"
    clean = lambda x: f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'), ' ')"
    return f"SELECT * FROM (SELECT {key} AS key, 0 AS i, 'title' AS kind, {clean(title)} AS t FROM {source} UNION ALL SELECT key, i, 'line', {clean('p')} FROM (SELECT {key} AS key, unnest({split}) AS p, unnest(range(1, len({split}) + 1)) AS i FROM {source})) WHERE t <> ''"


POSTED = f"(SELECT doc_id, substring(coalesce(text, ''), 1, 60) AS title, coalesce(text, '') || chr(10) || {listed(SAID)}[doc_id % {len(SAID)} + 1] AS body FROM documents)"
POSTED_BLOCKS = "WITH " + blocks_sql(lines_sql("doc_id", "title", "body", POSTED))


def alias_rows() -> str:
    """(alias, skill, category, policy, regex, never, context) of every spelling, as VALUES."""
    edge, rows, n = "[^A-Za-z0-9_+#.]", [], 0
    for s in DICTIONARY:
        for a in s.aliases:
            body, case = re.escape(a.value), "" if a.case else "(?i)"
            found = [f"{case}(?:^|{edge}){body}(?:$|{edge})" if any(c.isascii() and c.isalnum() for c in a.value) else case + body]
            found += [f"(?:^|{edge}){re.escape(f)}(?:$|[^\\p{{L}}\\p{{N}}_])" for f in a.forms]
            never = "(?i)" + "|".join(f"(?:{x})" for x in a.never) if a.never else "$^x"
            literals = listed([a.value.lower(), *a.forms])
            rows.append(f"({n}, {quoted(s.name)}, {quoted(s.category)}, {quoted(a.policy)}, {quoted('|'.join(f'(?:{x})' for x in found))}, {quoted(never)}, {listed(t.lower() for t in a.context) if a.context else '[]::VARCHAR[]'}, {literals})")
            n += 1
    return "(VALUES " + ", ".join(rows) + ") a(alias, skill, category, policy, re, never, context, words)"


def best_sql() -> str:
    """The best mention per key and skill of blocks b."""
    cases = " ".join(f"WHEN '{r}' THEN {c}" for r, c in sm.CONFIDENCE.items())
    return f"""
      f AS (SELECT b.*, a.alias, a.skill, a.category, a.policy, len(list_filter(a.context, lambda x: contains(lower(b.text), x))) > 0 AS vouched
            FROM b JOIN {alias_rows()} ON len(list_filter(a.words, lambda x: contains(lower(b.text), x))) > 0 AND regexp_matches(regexp_replace(b.text, a.never, chr(1), 'g'), a.re)),
      d AS (SELECT *, list(CASE WHEN policy = 'distinct' THEN skill END) OVER (PARTITION BY key, position) AS names FROM f),
      e AS (SELECT *, list_filter(names, lambda x: x IS NOT NULL AND x <> skill) AS company FROM d),
      r AS (SELECT *, technical OR (len(company) > 0 AND (list_item OR regexp_matches(text, '{sm.SEPARATES}'))) AS likely FROM e),
      g AS (SELECT *, CASE WHEN policy = 'distinct' THEN 'distinct_alias' WHEN policy = 'strict' AND skill = 'C' AND regexp_matches(text, '(?:^|[^A-Za-z0-9_+#.])C\\s*/\\s*C\\+\\+') THEN 'strict_compound_alias'
              WHEN policy = 'strict' AND skill = 'R' AND list_has_any(company, ['Python', 'SQL']) THEN 'strict_data_language_list' WHEN vouched AND policy = 'strict' THEN 'strict_alias_with_context' WHEN vouched THEN 'contextual_alias_with_terms'
              WHEN likely THEN policy || '_alias_with_section' ELSE 'ambiguous_alias_candidate' END AS match_reason FROM r),
      c AS (SELECT *, CAST(CASE match_reason {cases} END AS DOUBLE) AS confidence FROM g),
      k AS (SELECT *, confidence >= 0.8 AS confirmed FROM c QUALIFY row_number() OVER (PARTITION BY key, skill ORDER BY confidence >= 0.8 DESC, CASE requirement_type WHEN 'required' THEN 3 WHEN 'preferred' THEN 2 ELSE 1 END DESC, confidence DESC, position, alias) = 1)"""


@query(f"{POSTED_BLOCKS} SELECT key AS posting_id, position, sha256(text) AS text_sha256, requirement_type, technical, list_item FROM b")
def evidence_blocks(spark, sf_dir):
    found = sm.blocks(postings(spark, sf_dir), "posting_id", "title", None, "body")
    return found.select("posting_id", "position", F.sha2("text", 256).alias("text_sha256"), "requirement_type", "technical", "list_item")


@query(f"{POSTED_BLOCKS}, {best_sql()} SELECT key AS posting_id, skill, category, requirement_type, sha256(text) AS evidence_sha256, confidence, match_reason, confirmed FROM k")
def skill_extraction(spark, sf_dir):
    found = sm.extract(postings(spark, sf_dir), "posting_id", "title", None, "body")
    return found.select("posting_id", "skill", "category", "requirement_type", F.sha2("evidence_text", 256).alias("evidence_sha256"), "confidence", "match_reason", "confirmed")


@query("WITH " + blocks_sql(lines_sql("doc_id", "substring(coalesce(text, ''), 1, 60)", "coalesce(text, '')", "documents")) + f", {best_sql()} SELECT skill, requirement_type, confirmed, count(*) AS n FROM k GROUP BY 1, 2, 3")
def document_skills(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), "text")
    return sm.extract(docs, "doc_id", "title", None, "text").groupBy("skill", "requirement_type", "confirmed").agg(F.count("*").alias("n"))


#: Pages made from parts: headings, items, a label, a paragraph inside an item, a reset.
HEADS = ("Minimum Qualifications", "Preferred", "Tech stack", "About us", "Team", "이런 기술이 필요해요")
PAGE = "'<h2>' || {head} || '</h2><ul><li>' || p_name || ', Python</li><li><p>' || p_type || ' is a plus</p></li></ul><p><b>nice to have</b></p><div>' || p_brand || ' Kafka</div><div><span>must know</span> C++20</div><h3>Benefits</h3><p>' || CAST(p_size AS STRING) || ' and Go</p>'"
PARTS_HEAD = f"{listed(HEADS)}[p_partkey % {len(HEADS)} + 1]"


@query(
    "WITH "
    + blocks_sql(
        f"""SELECT * FROM (SELECT p_partkey AS key, unnest(range(0, 8)) AS i, unnest(['title', 'heading', 'item', 'item', 'label', 'text', 'text', 'heading']) AS kind,
        unnest([p_brand, {PARTS_HEAD}, p_name || ', Python', p_type || ' is a plus', 'nice to have', p_brand || ' Kafka', 'must know C++20', 'Benefits']) AS t FROM part UNION ALL SELECT p_partkey, 8, 'text', CAST(p_size AS VARCHAR) || ' and Go' FROM part)"""
    )
    + f", {best_sql()} SELECT key AS posting_id, skill, requirement_type, confidence, match_reason FROM k"
)
def page_skills(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.pmod("p_partkey", F.lit(len(HEADS))) + 1).cast("int"))
    parts = spread(table(spark, sf_dir, "part"), "p_partkey").withColumn("head", head).select(F.col("p_partkey").alias("posting_id"), F.col("p_brand").alias("title"), F.expr(PAGE.format(head="head")).alias("page"), F.lit("never read, Java").alias("text"))
    return sm.extract(parts, "posting_id", "title", "page", "text").select("posting_id", "skill", "requirement_type", "confidence", "match_reason")


TYPED = [v for s in DICTIONARY for v in (s.name, *s.inputs)]
CANONICAL = {" ".join(v.split()).casefold(): s.name for s in DICTIONARY for v in (s.name, *(a.value for a in s.aliases), *s.inputs)}


@query(
    f"SELECT p_partkey, coalesce(c.name, typed) AS skill FROM (SELECT p_partkey, trim(regexp_replace(CASE p_partkey % 3 WHEN 0 THEN '  ' || upper(v) WHEN 1 THEN v || ' ' ELSE v || '   ' || p_brand END, '\\s+', ' ', 'g')) AS typed FROM (SELECT p_partkey, p_brand, {listed(TYPED)}[p_partkey % {len(TYPED)} + 1] AS v FROM part)) LEFT JOIN (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in CANONICAL.items())}) c(k, name) ON lower(typed) = k"
)
def canonical_skills(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, TYPED)), (F.pmod("p_partkey", F.lit(len(TYPED))) + 1).cast("int"))
    k = F.pmod("p_partkey", F.lit(3))
    typed = F.when(k == 0, F.concat(F.lit("  "), F.upper(v))).when(k == 1, F.concat(v, F.lit(" "))).otherwise(F.concat(v, F.lit("   "), "p_brand"))
    return skills.canonical(table(spark, sf_dir, "part").select("p_partkey", typed.alias("skill")), "skill")


@query(
    f"SELECT s.skill, s.category, s.kind, s.domains, count(d.doc_id) AS documents FROM (VALUES {', '.join(f'({quoted(s.name)}, {quoted(s.category)}, {quoted(s.kind)}, {quoted(chr(44).join(s.domains))})' for s in DICTIONARY)}) s(skill, category, kind, domains) LEFT JOIN documents d ON contains(lower(d.text), lower(s.skill)) GROUP BY ALL"
)
def skill_catalog(spark, sf_dir):
    """The dictionary as rows, each with the documents that write its name anywhere."""
    known = skills.catalog(spark).withColumn("name", F.lower("skill"))
    said = sm.said_in(table(spark, sf_dir, "documents"), "text", [s.name.lower() for s in DICTIONARY])
    return known.join(F.broadcast(said), "name", "left").select("skill", "category", "kind", F.array_join("domains", ",").alias("domains"), F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


#: A page of a part: %1$d its number, %2$s its name, %3$s its type.
MADE = (
    '<html><head><style>p{}</style></head><body><h1>%2$s</h1><p>kind:  %3$s<br>second <b>line</b></p><ul><li>one %1$d</li><li><a href="/p/%1$d">go  there</a></li></ul><script>var x="<p>no</p>"</script>'
    '<h4>Deep</h4><div>a &amp; b</div><img src="/i/%1$d.png" alt=" part "><img src="/logo.png"><img data-src="https://parts.example/j/%1$d.png#x" width="20"><img src="https://other.example/k.png"><a href="https://other.example/">out</a></body></html>'
)


def made_pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.format_string(MADE, "p_partkey", "p_name", "p_type").alias("page"))


@query("SELECT p_partkey, '## ' || p_name || chr(10) || 'kind: ' || p_type || chr(10) || 'second line' || chr(10) || '• one ' || p_partkey || chr(10) || '• go there' || chr(10) || '### Deep' || chr(10) || 'a & b' || chr(10) || 'out' AS text FROM part")
def made_page_text(spark, sf_dir):
    return made_pages(spark, sf_dir).select("p_partkey", markup.html_text("page").alias("text"))


@query("SELECT p_partkey, 'https://parts.example/p/' || p_partkey AS url, 'go there' AS text FROM part UNION ALL SELECT p_partkey, 'https://other.example/', 'out' FROM part")
def made_page_links(spark, sf_dir):
    found = made_pages(spark, sf_dir).select("p_partkey", F.explode(markup.html_links("page", F.lit("https://parts.example/list"))).alias("l"))
    return found.select("p_partkey", "l.url", "l.text")


@query("SELECT p_partkey, 'https://parts.example/i/' || p_partkey || '.png' AS url, 'part' AS alt FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'https://parts.example/j/' || p_partkey || '.png', '채용 공고 상세 내용 이미지 2' FROM part WHERE p_partkey % 5 <> 0")
def made_page_images(spark, sf_dir):
    """Every fifth part says enough to need no picture."""
    text = F.when(F.col("p_partkey") % 5 == 0, F.repeat(F.lit("enough "), 100)).otherwise("short")
    found = made_pages(spark, sf_dir).select("p_partkey", F.explode(markup.description_images("page", text, F.lit("https://parts.example/list"))).alias("i"))
    return found.select("p_partkey", "i.url", "i.alt")
