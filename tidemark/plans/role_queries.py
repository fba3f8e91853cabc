"""Technical roles, filters of sources, and fields of work: titles and lines by number before and below the documents' texts, profiles from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels, roles
from tidemark.functions.domains import DOMAINS, WORK_TYPES
from tidemark.operators import career, opening_filters
from tidemark.plans.analog import table
from tidemark.plans.skill_queries import has, listed, quoted

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


TITLES = (
    "[KT] Backend Engineer", "[KT Cloud] Cloud Platform Developer", "[KT Cloud] 시설 엔지니어", "Sales Manager", "(KR) Data Engineer", "Talent  Pool 개발자", "전기/기계 엔지니어", "Site Reliability Engineer", "Product Manager", "게임 클라이언트 개발", "ML Engineer / LLM engineer",
    "KR embedded firmware", "보안 엔지니어", "Marketing", "Editor", "Robot engineer, QA engineer",
)
LINES = (
    "aws and kafka", "TECH", "software engineering", "기술 it/it", "그룹 정보보안", "공조 시공", "데이터 파이프라인 etl 지표 분석", "api 개발 분산 시스템", "모델 학습 rag llm", "배포 자동화 ci/cd 관측성", "테스트 자동화", "nothing", "python sql",
)
PLACES = ("Seoul, Korea", "성남시", "Berlin", "", "Pangyo")
FAMILIES = (*opening_filters.RULES, "some_other_board")


def by_number(values, shift: int = 0):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("doc_id") + shift, F.lit(len(values))) + 1).cast("int"))


def openings(spark, sf_dir, whole: bool = False):
    """Openings from documents, every fifth with a line alone; without ``whole`` only the first 2,000 characters of a text, as the SQL of technical_roles and source_opening_filters has it."""
    d = table(spark, sf_dir, "documents")
    said = F.col("text") if whole else F.substring("text", 1, 2000)
    text = F.when(F.col("doc_id") % 5 == 0, by_number(LINES)).otherwise(F.concat(said, F.lit(" "), by_number(LINES)))
    return d.select("doc_id", by_number(TITLES).alias("title"), text.alias("description_text"), by_number(PLACES, 3).alias("location"), F.lit("https://seoul.example/jobs").alias("url"), by_number(FAMILIES, 1).alias("family"), (F.col("doc_id") % 11 != 0).alias("targets_technical_roles"))


def numbered(values, shift: int = 0) -> str:
    return f"{listed(values)}[(doc_id + {shift}) % {len(values)} + 1]"


def openings_sql(text: str) -> str:
    return f"""o AS (SELECT doc_id, {numbered(TITLES)} AS title, CASE WHEN doc_id % 5 = 0 THEN {numbered(LINES)} ELSE {text} || ' ' || {numbered(LINES)} END AS body, {numbered(PLACES, 3)} AS location, 'https://seoul.example/jobs' AS url, {numbered(FAMILIES, 1)} AS family, doc_id % 11 <> 0 AS aims FROM documents),
t AS (SELECT *, lower(title) AS lt, lower(coalesce(body, '')) AS lb FROM o)"""


OPENINGS = openings_sql("substring(text, 1, 2000)")


def tech(text: str) -> str:
    return f"({has(text, roles.TECHNICAL)} AND NOT {has(text, roles.BLOCKED)})"


DETAIL = f"({tech('lt')} OR (NOT {has('lt', roles.BLOCKED)} AND len(list_filter({listed(roles.IN_DETAIL)}, lambda x: contains(lb, x))) >= 2))"
HOME = "({0} AND (" + has("{1}", roles.DOMESTIC) + " OR starts_with(trim(lt), '[kr]') OR starts_with(trim(lt), '(kr)') OR starts_with(trim(lt), 'kr ')))"


@query(f"WITH {OPENINGS} SELECT doc_id, {tech('lt')} AS by_title, {DETAIL} AS in_detail, {HOME.format(tech('lt'), 'lower(location)')} AS at_home FROM t")
def technical_roles(spark, sf_dir):
    title, text = F.col("title"), F.col("description_text")
    return openings(spark, sf_dir).select("doc_id", roles.technical(title).alias("by_title"), roles.technical_in_detail(title, text, signals=roles.IN_DETAIL).alias("in_detail"), roles.technical_at_home(title, F.col("location")).alias("at_home"))


def rule_sql(rule: opening_filters.Rule) -> str:
    every = {"title": tech("lt"), "texts": tech("(lt || CASE WHEN lb = '' THEN '' ELSE ' ' || lb END)"), "detail": DETAIL, "home": HOME.format(tech("lt"), "lower(location)"), "home_or_url": HOME.format(tech("lt"), "lower(location || ' ' || url)"), "any": "TRUE"}
    parts = [every[rule.role]]
    if rule.begins:
        parts.append(f"starts_with(ltrim(lt), {quoted(rule.begins)})")
    if rule.ends:
        parts.append("(" + " OR ".join(f"ends_with(lb, {quoted(e)})" for e in rule.ends) + ")")
    if rule.lacks:
        parts.append(f"NOT contains(title, {quoted(rule.lacks)})")
    if rule.department:
        parts.append(f"list_contains({listed(rule.department)}, trim(lb))")
    if rule.labelled:
        parts.append(f"regexp_extract(lb, '^[\\s\\p{{Z}}]*([^\\s\\p{{Z}}]+)', 1) = {quoted(rule.labelled)}")
    if rule.pool:
        parts.append("NOT (contains(replace(lt, ' ', ''), '인재pool') OR contains(replace(lt, ' ', ''), 'talentpool'))")
    if rule.sites:
        parts.append(f"NOT ({has('(lt || chr(32) || lb)', opening_filters.SITES)} AND NOT {has('(lt || chr(32) || lb)', opening_filters.SOFTWARE)})")
    return " AND ".join(parts)


FILTER_SQL = "CASE WHEN NOT aims THEN TRUE " + " ".join(f"WHEN family = {quoted(f)} THEN {rule_sql(r)}" for f, r in opening_filters.RULES.items()) + f" ELSE {rule_sql(opening_filters.Rule())} END"


@query(f"WITH {OPENINGS} SELECT doc_id, family, title FROM t WHERE {FILTER_SQL}")
def source_opening_filters(spark, sf_dir):
    return opening_filters.kept(openings(spark, sf_dir)).select("doc_id", "family", "title")


DOMAIN_ROWS = "(VALUES " + ", ".join(f"({quoted(d.id)}, {quoted(d.label)}, {listed(d.title_terms)}, {listed(d.responsibility_terms)}, {listed(d.strong_skills)}, {listed(d.supporting_skills)}, {listed(d.work_types)})" for d in DOMAINS) + ") f(id, label, tt, rt, ss, us, wt)"
KNOWN = ("Spring", "Kafka", "Python", "React", "TypeScript", "PyTorch", "Docker", "Kubernetes", "C++", "Linux", "SQL", "Airflow", "Unity", "Figma")


def skills_of(number, count: int):
    """A run of ``count`` skills by number, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(F.array(*map(F.lit, KNOWN)), (F.pmod(number + i * 3, F.lit(len(KNOWN))) + 1).cast("int")))


def skills_sql(number: str, count: int) -> str:
    return "[" + ", ".join(f"{listed(KNOWN)}[({number} + {i * 3}) % {len(KNOWN)} + 1]" for i in range(count)) + "]"


@query(
    f"""WITH {openings_sql("text")}, s AS (SELECT *, list_transform({skills_sql('doc_id', 3)}, lambda x: lower(x)) AS sk FROM t),
c AS (SELECT doc_id, id, label, len(list_filter(tt, lambda x: contains(lt, x))) AS a, len(list_filter(rt, lambda x: contains(lb, x))) AS b, len(list_intersect(list_distinct(sk), ss)) AS c, len(list_intersect(list_distinct(sk), us)) AS d FROM s CROSS JOIN {DOMAIN_ROWS}),
k AS (SELECT *, CASE WHEN a > 0 THEN 1 WHEN (b > 0 AND (c + d > 0 OR b >= 2)) OR c >= 2 OR (c > 0 AND d > 0) THEN 2 ELSE 0 END AS tier FROM c),
m AS (SELECT *, min(CASE WHEN tier > 0 THEN tier END) OVER (PARTITION BY doc_id) AS best FROM k)
SELECT doc_id, id AS domain, tier = 1 AS explicit, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a DESC, b DESC, c DESC, d DESC, label) AS INT) AS place FROM m WHERE tier > 0 AND tier = best"""
)
def document_domains(spark, sf_dir):
    o = openings(spark, sf_dir, whole=True).withColumn("skills", skills_of(F.col("doc_id"), 3)).withColumnRenamed("description_text", "body")
    found = career.classify(o).select("doc_id", F.posexplode("found").alias("at", "d"))
    return found.select("doc_id", "d.domain", (F.col("d.tier") == 1).alias("explicit"), (F.col("at") + 1).cast("int").alias("place"))


ROLES = ("Backend engineer", "", "플랫폼 엔지니어", "Designer", "데이터 분석")
DUTIES = ("api 개발과 분산 시스템", "보안 정책", "", "테스트 자동화, 회귀 테스트", "로드맵")
SHOWN = ("배포 자동화", "", "게임 서버", "모델 서빙")
USES = ("current", "within_1y", "older")


def customers(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda values, shift=0: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k + shift, F.lit(len(values))) + 1).cast("int"))
    ids = [d.id for d in DOMAINS]
    shown = F.array(F.struct(F.lit("a project").alias("title"), pick(SHOWN).alias("responsibilities"), F.lit(None).cast("string").alias("outcome"), F.when(k % 4 == 0, pick(ids, 5)).alias("domain"), F.array(pick(KNOWN, 7)).alias("skills")))
    own = skills_of(k, 4)
    usage = F.map_from_entries(F.array(F.struct(F.lower(own[0]).alias("key"), pick(USES).alias("value"))))
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"), pick(ROLES).alias("current_role"), F.when(k % 3 == 0, pick(ids)).alias("current_domain"), F.when(k % 6 == 1, F.array(pick(TITLES, 2))).alias("past_roles"), pick(DUTIES).alias("responsibilities"), F.lit(None).cast("string").alias("keep_experience"),
        F.when(k % 5 != 0, shown).alias("highlights"), F.when(k % 7 != 0, own).alias("skills"), F.when(k % 2 == 0, usage).alias("usage"), F.array(pick(tuple(WORK_TYPES))).alias("work_types"), F.array(pick(ids, 2), pick(ids, 9)).alias("interest_domains"),
    )


def custom(values, shift: int = 0) -> str:
    return f"{listed(values)}[(c_custkey + {shift}) % {len(values)} + 1]"


IDS = [d.id for d in DOMAINS]
NAMES_SQL = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in WORK_TYPES.items()) + "}"
PROFILES = f"""p AS (SELECT c_custkey AS user_id, {custom(ROLES)} AS role, CASE WHEN c_custkey % 3 = 0 THEN {custom(IDS)} END AS field, CASE WHEN c_custkey % 6 = 1 THEN lower({custom(TITLES, 2)}) ELSE '' END AS past, lower({custom(DUTIES)}) AS duties,
  CASE WHEN c_custkey % 5 <> 0 THEN lower('a project ' || {custom(SHOWN)}) ELSE '' END AS shown, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 = 0 THEN {custom(IDS, 5)} END AS sf,
  list_concat(CASE WHEN c_custkey % 7 <> 0 THEN {skills_sql('c_custkey', 4)} ELSE [] END, CASE WHEN c_custkey % 5 <> 0 THEN [{custom(KNOWN, 7)}] ELSE [] END) AS sk, CASE WHEN c_custkey % 2 = 0 AND {custom(USES)} IN ('current', 'within_1y') THEN lower({custom(KNOWN)}) END AS recent,
  {custom(tuple(WORK_TYPES))} AS work, [{custom(IDS, 2)}, {custom(IDS, 9)}] AS wishes FROM customer),
e AS (SELECT *, len(list_filter(tt, lambda x: contains(lower(role), x))) > 0 OR coalesce(field = id, FALSE) AS isrole, len(list_filter(tt, lambda x: contains(past, x))) > 0 AS ispast, list_filter(rt, lambda x: contains(duties, x)) AS du,
  len(list_filter(rt, lambda x: contains(shown, x))) > 0 OR coalesce(sf = id, FALSE) AS ach, list_filter(sk, lambda x: list_contains(ss, lower(x))) AS st, list_filter(sk, lambda x: list_contains(us, lower(x))) AS su, list_contains(wt, work) AS wk, list_contains(wishes, id) AS wished FROM p CROSS JOIN {DOMAIN_ROWS}),
q AS (SELECT *, list_filter(list_concat(st, su), lambda x, i: list_position(list_concat(st, su), x) = i) AS matched FROM e),
r AS (SELECT *, list_filter(matched, lambda x: coalesce(lower(x) = recent, FALSE)) AS rec, CASE WHEN isrole THEN 'direct' WHEN ispast OR ach OR len(du) >= 2 OR len(list_distinct(st)) >= 2 OR (len(st) > 0 AND len(su) > 0) THEN 'adjacent' WHEN wished THEN 'interest' ELSE 'transition' END AS kind FROM q),
x AS (SELECT *, isrole OR ispast OR len(du) > 0 OR ach OR len(matched) > 0 AS any_said FROM r)"""
TYPES = """list_filter([CASE WHEN isrole OR ispast THEN 'role' END, CASE WHEN len(du) > 0 THEN 'responsibility' END, CASE WHEN ach THEN 'achievement' END, CASE WHEN len(matched) > 0 THEN 'skill' END, CASE WHEN len(rec) > 0 THEN 'recent_skill' END,
  CASE WHEN wk AND any_said THEN 'work_type' END, CASE WHEN wished AND kind = 'interest' THEN 'interest' END], lambda x: x IS NOT NULL)"""
SAID = f"""list_filter([CASE WHEN isrole AND role <> '' THEN printf('{career.SAYS_ROLE}', role, label) WHEN isrole THEN printf('{career.SAYS_FIELD}', label) END, CASE WHEN ispast THEN printf('{career.SAYS_PAST}', label) END, CASE WHEN len(du) > 0 THEN printf('{career.SAYS_DUTIES}', array_to_string(du[1:2], ', ')) END,
  CASE WHEN ach THEN printf('{career.SAYS_SHOWN}', label) END, CASE WHEN len(rec) > 0 THEN printf('{career.SAYS_RECENT}', array_to_string(rec[1:3], ', ')) WHEN len(matched) > 0 THEN printf('{career.SAYS_SKILLS}', array_to_string(matched[1:3], ', ')) END,
  CASE WHEN wk AND any_said THEN printf('{career.SAYS_WORK}', {NAMES_SQL}[work]) END, CASE WHEN wished AND kind = 'interest' THEN printf('{career.SAYS_WISH}', label) END], lambda x: x IS NOT NULL)"""


@query(f"WITH {PROFILES} SELECT user_id, id AS domain, kind, array_to_string({TYPES}, ',') AS evidence_types, array_to_string({SAID}, '|') AS reasons, array_to_string(matched, ',') AS matched_skills FROM x")
def profile_evidence(spark, sf_dir):
    e = career.profile_evidence(customers(spark, sf_dir))
    return e.select("user_id", "domain", "kind", F.array_join("evidence_types", ",").alias("evidence_types"), F.array_join("reasons", "|").alias("reasons"), F.array_join("matched_skills", ",").alias("matched_skills"))


CODES = ("new_comer", "experienced", "", "odd_code", "mixed", "not_matter")
WORK = ("FULL_TIME, CONTRACT", "정규|인턴", "", "UNKNOWN", "intern; intern", "regular/nobody")
SPOTS = ("SEOUL", " REMOTE ", "", "UNKNOWN_CITY", "서울 강남구", "B2")
NAMED = (
    ("신입", "경력", "경력 미기재", "경력 조건 확인 필요", "신입·경력", "경력 무관"), ("정규직 · 계약직", "정규직 · 인턴", "고용 형태 미기재", "고용 형태 확인 필요", "인턴", "정규직"), ("서울", "원격", "근무지 미기재", "근무지 확인 필요", "서울 강남구", "근무지 확인 필요"),
)


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN '경력 미기재' ELSE {list(NAMED[0])}[o_orderkey % 6 + 1] END AS career, {list(NAMED[1])}[o_orderkey % 6 + 1] AS employment, CASE WHEN o_orderkey % 9 = 8 THEN o_orderpriority ELSE {list(NAMED[2])}[o_orderkey % 6 + 1] END AS location FROM orders")
def posting_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 6 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 10 != 9, pick(CODES)).alias("c"), pick(WORK).alias("w"), F.when(k % 9 == 8, F.col("o_orderpriority")).otherwise(pick(SPOTS)).alias("p"))
    return o.select("o_orderkey", labels.career(F.col("c")).alias("career"), labels.employment(F.col("w")).alias("employment"), labels.location(F.col("p")).alias("location"))


@query(
    """SELECT page_id, CAST(unnest(range(1, 9)) AS INT) AS at, unnest(['heading', 'paragraph', 'list', 'paragraph', 'heading', 'list', 'paragraph', 'paragraph']) AS kind, unnest([2, NULL, NULL, NULL, 3, NULL, NULL, NULL]) AS level,
unnest(['Part ' || page_id, 'first line', NULL, '#no head ' || page_id, 'Deep ' || page_id, NULL, 'end-of-text', '-']) AS text, unnest(['', '', 'one ' || page_id || '|two|three', '', '', 'x', '', '']) AS items FROM pages"""
)
def description_blocks(spark, sf_dir):
    """A description for each page: headings, bullets within a line and on lines, white space at the ends."""
    text = F.format_string("## Part %1$d\r\n  first line  * one %1$d\n\n- two\n•  three \n#no head %1$d #### Deep %1$d\n◦ x\n end-of-text - ", "page_id")
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(labels.description_blocks(text)).alias("at", "b"))
    return found.select("page_id", (F.col("at") + 1).cast("int").alias("at"), "b.kind", "b.level", "b.text", F.array_join("b.items", "|").alias("items"))
