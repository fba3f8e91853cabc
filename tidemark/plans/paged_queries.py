"""Paged listings made from orders: a customer is a source, its orders are the items, four to a page, and every seventh source has a fault."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.analog import table
from tidemark.sources import details, enterprise, paged
from tidemark.sources.store import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FAMILIES = ("apple", "pcsx", "workday", "lge", "nexon")
SIZE = 4


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def payloads(spark, sf_dir):
    """Faults by source modulo 7: 1 the last page states one more, 2 its last id is the first one's, 3 it is missing, 4 its last id is null, 5 it breaks off, 6 its last affiliate is unknown (nexon)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("k"), "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    w = Window.partitionBy("source_id")
    o = o.withColumn("i", F.row_number().over(w.orderBy("k")) - 1).withColumn("n", F.count("*").over(w)).withColumn("first", F.min("k").over(w)).withColumn("page", F.floor(F.col("i") / SIZE).cast("int") + 1)
    fault, last = F.col("source_id") % 7, F.col("i") == F.col("n") - 1
    o = o.withColumn("id", F.when(last & (fault == 2), F.col("first")).when(last & (fault == 4), F.lit(None)).otherwise(F.col("k")).cast("string"))
    corp = F.when(last & (fault == 6), "Nobody").otherwise(F.concat(F.lit("Corp "), "o_orderstatus"))
    kind = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("source_id") % 5 + 1).cast("int"))
    title = F.concat(F.lit("Order "), F.substring("o_orderpriority", 3, 20))
    item = {
        "apple": F.struct(F.col("id").alias("positionId"), title.alias("postingTitle"), F.array(F.struct(F.lit("Seoul").alias("name"))).alias("locations"), F.col("day").alias("postDateInGMT")),
        "pcsx": F.struct(F.col("id"), title.alias("name"), F.array(F.lit("Seoul")).alias("locations"), F.concat(F.lit("/job/"), "k").alias("positionUrl")),
        "workday": F.struct(F.col("id").alias("externalPath"), title.alias("title"), F.lit("Seoul").alias("locationsText")),
        "lge": F.struct(F.col("id").alias("jobNoticeId"), title.alias("jobNoticeName"), F.col("day").alias("endDate")),
        "nexon": F.struct(F.col("id"), title.alias("title"), corp.alias("corpName"), F.lit("Pangyo").alias("workingArea"), F.lit("<p>text</p>").alias("contents"), F.col("day").alias("endDate")),
    }
    text = lambda c: F.to_json(c)
    one = F.lit(None).cast("string")
    for name, c in item.items():
        one = F.when(F.col("family") == name, text(c)).otherwise(one)
    o = o.withColumn("family", kind).withColumn("item", one)
    pages = o.groupBy("source_id", "family", "page").agg(F.first("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda x: x["item"]), ",").alias("items"))
    tail = F.col("page") == F.ceil(F.col("n") / SIZE)
    f = F.col("source_id") % 7
    total = F.when(tail & (f == 1), F.col("n") + 1).when((F.col("page") > 1) & (F.col("family") == "workday"), 0).otherwise(F.col("n")).cast("string")
    around = {
        "apple": F.concat(F.lit('{"searchResults":['), "items", F.lit('],"totalRecords":'), total, F.lit("}")),
        "pcsx": F.concat(F.lit('{"status":200,"data":{"positions":['), "items", F.lit('],"count":'), total, F.lit("}}")),
        "workday": F.concat(F.lit('{"total":'), total, F.lit(',"jobPostings":['), "items", F.lit("]}")),
        "lge": F.concat(F.lit('{"data":{"list":['), "items", F.lit(f'],"size":{SIZE},"total":'), total, F.lit("}}")),
        "nexon": F.concat(F.lit('{"list":['), "items", F.lit('],"pagination":{"page":'), F.col("page").cast("string"), F.lit(f',"size":{SIZE},"total":'), total, F.lit("}}")),
    }
    body = F.lit(None).cast("string")
    for name, c in around.items():
        body = F.when(F.col("family") == name, c).otherwise(body)
    body = F.when(tail & (f == 5), F.concat(F.substring(body, 1, 20), F.lit("..."))).otherwise(body)
    corps = F.array(F.lit("Corp O"), F.lit("Corp F"), F.lit("Corp P"))
    mine = F.when((F.col("family") == "nexon") & (F.col("source_id") % 2 == 0), F.lit("Corp O"))
    landed = pages.filter(~(tail & (f == 3))).select("source_id", "family", "page", body.alias("payload"), mine.alias("affiliate"), corps.alias("affiliates"))
    return cut(landed)  # as payloads are: written once, read by several jobs


STATES = f"""
WITH r AS (SELECT o_custkey AS source_id, o_orderkey AS k, o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders),
g AS (SELECT *, {list(FAMILIES)}[source_id % 5 + 1] AS family, source_id % 7 AS fault, i // {SIZE} + 1 AS page, ceil(n / {SIZE}.0)::BIGINT AS last FROM r),
h AS (SELECT *, CASE WHEN i = n - 1 AND fault = 2 THEN first WHEN i = n - 1 AND fault = 4 THEN NULL ELSE k END AS id FROM g WHERE NOT (fault = 3 AND page = last)),
s AS (SELECT source_id, any_value(family) AS family, any_value(fault) AS fault, any_value(last) AS last, any_value(n) AS n, count(DISTINCT page) AS pages, count(*) FILTER (NOT (fault = 5 AND page = last)) AS items FROM h GROUP BY 1),
v AS (SELECT source_id, family, pages, items, CASE WHEN fault = 5 AND last = 1 THEN NULL WHEN fault = 1 AND last = 1 THEN n + 1 ELSE n END AS stated, CASE
  WHEN fault = 5 THEN 'invalid_payload' WHEN pages > 50 THEN 'too_many_pages'
  WHEN family = 'lge' THEN 'complete'
  WHEN fault = 1 AND last > 1 THEN 'moved_total' WHEN fault = 1 THEN 'incomplete'
  WHEN fault = 2 AND n > 1 AND family <> 'pcsx' THEN 'repeated_id'
  WHEN fault = 4 THEN 'missing_id' WHEN fault = 6 AND family = 'nexon' THEN 'unknown_affiliate' WHEN fault = 3 THEN 'incomplete' ELSE 'complete' END AS state FROM s)"""


@query(f"{STATES} SELECT source_id, family, state, pages, items, stated FROM v")
def paged_listing_states(spark, sf_dir):
    return paged.verdicts(payloads(spark, sf_dir))


@query(
    f"""{STATES}, c AS (SELECT h.* FROM h JOIN v USING (source_id) WHERE state = 'complete' AND NOT (v.family = 'nexon' AND source_id % 2 = 0 AND o_orderstatus <> 'O'))
SELECT source_id, family, id::VARCHAR AS external_id, 'Order ' || substr(o_orderpriority, 3, 20) AS title, CASE family WHEN 'pcsx' THEN '/job/' || k WHEN 'workday' THEN id::VARCHAR END AS url, CASE family WHEN 'nexon' THEN 'Pangyo' WHEN 'lge' THEN NULL ELSE 'Seoul' END AS location,
  CASE family WHEN 'nexon' THEN '<p>text</p>' END AS description_html, CASE family WHEN 'apple' THEN day END AS opens_at, CASE WHEN family IN ('lge', 'nexon') THEN day END AS closes_at
FROM c QUALIFY family = 'lge' OR row_number() OVER (PARTITION BY source_id, id ORDER BY i) = 1"""
)
def paged_listing_openings(spark, sf_dir):
    return paged.openings(payloads(spark, sf_dir)).drop("employment_type")


# Details: an order is a reference, its family by number; every eleventh has a fault.
LONG = "<p>Work on orders of many kinds, from the first request to the last delivery, with people who care for what they ship every single day.</p>"
KINDS = ("hyundai", "kia", "lg", "hanwha", "smilegate", "woowahan", "kakaobank", "workable")
#: Payloads by family: %1$s the id, %2$s the title, %3$s the text.
BODIES = (
    '{"data":{"applyInfo":{"recuYy":"%1$s","recuType":"N","recuCls":"1","recuNoticeNm":"%2$s","privJdDtl":"%3$s","privMustReq":"&lt;p&gt;SQL&lt;/p&gt;","aboutTeamNtc":"<style>p{}</style> ","etc":"<p>etc</p>"}}}',
    '{"data":{"applyInfo":{"recuYy":"%1$s","recuType":"N","recuCls":"1","recuNoticeNm":"%2$s","prefReq":"%3$s"}}}',
    '{"data":{"jobNoticesDetail":{"jobNoticesDetail":{"jobNoticeId":"%1$s","jobNoticeName":"%2$s","recProcessInfo":"<p>steps</p>"},"recList":[{"jobNoticeId":"%1$s","orgName":"R & D","jobGroupName":"R & D","detailContext":"%3$s"},{"requiredItem":""}]}}}',
    '{"data":{"item":{"rtSeq":"%1$s","rtNm":"%2$s","unitDt":[{"rtSeq":"%1$s","ruDtlJob":"%3$s","ruWorkpl":"Seoul"}],"rtEct":"<p>more</p>"}}}',
    '{"announceSeq":"%1$s","title":"%2$s","workInfo":"%3$s","specialDesc":"<script>x</script><p>bonus</p>"}',
    '{"code":"2000","data":{"recruitNumber":"%1$s","recruitName":"%2$s","recruitContents":"%3$s","careerType":{"recruitItemCode":"BA003002"},"employmentType":{"recruitItemCode":"BA002001"},"careerRestrictionMinYears":3,"isHidden":true,"recruitOpenDate":"2026-07-01"}}',
    '{"recruitNoticeSn":"%1$s","recruitNoticeName":"  %2$s ","contents":"%3$s","receiveEndDatetime":"2026-08-01"}',
    '{"id":"%1$s","title":"%2$s","description":"%3$s","requirements":"<p>SQL</p>","type":"full","published":"2026-07-02"}',
)
#: What comes of them: the description around the text, status, career, employment, least years, opens, closes.
MADE = (
    ("<section><h2>직무 상세</h2>{0}</section><section><h2>필수 요건</h2><p>SQL</p></section><section><h2>기타</h2><p>etc</p></section>", "open", None, None, None, None, None), ("<section><h2>우대 요건</h2>{0}</section>", "open", None, None, None, None, None),
    ("<section><h2>R &amp; D</h2><section><h3>직무 내용</h3>{0}</section></section><section><h2>전형 절차</h2><p>steps</p></section>", "open", None, None, None, None, None),
    ("<section><h2>모집 직무</h2>{0}<p>근무지: Seoul</p></section><section><h2>기타 안내</h2><p>more</p></section>", "open", None, None, None, None, None), ("<section><h2>담당 업무</h2>{0}</section><section><h2>우대 사항</h2><p>bonus</p></section>", "open", None, None, None, None, None),
    ("{0}", "closed", "experienced", "regular", 3, "2026-07-01", None), ("{0}", "open", None, None, None, None, "2026-08-01"), ("{0}<section><h2>자격 요건</h2><p>SQL</p></section>", "open", None, "regular", None, "2026-07-02", None),
)
FAULTS = ("hydrated", "missing", "invalid_payload", "identity_mismatch", "title_mismatch", "not_substantive", "hydrated", "missing_content", "hydrated", "hydrated", "hydrated")


def literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"


@query(
    "SELECT k AS source_id, kind AS family, external_id, state, CASE WHEN state = 'hydrated' THEN status END AS status, CASE WHEN state = 'hydrated' THEN sha256(replace(made, '{0}', '" + LONG + "' || '<p>' || o_orderpriority || '</p>')) END AS description_sha256, "
    + ", ".join(f"CASE WHEN state = 'hydrated' THEN {c} END AS {c}" for c in ("career_type", "employment_type", "career_min", "opens_at", "closes_at"))
    + f" FROM (SELECT *, o_orderkey AS k, o_orderkey::VARCHAR || CASE WHEN o_orderkey % 8 < 2 THEN '-N-1' ELSE '' END AS external_id, CASE WHEN {list(FAULTS)}[o_orderkey % 11 + 1] = 'missing_content' AND o_orderkey % 8 > 3 THEN CASE WHEN o_orderkey % 8 = 5 THEN 'failed' ELSE 'identity_mismatch' END ELSE {list(FAULTS)}[o_orderkey % 11 + 1] END AS state FROM orders) JOIN (VALUES "
    + ", ".join(f"({i}, '{KINDS[i]}', " + ", ".join(map(literal, row)) + ")" for i, row in enumerate(MADE)) + ") t(i, kind, made, status, career_type, employment_type, career_min, opens_at, closes_at) ON i = k % 8"
)
def detail_hydration(spark, sf_dir):
    k = F.col("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    family = F.element_at(F.array(*map(F.lit, KINDS)), (k % 8 + 1).cast("int"))
    title = F.concat(F.lit("Order "), k.cast("string"))
    references = o.select(k.alias("source_id"), family.alias("family"), F.concat(k.cast("string"), F.when(k % 8 < 2, "-N-1").otherwise("")).alias("external_id"), F.lit("https://x.example").alias("url"), title.alias("title"))
    fault = k % 11
    said_id = F.when(fault == 3, k + 1).otherwise(k).cast("string")
    said_title = F.when(fault == 4, "Another").otherwise(title)
    text = F.when(fault == 5, "<p>short</p>").otherwise(F.concat(F.lit(LONG + "<p>"), "o_orderpriority", F.lit("</p>")))
    body = F.format_string(BODIES[-1], said_id, said_title, text)
    for i, b in enumerate(BODIES[:-1]):
        body = F.when(k % 8 == i, F.format_string(b, said_id, said_title, text)).otherwise(body)
    body = F.when(fault == 2, "{").when(fault == 7, "{}").otherwise(body)
    landed = o.filter(fault != 1).select(k.alias("source_id"), family.alias("family"), F.concat(k.cast("string"), F.when(k % 8 < 2, "-N-1").otherwise("")).alias("external_id"), body.alias("payload"), F.lit(1).alias("fetched_at"))
    older = landed.filter("source_id % 3 = 0").withColumn("payload", F.lit("{")).withColumn("fetched_at", F.lit(0))
    found = details.hydrated(references, cut(landed.unionByName(older)))
    return found.select("source_id", "family", "external_id", "state", "status", F.sha2("description_html", 256).alias("description_sha256"), "career_type", "employment_type", "career_min", "opens_at", "closes_at")


# Enterprise boards: a customer's orders as the list of its board.
BOARDS = (
    ("posco", '{"recuList":[%s]}'), ("sk", '{"list":[%s]}'), ("lg_ai", '{"data":{"list":[%s]}}'), ("smilegate", '{"announce":[%s]}'), ("kt", 'cb({"data":[%s]});'), ("cj", "[%s]"), ("atlassian", "[%s]"), ("jibe", '{"jobs":[%s]}'), ("posco", "{[%s"),
)
#: An item of each: %1$d the order's number, %2$s its priority, %3$s its day in digits, %4$s its status, %5$s true for some.
ITEMS = (
    '{"HR_AFTC_MRG_ADOP_NTIC_ID":%1$d,"HR_AFTC_MRG_ADOP_NTIC_SUJX":"R &amp; D %2$s","HR_AFTC_MRG_ADOP_CLTA_TP_TP_NM":"정규","END_ACTIVE_DATE":"%3$s","COMPANY_NAME":"POSCO"}',
    '{"jobNoticeNo":"%1$d","title":"T %2$s","recruitType":"New","workingArea":"Seoul","start":"July 1, 2026(Wed)","end":"soon"}',
    '{"seq":%1$d,"jbrl":"T %2$s","groupCd":"JX,JCAAAC","officeCd":"JDAAAA","expsYn":"%4$s","jobtypeCd":"JBCCCC","prdStrtYmd":"%3$s","rlmCd":"JAAADD"}', '{"announceSeq":%1$d,"title":"T %2$s","endDate":"%3$s","careerTypeNm":"경력"}',
    '{"recruitNoticeSn":%1$d,"title":"T %2$s","recruitNoticeUrl":"/n/%1$d","isPost":%5$s,"isInProgress":true}', '{"ZZ_JO_NUM":%1$d,"ZZ_TITLE":"T %2$s","ZZ_TARGET_1":"B","RNUM":2,"ACTIVE_CNT":"3"}',
    '{"id":%1$d,"title":"T %2$s","portalJobPost":{"portalUrl":"https://p/%1$d"},"locations":["Seoul"]}', '{"data":{"req_id":"%1$d","title":"T %2$s","country_code":"KR","searchable":%5$s,"full_location":" ","short_location":"Seoul"}}', "%1$d%2$s%3$s%4$s%5$s",
)
#: What comes of an item: title before the priority, status, url, location, employment, career, opens, closes, department, and which orders stay.
CAME = (
    ("R & D ", "open", "/h22a01-front/H22A1001.html?id=#", None, "정규", "정규", None, "@", "POSCO", "TRUE"), ("T ", "open", "/Recruit/Detail/#", "Seoul", None, "신입", "2026-07-01", None, None, "TRUE"),
    ("T ", "open", "https://www.lgresearch.ai/careers/view?seq=#", "Magok, Seoul", "Internship", None, "=", None, "Language", "o_orderstatus = 'Y'"), ("T ", "open", "https://careers.smilegate.com/apply/announce/view?seq=#", None, None, "경력", None, "=", None, "TRUE"),
    ("T ", "?", "/n/#", None, None, None, None, None, None, "TRUE"), ("T ", "open", "https://recruit.cj.net/recruit/ko/recruit/recruit/detail.fo?zz_jo_num=#", None, "경력", "경력", None, None, "CJ OliveNetworks", "TRUE"),
    ("T ", "open", "https://p/#", "Seoul", None, None, None, None, None, "TRUE"), ("T ", "open", None, "Seoul", None, None, None, None, None, "o_orderkey % 3 <> 0"),
)


def day(v) -> str:
    return "strftime(o_orderdate, '%Y%m%d')" if v == "@" else "strftime(o_orderdate, '%Y-%m-%d')" if v == "=" else literal(v)


@query(
    " UNION ALL ".join(
        f"SELECT o_custkey AS source_id, '{BOARDS[i][0]}' AS family, o_orderkey::VARCHAR AS external_id, '{t}' || o_orderpriority AS title, {literal(st) if st != '?' else chr(67) + 'ASE WHEN o_orderkey % 3 <> 0 THEN ' + literal('open') + ' ELSE ' + literal('closed') + ' END'} AS status, replace({literal(u)}, '#', o_orderkey::VARCHAR) AS url, "
        f"{literal(lo)} AS location, {literal(em)} AS employment_type, {literal(ca)} AS career, {day(op)} AS opens_at, {day(cl)} AS closes_at, {literal(de)} AS department FROM orders WHERE o_custkey % 9 = {i} AND {keep.replace(chr(39) + 'Y' + chr(39), chr(39) + 'O' + chr(39))}"
        for i, (t, st, u, lo, em, ca, op, cl, de, keep) in enumerate(CAME)
    )
)
def enterprise_openings(spark, sf_dir):
    k = F.col("o_custkey")
    args = ("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderstatus") == "O", "Y").otherwise("N"), F.when(F.col("o_orderkey") % 3 != 0, "true").otherwise("false"))
    item = F.format_string(ITEMS[-1], *args)
    for i, x in enumerate(ITEMS[:-1]):
        item = F.when(k % 9 == i, F.format_string(x, *args)).otherwise(item)
    lists = table(spark, sf_dir, "orders").withColumn("item", item).groupBy("o_custkey").agg(F.array_join(F.collect_list("item"), ",").alias("items"))
    body, family = F.format_string(BOARDS[-1][1], "items"), F.lit(BOARDS[-1][0])
    for i, (name, around) in enumerate(BOARDS[:-1]):
        body, family = F.when(k % 9 == i, F.format_string(around, "items")).otherwise(body), F.when(k % 9 == i, name).otherwise(family)
    return enterprise.openings(cut(lists.select(k.alias("source_id"), family.alias("family"), body.alias("payload")))).drop("description_html")
