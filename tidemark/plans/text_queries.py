"""Text, markup and connectors: over documents and pages, and over literal payloads where those hold none."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import identity, roles
from tidemark.functions import text as tx
from tidemark.functions import time as tm
from tidemark.plans.analog import table
from tidemark.sources import listing_checks, markup, openings

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


MARKERS, STOP, HOME = ("the ", "tion", "ment", "ung"), ("idiot", "scum", "!!"), ("en", "de")


@query(
    """SELECT doc_id, tech, detail, home FROM (SELECT doc_id, (contains(t, 'the ') OR contains(t, 'tion') OR contains(t, 'ment') OR contains(t, 'ung')) AND NOT b AS tech,
  ((contains(t, 'the ') OR contains(t, 'tion') OR contains(t, 'ment') OR contains(t, 'ung')) AND NOT b) OR (NOT b AND (CASE WHEN contains(d, 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(d, 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(d, 'ment') THEN 1 ELSE 0 END + CASE WHEN contains(d, 'ung') THEN 1 ELSE 0 END) >= 2) AS detail,
  (contains(lang, 'en') OR contains(lang, 'de') OR starts_with(trim(t, ' '), 'the ')) AND (contains(t, 'the ') OR contains(t, 'tion') OR contains(t, 'ment') OR contains(t, 'ung')) AND NOT b AS home
FROM (SELECT *, contains(t, 'idiot') OR contains(t, 'scum') OR contains(t, '!!') AS b FROM (SELECT doc_id, lang, lower(substr(text, 1, 60)) AS t, lower(text) AS d FROM documents)))"""
)
def technical_role_filter(spark, sf_dir):
    title = F.substring("text", 1, 60)
    return table(spark, sf_dir, "documents").select(
        "doc_id", roles.technical(title, MARKERS, STOP).alias("tech"), roles.technical_in_detail(title, F.col("text"), MARKERS, STOP).alias("detail"), roles.technical_at_home(title, F.col("lang"), MARKERS, STOP, HOME, ("the ",)).alias("home")
    )


@query("SELECT lower(trim(o_orderpriority)) AS label, count(*) AS n FROM orders GROUP BY 1")
def folded_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(tx.folded(F.col("o_orderpriority")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_+#.]+'), lambda x: length(x) >= 2))) AS n_words FROM documents")
def distinct_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT status, attempt, CASE WHEN status = 429 THEN greatest(coalesce(greatest(0, least(retry_after, 60)), 0), least(attempt * 10, 60)) ELSE least(2.0 ^ (attempt - 1), 8) END::DOUBLE AS delay FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 429 ELSE 503 END AS status, event_id % 7 + 1 AS attempt, CASE WHEN event_id % 3 = 0 THEN value END AS retry_after FROM events)")
def retry_delays(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, 429).otherwise(503).alias("status"), (F.col("event_id") % 7 + 1).alias("attempt"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("retry_after"))
    return e.select("status", "attempt", identity.retry_delay(F.col("status"), F.col("attempt"), F.col("retry_after")).alias("delay"))


@query("SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n, count(DISTINCT substr(sha256(url), 1, 32)) AS ids FROM pages GROUP BY 1")
def page_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).agg(F.count("*").alias("n"), F.countDistinct(identity.url_id(F.col("url"))).alias("ids"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def event_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("int")).alias("k"), F.count("*").alias("n"))


PLACES = (("서울 강남구", "seoul"), ("Pangyo, Gyeonggi", "gyeonggi"), ("부산/대전", "busan,daejeon"), ("재택 근무", "remote"), (" Jeju  Island ", "jejuisland"), ("", ""), ("성남시 분당구", "gyeonggi"), ("SEOUL or 원격", "remote,seoul"))


def pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 9 = 8 THEN lower(replace(c_name, ' ', '')) ELSE {[want for _, want in PLACES]}[c_custkey % 8 + 1] END AS regions FROM customer")
def location_regions(spark, sf_dir):
    """Places by number, every ninth the customer's name."""
    k = F.col("c_custkey")
    place = F.when(k % 9 == 8, F.col("c_name")).otherwise(pick([p for p, _ in PLACES], k))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(tx.location_keys(place)), ",").alias("regions"))


@query(
    """SELECT o_orderkey, strftime(CASE o_orderkey % 10 WHEN 0 THEN d - INTERVAL 9 HOUR WHEN 1 THEN d - INTERVAL 9 HOUR WHEN 2 THEN d + INTERVAL 9 HOUR WHEN 3 THEN d + INTERVAL '9:30' HOUR TO MINUTE WHEN 4 THEN d - INTERVAL 9 HOUR WHEN 5 THEN d WHEN 6 THEN d WHEN 9 THEN d END, '%Y-%m-%d %H:%M:%S') AS stamp
FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP + INTERVAL 30 YEAR AS d FROM orders)""".replace("INTERVAL '9:30' HOUR TO MINUTE", "INTERVAL 570 MINUTE")
)
def lenient_dates(spark, sf_dir):
    """Order dates, thirty years on, as boards write them: dashes, dots without zeros, zoned, local time, compact, epoch, words, nothing, another zone."""
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 30 YEARS")
    as_ = lambda f: F.date_format(d, f)
    raw = (
        F.when(k % 10 == 0, as_("yyyy-MM-dd")).when(k % 10 == 1, as_("yyyy.M.d")).when(k % 10 == 2, F.concat(as_("yyyy-MM-dd"), F.lit("T09:00:00Z"))).when(k % 10 == 3, F.concat(as_("yyyy-MM-dd"), F.lit(" 18:30"))).when(k % 10 == 4, as_("yyyyMMdd"))
        .when(k % 10 == 5, (F.unix_timestamp(d.cast("timestamp")) * 1000).cast("string")).when(k % 10 == 6, F.unix_timestamp(d.cast("timestamp")).cast("string")).when(k % 10 == 7, F.lit("채용시까지")).when(k % 10 == 9, F.concat(as_("yyyy-MM-dd"), F.lit("T09:00:00+09:00")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(tm.lenient_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query()
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.html_text("html").alias("text"))


@query()
def html_listing_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(markup.html_links("html", "url")).alias("l")).select("page_id", "l.url", "l.text")


@query()
def page_images(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(markup.description_images("html", F.lit(""), "url")).alias("n_images"))


LD = '<html><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Backend Engineer","url":"/jobs/1","identifier":{"value":"A-%1$d"},"description":"<p>Python and Kafka</p>","employmentType":["FULL_TIME"],"datePosted":"2026-07-01","validThrough":"2026-08-01","jobLocation":{"address":{"addressLocality":"Seoul","addressCountry":"KR"}}}]}</script></html>'
NEXT = '<script id="__NEXT_DATA__" type="application/json">{"props":{"list":[{"id":7%1$d,"title":"신입 데이터 분석","description":"<p>SQL</p>","endDate":"2026-09-01"},{"id":8,"name":"menu"}]}}</script>'
LISTING = '<ul><li><a href="/jobs/view?id=11%1$d">플랫폼 개발자 2026.07.01 ~ 2026.07.31</a></li><li><a href="/about">About us</a></li><li><a href="https://other.example/jobs/9">Elsewhere engineer</a></li></ul>'
LEVER = '[{"id":"x%1$d","text":"Data Engineer","hostedUrl":"https://jobs.lever.co/x/x1","categories":{"location":"Seoul","commitment":"Full-time"},"descriptionPlain":"Spark and SQL"}]'
GREENHOUSE = '{"jobs":[{"id":5%1$d,"title":"경력 SRE","absolute_url":"https://boards.greenhouse.io/x/5","location":{"name":"Remote"},"content":"&lt;p&gt;Kubernetes&lt;/p&gt;"}]}'
ASHBY = '{"jobs":[{"id":"a%1$d","title":"ML Engineer","jobUrl":"https://jobs.ashbyhq.com/x/a","location":"Seoul"}]}'
#: Families and their payloads by page number, and what comes of each: external id's beginning, title, location, career type, error.
LANDED = (
    ("jsonld", LD, "A-", "Backend Engineer", "Seoul, KR", None, None), ("next_data", NEXT, "7", "신입 데이터 분석", None, "new_comer", None), ("html_listing", LISTING, "11", "플랫폼 개발자", None, None, None), ("lever", LEVER, "x", "Data Engineer", "Seoul", None, None),
    ("greenhouse", GREENHOUSE, "5", "경력 SRE", "Remote", "experienced", None), ("ashby", ASHBY, "a", "ML Engineer", "Seoul", None, None), ("lever", "<broken %1$d", None, None, None, None, "listing_parse_error: ValueError"), ("nobody", "{%1$d}", None, None, None, None, "unsupported_connector"),
    ("browser", LISTING, "11", "플랫폼 개발자", None, None, None),
)


def value(v) -> str:
    return "NULL::VARCHAR" if v is None else "'" + v + "'"


@query(f"SELECT page_id AS source_id, ident || page_id AS external_id, title, location, career_type, error FROM pages JOIN (VALUES {', '.join(f'({i}, ' + ', '.join(map(value, row[2:])) + ')' for i, row in enumerate(LANDED))}) t(i, ident, title, location, career_type, error) ON page_id % {len(LANDED)} = i")
def connector_openings(spark, sf_dir):
    k = F.col("page_id")
    payload = F.format_string(LANDED[-1][1], k)
    for i, row in enumerate(LANDED[:-1]):
        payload = F.when(k % len(LANDED) == i, F.format_string(row[1], k)).otherwise(payload)
    df = table(spark, sf_dir, "pages").select(k.alias("source_id"), pick([row[0] for row in LANDED], k).alias("family"), payload.alias("payload"), F.lit("https://jobs.example.org/").alias("base_url"))
    return openings.parse(df).select("source_id", "external_id", "title", "location", "career_type", "error")


@query(
    """SELECT page_id AS source_id, 'J' || page_id AS external_id, 'https://jobs.example.org/' || page_id AS url, 'Engineer ' || page_id AS title, NULL AS error FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, x || page_id, 'https://jobs.lever.co/x/' || x || page_id, 'Analyst ' || x, NULL FROM pages, (VALUES ('a'), ('b')) t(x) WHERE page_id % 3 = 1
UNION ALL SELECT page_id, NULL, NULL, NULL, 'unsupported_connector' FROM pages WHERE page_id % 12 = 2"""
)
def page_openings(spark, sf_dir):
    """Pages as they are give no opening; every third begins with a structured posting, every third is a board's list, and some are of no known family."""
    k = F.col("page_id")
    said = F.format_string('<script type="application/ld+json">{"@type":"JobPosting","title":"Engineer %1$d","url":"https://jobs.example.org/%1$d","identifier":"J%1$d"}</script>', k)
    one = lambda x: F.format_string(f'{{"id":"{x}%1$d","text":"Analyst {x}","hostedUrl":"https://jobs.lever.co/x/{x}%1$d"}}', k)
    payload = F.when(k % 3 == 0, F.concat(said, "html")).when(k % 3 == 1, F.concat(F.lit("["), one("a"), F.lit(","), one("b"), F.lit("]"))).otherwise(F.col("html"))
    family = F.when(k % 3 == 1, "lever").when(k % 12 == 2, "nobody").otherwise("browser")
    df = table(spark, sf_dir, "pages").select(k.alias("source_id"), family.alias("family"), payload.alias("payload"), F.col("url").alias("base_url"))
    return openings.parse(df).select("source_id", "external_id", "url", "title", "error")


#: A customer's orders as a listing, by number: what surrounds the list (%s the items, %d their number), its address, and the state that comes of it.
LISTINGS = (
    ('{"jobs":[%s],"total":%d}', "", "complete"), ('{"jobs":[%s],"total":1%d}', "", "incomplete"), ('{"data":{"list":[%s],"page":1,"totalPages":1},"n":%d}', "", "complete"), ('{"data":{"list":[%s],"page":1,"totalPages":3},"n":%d}', "", "incomplete"), ('{"items":[%s],"hasNext":true,"n":%d}', "", "incomplete"),
    ('{"items":[%s],"hasNext":false,"n":%d}', "?page=1", "complete"), ('{"items":[%s],"n":%d}', "?page=1", "incomplete"), ('{"items":[%s],"n":%d}', "?page=2&size=1000", "incomplete"), ('{"items":[%s],"n":%d}', "?page=1&size=1000", "complete"), ('{"items":[%s],"n":%d}', "?limit=1", "incomplete"),
    ('{"results":[%s],"meta":{"error":{"code":%d}}}', "", "error_envelope"), ('cb({"list":[%s],"n":%d});', "", "complete"), ('{"jobs":[],"was":[%s],"total":0,"n":%d}', "", "empty"), ('{"jobs":[],"was":[%s],"n":%d}', "", "unexplained_empty"), ('{"list":[%s],"filteredCount":%d,"total":99999}', "", "complete"),
    ('oops [%s] %d', "", "listing_parse_error"), ('{"was":[%s],"n":%d}', "", "missing_collection"), ("<p>No open positions</p><!--%s %d-->", "", "empty"), ('<a class="next" href="/p">more</a><!--%s %d-->', "", "incomplete"),
)


@query(
    f"""SELECT source_id, state, CASE WHEN state IN ('complete', 'incomplete') AND source_id % {len(LISTINGS)} < 17 THEN n ELSE 0 END::INTEGER AS listed, CASE WHEN state IN ('complete', 'incomplete') AND source_id % {len(LISTINGS)} < 17 THEN active ELSE 0 END::INTEGER AS active
FROM (SELECT o_custkey AS source_id, {[row[2] for row in LISTINGS]}[o_custkey % {len(LISTINGS)} + 1] AS state, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 7 <> 0) AS active FROM orders GROUP BY 1)"""
)
def listing_completeness(spark, sf_dir):
    k = F.col("source_id")
    item = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "closed").alias("status"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(True)).alias("isHidden")))
    some = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.array_join(F.collect_list(item), ",").alias("items"), F.count("*").alias("n"))
    payload = F.format_string(LISTINGS[-1][0], "items", "n")
    for i, row in enumerate(LISTINGS[:-1]):
        payload = F.when(k % len(LISTINGS) == i, F.format_string(row[0], "items", "n")).otherwise(payload)
    df = some.select("source_id", listing_checks.listing_verdict(payload, F.concat(F.lit("https://jobs.example.org/list"), pick([row[1] for row in LISTINGS], k))).alias("v"))
    return df.select("source_id", "v.state", F.col("v.rows").alias("listed"), "v.active")


@query("SELECT o_orderpriority AS listing, items, distinct_items, items = distinct_items AND items = stated AS complete FROM (SELECT o_orderpriority, count(o_orderkey) AS items, count(DISTINCT o_orderkey) AS distinct_items, count(*) + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS stated FROM orders GROUP BY 1)")
def paged_listing_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    totals = orders.groupBy("o_orderpriority").agg((F.count("*") + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)).alias("total"))
    return openings.combined_pages(orders.join(totals, "o_orderpriority"), "o_orderpriority", "total", "o_orderkey").select(F.col("o_orderpriority").alias("listing"), "items", "distinct_items", "complete")


@query(
    """SELECT page_id, u AS url FROM (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages) CROSS JOIN LATERAL (SELECT unnest(CASE WHEN page_id % 4 = 3 THEN ['https://' || host || '/sitemap-' || page_id || '.xml'] ELSE ['https://' || host || '/jobs/' || page_id, 'https://' || host || '/careers/' || page_id || '?id=1'] END) AS u)"""
)
def sitemap_discovery(spark, sf_dir):
    """A sitemap for each page's host, every fourth a robots file: postings (one twice), another page, another host."""
    k, host = F.col("page_id"), F.lower(F.try_parse_url("url", F.lit("HOST")))
    locs = "<urlset><url><loc>https://%2$s/jobs/%1$d</loc></url><url><loc>\n https://%2$s/jobs/%1$d </loc></url><url><loc><![CDATA[https://%2$s/careers/%1$d?id=1]]></loc></url><url><loc>https://%2$s/about</loc></url><url><loc>https://other.invalid/jobs/%1$d</loc></url></urlset>"
    xml = F.when(k % 4 == 3, F.format_string("User-agent: *\nSitemap: https://%2$s/sitemap-%1$d.xml\nDisallow: /jobs/x", k, host)).otherwise(F.format_string(locs, k, host))
    df = table(spark, sf_dir, "pages").select("page_id", xml.alias("xml"), F.concat(F.lit("https://"), host, F.lit("/")).alias("base_url"))
    return openings.sitemap_urls(df, keep=("page_id",)).select("page_id", "url")


CHALLENGED = " OR ".join(f"contains(lower(body), '{x}')" for x in listing_checks.CHALLENGES)


@query(
    f"""SELECT page_id, CASE WHEN status IN (401, 403) OR coalesce({CHALLENGED}, FALSE) THEN 'blocked' WHEN status = 429 OR status >= 500 THEN 'retry' WHEN status < 400 THEN 'ok' ELSE 'failed' END AS state
FROM (SELECT page_id, [200, 200, 403, 429, 503, 404, 401][page_id % 7 + 1] AS status,
      CASE page_id % 5 WHEN 0 THEN html || '<div class="G-Recaptcha"></div>' WHEN 1 THEN html || '<p>CAPTCHA abuse detection experience</p>' WHEN 2 THEN NULL ELSE html END AS body FROM pages)"""
)
def fetch_states(spark, sf_dir):
    k = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, (200, 200, 403, 429, 503, 404, 401))), (k % 7 + 1).cast("int"))
    body = F.when(k % 5 == 0, F.concat("html", F.lit('<div class="G-Recaptcha"></div>'))).when(k % 5 == 1, F.concat("html", F.lit("<p>CAPTCHA abuse detection experience</p>"))).when(k % 5 != 2, F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", listing_checks.fetch_state(status, body).alias("state"))
