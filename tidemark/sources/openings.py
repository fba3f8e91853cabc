"""Connectors: a landed payload -> openings, one schema for all.

JSON boards differ only in where things stand, so each is a table of paths; the
parsers below are for pages without such a feed.  ``parse`` runs the connector
that a row names; a payload that does not parse gives an error row, not a
failure.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import parse_qs, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import markup

FIELDS = "external_id string, url string, title string, status string, description_html string, description_text string, employment_type string, career_type string, career_min int, career_max int, location string, opens_at string, closes_at string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def opening(url: str | None, title: Any, **found: Any) -> dict:
    html = str(found.get("description_html") or "")
    values = dict.fromkeys(NAMES) | {k: v for k, v in found.items() if k in NAMES and v not in (None, "")}
    low, high = (int(v) if str(v or "").isdigit() else None for v in (found.get("career_min"), found.get("career_max")))
    text = lambda k: None if values[k] is None else str(values[k])
    return {k: text(k) for k in NAMES} | {
        "url": url, "title": " ".join(str(title or "").split()), "status": found.get("status") or "open", "external_id": str(found.get("external_id") or hashlib.sha256((url or "").encode()).hexdigest()[:32]), "description_html": html,
        "description_text": markup.structured_text(html, str(found.get("description_text") or "")), "career_min": low, "career_max": high, "career_type": found.get("career_type") or career_type(str(title or "")),
    }


def career_type(text: str) -> str | None:
    new, old = "신입" in text, "경력" in text
    return "mixed" if new and old else "new_comer" if new else "experienced" if old else None


def at(value: Any, path: str) -> Any:
    """A value by a dotted path; lists give their first element where the path goes on by name, all joined at the end."""
    for step in path.split(".") if path else []:
        if isinstance(value, list):
            value = value[int(step)] if step.isdigit() and int(step) < len(value) else value[0] if value else None
            if step.isdigit():
                continue
        value = value.get(step) if isinstance(value, dict) else None
    if isinstance(value, list):
        return ", ".join(str(v.get("name") if isinstance(v, dict) else v) for v in value if v)
    return value


# Fixed values of public job board feeds: where the list stands, and the path of each field ("a|b": the first that is there).
BOARDS = {
    "lever": {"list": "", "external_id": "id", "title": "text", "url": "hostedUrl|applyUrl", "location": "categories.location", "employment_type": "categories.commitment", "description_html": "description", "description_text": "descriptionPlain", "opens_at": "createdAt"},
    "greenhouse": {"list": "jobs", "external_id": "id", "title": "title", "url": "absolute_url", "location": "location.name", "description_html": "content", "opens_at": "first_published|updated_at"},
    "ashby": {"list": "jobs", "external_id": "id", "title": "title", "url": "jobUrl|applyUrl", "location": "location", "employment_type": "employmentType", "description_html": "descriptionHtml", "description_text": "descriptionPlain", "opens_at": "publishedAt"},
    "workday": {"list": "jobPostings", "external_id": "bulletFields.0|externalPath", "title": "title", "url": "externalPath", "location": "locationsText", "opens_at": "startDate"},
    "amazon": {"list": "jobs", "external_id": "id_icims|id", "title": "title", "url": "job_path", "location": "normalized_location|location", "employment_type": "job_schedule_type", "description_html": "description", "opens_at": "posted_date"},
    "pcsx": {"list": "data.positions|positions", "external_id": "id", "title": "name", "url": "positionUrl|canonicalPositionUrl", "location": "location|locations", "opens_at": "postedTs|t_create"},
    "successfactors": {"list": "jobSearchResult|jobs", "external_id": "response.id|id", "title": "response.unifiedStandardTitle|title", "url": "response.unifiedUrlTitle|url", "location": "response.jobLocationShort|location", "opens_at": "response.unifiedStandardStart"},
    "breezy": {"list": "", "external_id": "id", "title": "name", "url": "url", "location": "location.name", "employment_type": "type.name", "description_html": "description", "opens_at": "published_date"},
    "kakao": {"list": "jobList", "external_id": "realId|jobOfferId", "title": "jobOfferTitle", "url": "jobOfferUrl|realId", "location": "locationName", "employment_type": "employeeTypeName", "description_html": "workContentDesc", "closes_at": "endDate", "opens_at": "regDate"},
    "naver": {"list": "list|result", "external_id": "annoId", "title": "annoSubject", "url": "jobDetailLink", "employment_type": "empTypeCdNm", "career_type": "entTypeCdNm", "opens_at": "staYmdTime", "closes_at": "endYmdTime"},
}


def first(item: Any, paths: str | None) -> Any:
    return next((v for p in (paths or "").split("|") if (v := at(item, p)) not in (None, "", [])), None) if paths else None


def board(payload: str, base: str, family: str) -> list[dict]:
    data, spec = decode(payload), BOARDS[family]
    items = next((v for p in spec["list"].split("|") if isinstance(v := walk(data, p), list)), None)
    if items is None:
        raise ValueError("the payload has no list of postings")
    out = []
    for item in items:
        found = {k: first(item, p) for k, p in spec.items() if k not in ("list", "url", "title")}
        if title := first(item, spec["title"]):
            out.append(opening(urljoin(base, str(first(item, spec["url"]) or "")), title, **found))
    return out


def walk(data: Any, path: str) -> Any:
    for step in path.split(".") if path else []:
        data = data.get(step) if isinstance(data, dict) else None
    return data


def decode(payload: str) -> Any:
    """JSON, JSON in a callback, or the JSON a page carries for its scripts."""
    text = payload.strip()
    if text.startswith("<"):
        found = markup.scripts(text, ident="__NEXT_DATA__") or markup.scripts(text, kind="application/json")
        if not found:
            raise ValueError("the page carries no JSON")
        text = found[0]
    elif m := re.fullmatch(r"[\w$.]+\((.*)\)\s*;?", text, re.S):
        text = m[1]
    return json.loads(text)


def nested(value: Any) -> Iterator[dict]:
    """Every mapping within a JSON value, outer ones first."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from nested(v)
    elif isinstance(value, list):
        for v in value:
            yield from nested(v)


def jsonld(page: str, base: str) -> list[dict]:
    """schema.org JobPosting objects of a page, wherever they stand in its JSON-LD."""
    out = []
    for text in markup.scripts(page, kind="application/ld+json"):
        try:
            data = json.loads(text)
        except ValueError:
            continue
        for item in nested(data):
            kinds = item.get("@type")
            if "JobPosting" not in (kinds if isinstance(kinds, list) else [kinds]):
                continue
            place = at(item, "jobLocation.address") if not isinstance(at(item, "jobLocation.address"), str) else None
            where = ", ".join(str(v) for k in ("addressLocality", "addressRegion", "addressCountry") if (v := at(item, f"jobLocation.address.{k}")) and not isinstance(v, dict)) if isinstance(place, dict) else at(item, "jobLocation.address")
            ident = item.get("identifier")
            out.append(
                opening(
                    urljoin(base, str(item.get("url") or base)), item.get("title"), external_id=ident.get("value") if isinstance(ident, dict) else ident, description_html=item.get("description"), employment_type=at(item, "employmentType"), location=where, opens_at=item.get("datePosted"), closes_at=item.get("validThrough")
                )
            )
    return out


# What the address of a posting looks like, and keys of its id in the query.
JOB_PATH = re.compile(r"/(?:jobs?|careers?|recruit(?:ment)?|positions?|openings?|o|posting|notice)(?:/|[?#-])[^\s]*", re.I)
JOB_KEYS = ("id", "jobid", "job_id", "no", "seq", "idx", "recruitid", "annoid", "jobno")
DATE = re.compile(r"(20\d\d)\s*[./년-]\s*(\d{1,2})\s*[./월-]\s*(\d{1,2})")


def link_id(url: str) -> str | None:
    parts = urlsplit(url)
    query = {k.lower(): v[0] for k, v in parse_qs(parts.query).items()}
    named = next((query[k] for k in JOB_KEYS if query.get(k)), None)
    tail = parts.path.rstrip("/").rsplit("/", 1)[-1]
    return named or (tail if re.search(r"\d", tail) else None)


def html_listing(page: str, base: str) -> list[dict]:
    """Postings from the links of a listing: same host, an address like a posting's, a title; dates from the text."""
    host, seen, out = urlsplit(base).hostname, set(), []
    for link in markup.links(page, base):
        url, text = link["url"], link["text"]
        if urlsplit(url).hostname != host or not JOB_PATH.search(url) or len(text) < 4 or url in seen:
            continue
        seen.add(url)
        days = [f"{y}-{int(m):02d}-{int(d):02d}" for y, m, d in DATE.findall(text)]
        title = DATE.sub("", text).strip(" ~|-") or text
        out.append(opening(url, title, external_id=link_id(url), opens_at=days[0] if len(days) > 1 else None, closes_at=days[-1] if days else None))
    return out


# Names under which site data keeps a posting's fields.
KEYS = {
    "title": ("title", "jobTitle", "name", "subject", "positionName", "recruitTitle"),
    "external_id": ("id", "jobId", "openingId", "recruitId", "seq", "slug"),
    "url": ("url", "link", "href", "jobUrl", "detailUrl"),
    "description_html": ("descriptionHtml", "description", "content", "detail", "body"),
    "location": ("location", "workLocation", "place", "region", "address"),
    "employment_type": ("employmentType", "jobType", "employType", "contractType"),
    "opens_at": ("openDate", "startDate", "openedAt", "publishedAt", "createdAt"),
    "closes_at": ("closeDate", "endDate", "dueDate", "deadline", "closedAt"),
}


def next_data(page: str, base: str) -> list[dict]:
    """Postings anywhere in a page's data: mappings with a title, an id, and a description, an address or a date."""
    out, seen = [], set()
    for item in nested(decode(page)):
        found = {f: next((item[k] for k in keys if isinstance(item.get(k), (str, int))), None) for f, keys in KEYS.items()}
        if not found["title"] or found["external_id"] is None or not (found["description_html"] or found["url"] or found["opens_at"] or found["closes_at"]):
            continue
        if found["external_id"] in seen:
            continue
        seen.add(found["external_id"])
        url = urljoin(base, str(found["url"])) if found["url"] else f"{base.rstrip('/')}/{found['external_id']}"
        out.append(opening(url, found["title"], **{k: v for k, v in found.items() if k not in ("title", "url")}))
    return out


def rendered(page: str, base: str) -> list[dict]:
    """What a browser rendered: the first parser that finds something."""
    for parser in (jsonld, next_data, html_listing):
        try:
            if found := parser(page, base):
                return found
        except ValueError:
            continue
    return []


CONNECTORS = {"jsonld": jsonld, "html_listing": html_listing, "next_data": next_data, "browser": rendered} | {f: (lambda p, b, f=f: board(p, b, f)) for f in BOARDS}


def parse(df: DataFrame, family: str = "family", payload: str = "payload", base: str = "base_url", key: str = "source_id") -> DataFrame:
    """Openings of every payload by the connector its row names; ``error`` says why one gave none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([(key, b.schema.field(0).type), *((n, pa.int32() if n in ("career_min", "career_max") else pa.string()) for n in NAMES), ("error", pa.string())])
            rows = []
            for k, f, p, u in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows += [{key: k, **o} for o in CONNECTORS[f](p or "", u or "")] if f in CONNECTORS else [{key: k, "error": "unsupported_connector"}]
                except (ValueError, TypeError, AttributeError, KeyError) as e:
                    rows.append({key: k, "error": f"listing_parse_error: {type(e).__name__}"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select(key, family, payload, base).mapInArrow(run, f"`{key}` {kind}, {FIELDS}, error string")


def combined_pages(pages: DataFrame, listing: str, total: str, item: str, url: str = "listing") -> DataFrame:
    """Listings whose pages together are complete: no id twice, and as many as the feed states.

    ``pages``: listing, a total per page, and one row per item id.
    """
    return pages.groupBy(listing).agg(F.count(item).alias("items"), F.countDistinct(item).alias("distinct_items"), F.min(total).alias("lo"), F.max(total).alias("hi")).withColumn("complete", (F.col("lo") == F.col("hi")) & (F.col("items") == F.col("distinct_items")) & (F.col("items") == F.col("hi")))


def sitemap_urls(df: DataFrame, xml: str = "xml", base: str = "base_url", keep: tuple[str, ...] = ()) -> DataFrame:
    """Addresses like a posting's in sitemaps or robots files, each once, on the file's own host; ``keep`` names columns that go along."""
    locs = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)"), F.lit(1))
    robots = F.regexp_extract_all(F.col(xml), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    rows = df.select(*keep, base, F.explode(F.concat(locs, robots)).alias("url"))
    own = F.try_parse_url(F.col("url"), F.lit("HOST")) == F.try_parse_url(F.col(base), F.lit("HOST"))
    return rows.filter(own & (F.col("url").rlike("(?i)" + r"/(?:jobs?|careers?|recruit(?:ment)?|positions?|openings?|posting)(?:/|[?#-])") | F.col("url").rlike(r"(?i)sitemap"))).distinct()
