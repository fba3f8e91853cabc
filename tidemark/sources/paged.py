"""Listings that come in pages: JSON payloads as VARIANT, joined into one listing if its pages prove that it is whole.

What a family's payload looks like, and what its pages must prove, is a row of
``PAGING``; the rows are compiled into one expression per column, so a new
family is a new row.  A page is parsed once, its items are exploded, and a
listing's facts are two aggregations by source.  A listing whose pages prove
nothing gives no openings, only the reason (``state``), the first that holds:

invalid_payload, missing_list, too_many_pages, moved_page, moved_total,
moved_size, empty_page, missing_id, repeated_id, unknown_affiliate, incomplete;
else complete, or empty for a stated total of 0.

A null payload is invalid; an unknown family is unsupported_connector; pages of
one number that stand twice repeat their ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGES = 50


@dataclass(frozen=True)
class Paging:
    """Paths of a family's payload, and its rules.

    ``repeats``: refuse (a listing with an id twice), once (they count, but stay once) or keep;
    ``counted``: whether the items must be as many as stated; ``later_zero``: whether pages after the first may state 0.
    """

    items: str
    total: str
    ids: tuple[str, ...]
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)
    number: str | None = None
    size: str | None = None
    affiliate: str | None = None
    repeats: str = "refuse"
    counted: bool = True
    later_zero: bool = False


# Where the payloads of paged boards keep their list, total and fields, and what their pages must prove.
PAGING = {
    "apple": Paging("$.searchResults", "$.totalRecords", ("$.positionId", "$.reqId", "$.id"), {"title": ("$.postingTitle",), "location": ("$.locations[0].name",), "opens_at": ("$.postDateInGMT",)}),
    "pcsx": Paging("$.data.positions", "$.data.count", ("$.id", "$.displayJobId", "$.atsJobId"), {"title": ("$.name",), "location": ("$.locations[0]", "$.location"), "url": ("$.positionUrl", "$.canonicalPositionUrl"), "opens_at": ("$.postedTs",)}, repeats="once"),
    "workday": Paging("$.jobPostings", "$.total", ("$.externalPath", "$.bulletFields[0]"), {"title": ("$.title",), "location": ("$.locationsText",), "url": ("$.externalPath",), "opens_at": ("$.startDate",)}, later_zero=True),
    "lge": Paging("$.data.list", "$.data.total", ("$.jobNoticeId", "$.id"), {"title": ("$.jobNoticeName", "$.title"), "closes_at": ("$.endDate",)}, size="$.data.size", repeats="keep", counted=False),
    "nexon": Paging("$.list", "$.pagination.total", ("$.id", "$.jobId"), {"title": ("$.title",), "location": ("$.workingArea",), "description_html": ("$.contents",), "opens_at": ("$.startDate",), "closes_at": ("$.recruitEndDate", "$.endDate")}, "$.pagination.page", "$.pagination.size", "$.corpName"),
}
FIELDS = ("title", "url", "location", "employment_type", "description_html", "opens_at", "closes_at")


def by_family(choose, none: Column) -> Column:
    """One expression for all families: for each, what ``choose`` makes of its row."""
    out = none
    for name, rule in PAGING.items():
        made = choose(rule)
        out = F.when(F.col("family") == name, made if made is not None else none).otherwise(out)
    return out


def got(value: Column | str, paths: tuple[str, ...], kind: str = "string") -> Column | None:
    """The first of the paths that holds something."""
    found = [F.try_variant_get(value, p, kind) for p in paths if p]
    return F.coalesce(*(F.when(F.trim(f) != "", f) if kind == "string" else f for f in found)) if found else None


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (source_id, family, page, payload, affiliate, affiliates) with total, size, number and items."""
    null = lambda t: F.lit(None).cast(t)
    whole = {n: by_family(lambda r, n=n: got("v", (getattr(r, n),), "long"), null("long")) for n in ("total", "size", "number")}
    v = pages.withColumn("v", F.try_parse_json("payload"))
    return v.select("source_id", "family", "page", "affiliate", "affiliates", F.col("v").isNull().alias("invalid"), *(c.alias(n) for n, c in whole.items()), by_family(lambda r: F.try_variant_get("v", r.items, "array<variant>"), null("array<variant>")).alias("items"))


def listed(pages: DataFrame) -> DataFrame:
    """A row per item: source_id, family, page, at, id, affiliate_of, item."""
    each = parsed(pages).select("source_id", "family", "page", "affiliate", "affiliates", F.posexplode("items").alias("at", "item"))
    null = F.lit(None).cast("string")
    return each.withColumn("id", by_family(lambda r: got("item", r.ids), null)).withColumn("affiliate_of", by_family(lambda r: got("item", (r.affiliate,)), null))


def verdicts(pages: DataFrame) -> DataFrame:
    """(source_id, family, state, pages, items, stated): what the pages of each listing prove."""
    first = F.min_by("total", "page")
    facts = parsed(pages).groupBy("source_id", "family").agg(
        F.count("*").alias("pages"), F.max("invalid").alias("invalid"), F.max(F.col("items").isNull() | F.col("total").isNull()).alias("no_list"), first.alias("stated"), F.max(F.when(F.col("page") > 1, F.col("total"))).alias("later_most"),
        F.min(F.when(F.col("page") > 1, F.col("total"))).alias("later_least"), F.min(F.when(F.col("page") > 1, F.nullif("total", F.lit(0)))).alias("later_some"), (F.min("size") != F.max("size")).alias("sizes"), F.max(F.coalesce(F.col("number") != F.col("page"), F.lit(False))).alias("numbers"),
        (F.min("page") != 1).alias("late"), (F.max("page") - F.min("page") + 1).alias("span"), F.max((F.col("page") > 1) & (F.size("items") == 0)).alias("empty"),
    )
    ids = listed(pages).groupBy("source_id").agg(F.count("*").alias("items"), F.count("id").alias("with_id"), F.countDistinct("id").alias("ids"), F.max(F.coalesce(~F.array_contains("affiliates", F.col("affiliate_of")), F.lit(False))).alias("stranger"))
    d = facts.join(ids, "source_id", "left").fillna({"items": 0, "with_id": 0, "ids": 0, "stranger": False})
    rule = lambda choose: by_family(lambda r: F.lit(choose(r)), F.lit(False))
    later = F.when(rule(lambda r: r.later_zero), F.coalesce((F.col("later_some") != F.col("stated")) | ((F.col("later_most") > 0) & (F.col("later_most") != F.col("stated"))), F.lit(False))).otherwise(
        F.coalesce((F.col("later_most") != F.col("stated")) | (F.col("later_least") != F.col("stated")), F.lit(False))
    )
    state = (
        F.when(~F.col("family").isin(*PAGING), "unsupported_connector")
        .when(F.col("invalid"), "invalid_payload")
        .when(F.col("no_list"), "missing_list")
        .when(F.col("pages") > MAX_PAGES, "too_many_pages")
        .when(F.col("numbers") | F.col("late") | (F.col("span") > F.col("pages")), "moved_page")
        .when(rule(lambda r: r.counted) & later, "moved_total")
        .when(F.coalesce("sizes", F.lit(False)), "moved_size")
        .when(F.col("empty") | ((F.col("stated") > 0) & (F.col("items") == 0)), "empty_page")
        .when(rule(lambda r: r.repeats != "keep") & (F.col("with_id") < F.col("items")), "missing_id")
        .when(rule(lambda r: r.repeats == "refuse") & (F.col("ids") < F.col("items")), "repeated_id")
        .when(F.col("stranger"), "unknown_affiliate")
        .when(rule(lambda r: r.counted) & (F.col("items") != F.col("stated")), "incomplete")
        .when(F.col("stated") == 0, "empty")
        .otherwise("complete")
    )
    return d.select("source_id", "family", state.alias("state"), "pages", "items", "stated")


def openings(pages: DataFrame) -> DataFrame:
    """Openings of the complete listings: source_id, family, external_id and ``FIELDS``; of a source with an affiliate only that one's."""
    whole = verdicts(pages).filter("state = 'complete'").select("source_id")
    rows = listed(pages).join(whole, "source_id", "left_semi").filter(F.col("affiliate").isNull() | F.coalesce(F.col("affiliate_of") == F.col("affiliate"), F.lit(False)))
    once = Window.partitionBy("source_id", "id").orderBy("page", "at")
    kept = rows.withColumn("_n", F.row_number().over(once)).filter((F.col("_n") == 1) | by_family(lambda r: F.lit(r.repeats == "keep"), F.lit(False)))
    null = F.lit(None).cast("string")
    return kept.select("source_id", "family", F.col("id").alias("external_id"), *(by_family(lambda r, f=f: got("item", r.fields.get(f, ())), null).alias(f) for f in FIELDS))
