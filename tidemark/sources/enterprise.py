"""JSON boards of large employers: each a row of ``BOARDS``, read as VARIANT.

A row says where the list stands, the paths of each field (the first that holds
something counts), what codes mean, how dates are written, what an item must hold
to be a posting at all, and when it is closed.  Boards that ask a code of a list of
codes have it split and matched.  A payload may come in a callback.

An item without id or title is left out; a payload without its list, or that is no
JSON, gives no rows; every family reads its own payloads.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources.paged import got

NAMES = ("url", "location", "employment_type", "career", "opens_at", "closes_at", "department", "description_html")


@dataclass(frozen=True)
class Board:
    """``url``: a pattern with %s for the id, or "" where a field holds it; ``codes``: field -> (meanings, what else); ``dates``: field -> compact or long;
    ``equal``: (path, value) that must hold; ``unlike``: that must not; ``groups``: (path, codes) of which one must be in a list divided by commas;
    ``flags``: all true, or closed; ``numbered``: (number, count): closed where the number is larger; ``pool``: no pool of talents.
    """

    items: str
    ids: tuple[str, ...]
    title: tuple[str, ...]
    url: str = ""
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)
    codes: dict[str, tuple[dict[str, str], str | None]] = field(default_factory=dict)
    dates: dict[str, str] = field(default_factory=dict)
    fixed: dict[str, str] = field(default_factory=dict)
    equal: tuple[tuple[str, str], ...] = ()
    unlike: tuple[tuple[str, str], ...] = ()
    groups: tuple[str, tuple[str, ...]] | None = None
    flags: tuple[str, ...] = ()
    numbered: tuple[str, str] | None = None
    pool: bool = False


_CJ = ({"A": "신입", "B": "경력", "C": "인턴", "D": "산학실습", "E": "신입/경력", "K": "리턴십"}, "신입")
# Where the payloads of these boards keep a posting's fields, and what their codes mean.
BOARDS = {
    "posco": Board(
        "$.recuList", ("HR_AFTC_MRG_ADOP_NTIC_ID",), ("HR_AFTC_MRG_ADOP_NTIC_SUJX",), "/h22a01-front/H22A1001.html?id=%s",
        {"employment_type": ("HR_AFTC_MRG_ADOP_CLTA_TP_TP_NM",), "career": ("HR_AFTC_MRG_ADOP_CLTA_TP_TP_NM",), "closes_at": ("END_ACTIVE_DATE",), "department": ("COMPANY_NAME",)},
    ),
    "sk": Board(
        "$.list", ("noticeID", "jobNoticeNo"), ("title",), "/Recruit/Detail/%s", {"employment_type": ("workingType",), "career": ("recruitType",), "location": ("workingArea",), "opens_at": ("start",), "closes_at": ("end",), "department": ("corpName",)},
        {"career": ({"New": "신입", "Experienced": "경력"}, "")}, {"opens_at": "long", "closes_at": "long"},
    ),
    "lg_ai": Board(
        "$.data.list", ("seq",), ("jbrl",), "https://www.lgresearch.ai/careers/view?seq=%s", {"description_html": ("cont", "rspn"), "employment_type": ("jobtypeCd",), "location": ("officeCd",), "opens_at": ("prdStrtYmd",), "closes_at": ("prdEndYmd",), "department": ("rlmCd",)},
        {"employment_type": ({"JBAAAA": "Full-time", "JBBBBB": "Contract", "JBCCCC": "Internship", "JBEEEE": "Postdoctoral"}, None), "location": ({"JDAAAA": "Magok, Seoul", "JDBBBB": "Ann Arbor, Michigan"}, None),
         "department": ({"JAAAAA": "Data Intelligence", "JAAADD": "Language", "JAAAEE": "Physical Intelligence", "JAAAHH": "Superintelligence", "JAAAHU": "Advanced Agent", "JAAAKK": "Platform & Infra", "JAAAXX": "Materials Intelligence", "JAPPPA": "Data & Analytics", "JAPPPP": "Product Development", "JAQQQQ": "Bio Intelligence", "JASSSS": "EXAONE"}, None)}, {"opens_at": "compact", "closes_at": "compact"},
        equal=(("officeCd", "JDAAAA"), ("expsYn", "Y")), groups=("groupCd", ("JCAAAA", "JCAAAC")), pool=True,
    ),
    "smilegate": Board(
        "$.announce", ("announceSeq",), ("title",), "https://careers.smilegate.com/apply/announce/view?seq=%s", {"employment_type": ("hireTypeNm",), "career": ("careerTypeNm",), "closes_at": ("endDate",), "department": ("companyNm",)}, {}, {"closes_at": "compact"},
    ),
    "kt": Board(
        "$.data", ("recruitNoticeSn",), ("recruitNoticeName", "title"), "",
        {"url": ("recruitNoticeUrl",), "description_html": ("contents",), "employment_type": ("recruitClassName",), "career": ("recruitClassName",), "opens_at": ("receiveStartDatetime",), "closes_at": ("receiveEndDatetime",), "department": ("company",)}, flags=("isPost", "isInProgress"),
    ),
    "cj": Board(
        "$", ("ZZ_JO_NUM",), ("ZZ_TITLE",), "https://recruit.cj.net/recruit/ko/recruit/recruit/detail.fo?zz_jo_num=%s", {"employment_type": ("ZZ_TARGET_1",), "career": ("ZZ_TARGET_1",), "opens_at": ("ZZ_STR_DT",), "closes_at": ("ZZ_END_DT",)},
        {"employment_type": _CJ, "career": _CJ}, fixed={"department": "CJ OliveNetworks"}, numbered=("RNUM", "ACTIVE_CNT"),
    ),
    "atlassian": Board("$", ("id",), ("title",), "", {"url": ("applyUrl", "portalJobPost.portalUrl"), "location": ("locations[0]",), "employment_type": ("type",), "description_html": ("overview",), "department": ("category",)}),
    "jibe": Board(
        "$.jobs", ("data.req_id", "data.slug"), ("data.title",), "",
        {"url": ("data.meta_data.canonical_url", "data.apply_url"), "location": ("data.full_location", "data.short_location", "data.location_name"), "employment_type": ("data.employment_type",), "opens_at": ("data.posted_date",), "closes_at": ("data.posting_expiry_date",), "description_html": ("data.description",)},
        equal=(("data.country_code", "KR"),), unlike=(("data.searchable", "false"), ("data.applyable", "false")),
    ),
}


def _dated(c: Column, how: str | None) -> Column:
    """compact: eight digits as a day, other text as it is; long: "July 01, 2026" (what stands in brackets left out), other text is none."""
    if how == "compact":
        return F.when(F.trim(c).rlike(r"^\d{8}$"), F.regexp_replace(F.trim(c), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")).otherwise(c)
    if how == "long":
        return F.date_format(F.try_to_timestamp(F.trim(F.regexp_extract(c, r"^([^(]*)", 1)), F.lit("MMMM d, yyyy")), "yyyy-MM-dd")
    return c


def _coded(c: Column, spec: tuple[dict[str, str], str | None] | None) -> Column:
    """A code's meaning; for others what is named, themselves if that is empty."""
    if spec is None:
        return c
    meanings, other = spec
    known = F.element_at(F.create_map(*(F.lit(x) for pair in meanings.items() for x in pair)), c)
    return F.coalesce(known, c if other == "" else F.lit(other))


def openings(landed: DataFrame) -> DataFrame:
    """(source_id, family, external_id, title, status, and ``NAMES``) of ``landed``: source_id, family, payload."""
    text = F.regexp_replace("payload", r"(?s)^\s*[\w$.]+\((.*)\)\s*;?\s*$", "$1")
    out = None
    for family, b in BOARDS.items():
        mine = landed.filter(F.col("family") == family).select("source_id", "family", F.try_parse_json(text).alias("v"))
        item = mine.select("source_id", "family", F.explode(F.try_variant_get("v", b.items, "array<variant>")).alias("item"))
        at = lambda paths, kind="string": got("item", tuple(f"$.{p}" for p in paths), kind)
        ident, title = at(b.ids), tx.unescaped(at(b.title))
        keep = ident.isNotNull() & (title != "")
        for path, value in b.equal:
            keep = keep & F.coalesce(at((path,)) == value, F.lit(False))
        for path, value in b.unlike:
            keep = keep & ~F.coalesce(F.lower(at((path,))) == value, F.lit(False))
        if b.groups:
            keep = keep & F.coalesce(F.arrays_overlap(F.split(at((b.groups[0],)), ","), F.array(*map(F.lit, b.groups[1]))), F.lit(False))
        if b.pool:
            keep = keep & ~tx.contains_any(F.regexp_replace(F.lower(title), tx.SPACES, ""), ("인재풀", "talentpool"))
        closed = F.lit(False)
        for path in b.flags:
            closed = closed | ~F.coalesce(at((path,), "boolean"), F.lit(True))
        if b.numbered:
            closed = closed | F.coalesce(at((b.numbered[0],), "int") > at((b.numbered[1],), "int"), F.lit(False))
        none = F.lit(None).cast("string")
        value = lambda n: F.lit(b.fixed[n]) if n in b.fixed else _dated(_coded(at(b.fields[n]), b.codes.get(n)), b.dates.get(n)) if n in b.fields else F.format_string(b.url, ident) if n == "url" and b.url else none  # noqa: E731, B023
        one = item.filter(keep).select("source_id", "family", ident.alias("external_id"), title.alias("title"), F.when(closed, "closed").otherwise("open").alias("status"), *(value(n).alias(n) for n in NAMES))
        out = one if out is None else out.unionByName(one)
    return out
