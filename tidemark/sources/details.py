"""Detail pages of boards joined to the references of their listings.

A listing gives references: family, id, title, address.  Detail payloads are
landed apart, by family, and joined to them; a detail counts only if it says the
same id and title as its reference and has substance.  What a family's payload
looks like is a row of ``DETAILS``: paths into a VARIANT, sections in order,
codes and their meanings.  Each family reads its own payloads and has a plan of
its own size; what comes of a reference is told in ``state``:

missing (no payload landed), invalid_payload, failed (the payload says so),
missing_content, identity_mismatch, title_mismatch, not_substantive, hydrated.

References that aren't hydrated keep what the listing said.  Of payloads of one
reference the newest counts; a null id or family meets none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.skill_mentions import held

#: Fewest characters of a description without an image.
SUBSTANCE = 120


@dataclass(frozen=True)
class Detail:
    """Paths below ``root``.

    ``ids``: joined by a dash; ``success``: a path from the top and what it must say; ``sections``: (label, path) that must have substance,
    ``common``: those that follow; ``rows``: a list whose members have sections of their own (``row_sections``) under
    a heading from ``row_heading``; ``career`` and ``employment``: a path and the meanings of its codes; ``closed``: flags.
    """

    root: str
    ids: tuple[str, ...]
    title: str
    sections: tuple[tuple[str, str], ...] = ()
    common: tuple[tuple[str, str], ...] = ()
    rows: str = ""
    row_id: str = ""
    row_heading: tuple[str, ...] = ()
    row_sections: tuple[tuple[str, str], ...] = ()
    success: tuple[str, str] = ("", "")
    career: tuple = ("", {})
    employment: tuple = ("", {})
    years: tuple[str, str] = ("", "")
    opens: str = ""
    closes: str = ""
    closed: tuple[str, ...] = ()
    place: str = ""


_HYUNDAI = Detail("$.data.applyInfo", ("recuYy", "recuType", "recuCls"), "recuNoticeNm", (("팀 소개", "aboutTeamNtc"), ("직무 상세", "privJdDtl"), ("필수 요건", "privMustReq"), ("우대 요건", "prefReq")), (("기타", "etc"),))
# Where the detail payloads of boards keep id, title and sections, the labels of the sections, and what their codes mean.
DETAILS = {
    "hyundai": _HYUNDAI,
    "kia": _HYUNDAI,
    "lg": Detail(
        "$.data.jobNoticesDetail", ("jobNoticesDetail.jobNoticeId",), "jobNoticesDetail.jobNoticeName",
        common=(("지원 자격 및 안내", "jobNoticesDetail.qualForAppInfo"), ("전형 절차", "jobNoticesDetail.recProcessInfo"), ("지원 방법", "jobNoticesDetail.submitMethodInfo"), ("기타 안내", "jobNoticesDetail.otherInfo")),
        rows="recList", row_id="jobNoticeId", row_heading=("orgName", "jobGroupName"), row_sections=(("직무 내용", "detailContext"), ("필수 요건", "requiredItem"), ("우대 사항", "preferredItem")),
    ),
    "hanwha": Detail("$.data.item", ("rtSeq",), "rtNm", common=(("공통 자격", "rtExmQlf"), ("전형 절차", "rtExmProc"), ("지원 방법", "rtRctPrd"), ("기타 안내", "rtEct")), rows="unitDt", row_id="rtSeq", row_heading=("ruNm",), row_sections=(("", "ruDtlJob"),), place="ruWorkpl"),
    "smilegate": Detail("$", ("announceSeq",), "title", (("담당 업무", "workInfo"), ("자격 요건", "qualificationDesc"), ("필요 역량", "abilityDesc"), ("우대 사항", "specialDesc")), (("기타 안내", "description"),)),
    "woowahan": Detail(
        "$.data", ("recruitNumber",), "recruitName", (("", "recruitContents"),), success=("$.code", "2000"), career=("careerType.recruitItemCode", {"BA003001": "new_comer", "BA003002": "experienced", "BA003003": "mixed"}),
        employment=("employmentType.recruitItemCode", {"BA002001": "regular", "BA002002": "contract", "BA002003": "intern"}), years=("careerRestrictionMinYears", "careerRestrictionMaxYears"), opens="recruitOpenDate", closes="recruitEndDate", closed=("recruitDeleteYn", "isAfterOrEqualEndDay", "isHidden"),
    ),
    "kakaobank": Detail("$", ("recruitNoticeSn",), "recruitNoticeName", (("", "contents"),), opens="receiveStartDatetime", closes="receiveEndDatetime"),
    "workable": Detail("$", ("id",), "title", (("", "description"), ("자격 요건", "requirements"), ("복지 및 혜택", "benefits")), employment=("type", {"full": "regular", "part": "part_time", "contract": "contract", "temporary": "temporary", "other": "other"}), opens="published", closed=("isInternal",)),
}
#: Heading of a row without one.
UNNAMED = "모집 직무"


def plain(html: Column) -> Column:
    """The text of a fragment, collapsed."""
    return tx.collapsed(F.regexp_replace(html, r"<[^>]*+>", " "))


def fragment(raw: Column) -> Column:
    """A fragment whose marks may be written as references (up to twice), without scripts and styles."""
    return F.trim(F.regexp_replace(tx.unescaped(tx.unescaped(F.coalesce(raw, F.lit("")))), r"(?is)<(script|style|noscript|template)\b[^>]*+>.*?</\1\s*>", ""))


def section(label: str, raw: Column, level: int = 2) -> Column:
    """A section under its label, nothing if it has no text; without a label only its content."""
    content = fragment(raw)
    framed = F.concat(F.lit(f"<section><h{level}>{label}</h{level}>"), content, F.lit("</section>")) if label else content
    return F.when(plain(content) != "", framed).otherwise("")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _at(rule: Detail, path: str) -> str:
    return f"{rule.root}.{path}"


def _read(rule: Detail, details: DataFrame) -> DataFrame:
    """A family's payloads as (source_id, external_id, what was read)."""
    v = details.withColumn("v", F.try_parse_json("payload"))
    text = lambda path: F.try_variant_get("v", _at(rule, path), "string")
    flag = lambda path: F.coalesce(F.try_variant_get("v", _at(rule, path), "boolean"), F.lit(False))
    main = [section(label, text(path)) for label, path in rule.sections]
    content, foreign = F.concat_ws("", *main), F.lit(False)
    if rule.rows:
        rows = F.coalesce(F.try_variant_get("v", _at(rule, rule.rows), "array<variant>"), F.array().cast("array<variant>"))
        of = lambda row, path: F.try_variant_get(row, f"$.{path}", "string")

        def block(row):
            inner = F.concat_ws("", *(section(label, of(row, path), 3) for label, path in rule.row_sections))
            names = F.array_distinct(F.filter(F.array(*(tx.collapsed(of(row, p)) for p in rule.row_heading)), lambda n: n.isNotNull() & (n != "")))
            head = F.when(F.size(names) > 0, F.array_join(names, " · ")).otherwise(UNNAMED)
            where = F.when(tx.collapsed(of(row, rule.place)) != "", F.concat(F.lit("<p>근무지: "), escaped(tx.collapsed(of(row, rule.place))), F.lit("</p>"))) if rule.place else F.lit(None)
            return F.when(inner != "", F.concat(F.lit("<section><h2>"), escaped(head), F.lit("</h2>"), inner, F.coalesce(where, F.lit("")), F.lit("</section>"))).otherwise("")

        content = F.array_join(F.transform(rows, block), "")
        foreign = F.exists(rows, lambda row: F.coalesce(of(row, rule.row_id) != F.col("external_id"), F.lit(False)))
    meaning = lambda spec: F.element_at(F.create_map(*(F.lit(x) for pair in spec[1].items() for x in pair)), text(spec[0])) if spec[0] else F.lit(None).cast("string")
    closed = F.lit(False)
    for path in rule.closed:
        closed = closed | flag(path)
    # Behind a generator, so that sections are made once a row and not once a use.
    return held(
        v, _bad=F.col("v").isNull(), _ok=F.coalesce(F.try_variant_get("v", rule.success[0], "string") == rule.success[1], F.lit(False)) if rule.success[0] else F.lit(True),
        _there=F.try_variant_get("v", rule.root, "variant").isNotNull() & (F.try_variant_get("v", _at(rule, rule.rows), "array<variant>").isNotNull() if rule.rows else F.lit(True)), _id=F.concat_ws("-", *(text(p) for p in rule.ids)), _title=tx.collapsed(text(rule.title)), _foreign=foreign, _main=content,
        _common=F.concat_ws("", *(section(label, text(path)) for label, path in rule.common)), _career=meaning(rule.career), _employment=meaning(rule.employment), _low=F.try_variant_get("v", _at(rule, rule.years[0]), "int") if rule.years[0] else F.lit(None).cast("int"),
        _high=F.try_variant_get("v", _at(rule, rule.years[1]), "int") if rule.years[1] else F.lit(None).cast("int"), _opens=text(rule.opens) if rule.opens else F.lit(None).cast("string"), _closes=text(rule.closes) if rule.closes else F.lit(None).cast("string"), _closed=closed,
    ).drop("v", "payload")


def hydrated(references: DataFrame, details: DataFrame) -> DataFrame:
    """(source_id, family, external_id, url, title, state, status, description_html, career_type, employment_type, career_min, career_max, opens_at, closes_at).

    ``references``: source_id, family, external_id, url, title; ``details``:
    source_id, family, external_id, payload, fetched_at.
    """
    newest = details.groupBy("source_id", "family", "external_id").agg(F.max_by("payload", "fetched_at").alias("payload"))
    out = None
    for family, rule in DETAILS.items():
        mine = references.filter(F.col("family") == family)
        read = _read(rule, newest.filter(F.col("family") == family).drop("family"))
        met = mine.join(read, ["source_id", "external_id"], "left")
        state = (
            F.when(F.col("_bad").isNull(), "missing").when(F.col("_bad"), "invalid_payload").when(~F.col("_ok"), "failed").when(~F.col("_there"), "missing_content").when(F.col("_foreign") | ~F.coalesce(F.col("_id") == F.col("external_id"), F.lit(False)), "identity_mismatch")
            .when(~F.coalesce(F.col("_title") == tx.collapsed(F.col("title")), F.lit(False)), "title_mismatch").when((F.length(plain(F.col("_main"))) < SUBSTANCE) & ~F.col("_main").rlike("(?i)<img\\b"), "not_substantive").otherwise("hydrated")
        )
        one = met.withColumn("state", state)
        one = one.withColumn("_use", F.col("state") == "hydrated")
        use = lambda c: F.when(F.col("_use"), c)
        one = one.select(
            "source_id", "family", "external_id", "url", "title", "state", use(F.when(F.col("_closed"), "closed").otherwise("open")).alias("status"), use(F.concat("_main", "_common")).alias("description_html"), use(F.col("_career")).alias("career_type"),
            use(F.col("_employment")).alias("employment_type"), use(F.col("_low")).alias("career_min"), use(F.col("_high")).alias("career_max"), use(F.col("_opens")).alias("opens_at"), use(F.col("_closes")).alias("closes_at"),
        )
        out = one if out is None else out.unionByName(one)
    return out
