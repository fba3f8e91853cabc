"""What postings' codes are called, and a posting's text as blocks to read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of career types, kinds of employment and regions, and what is said where one is missing or unknown.
CAREER = {"new_comer": "신입", "newcomer": "신입", "experienced": "경력", "mixed": "신입·경력", "not_matter": "경력 무관"}
EMPLOYMENT = {
    "regular": "정규직", "full_time": "정규직", "contract": "계약직", "intern": "인턴", "part_time": "파트타임", "freelancer": "프리랜서", "FULL_TIME": "정규직", "FULL_TIME_WORKER": "정규직", "CONTRACT": "계약직", "CONTRACT_WORKER": "계약직", "INTERN": "인턴", "INTERN_WORKER": "인턴",
    "MILITARY_SERVICE_EXCEPTION": "병역 특례", "PART_TIME": "파트타임", "PART_TIME_WORKER": "파트타임", "FREELANCER": "프리랜서", "정규": "정규직", "계약": "계약직", "인턴": "인턴",
}
LOCATION = {"SEOUL": "서울", "GYEONGGI": "경기", "INCHEON": "인천", "BUSAN": "부산", "DAEJEON": "대전", "DAEGU": "대구", "GWANGJU": "광주", "JEJU": "제주", "REMOTE": "원격"}
NO_CAREER, OTHER_CAREER = "경력 미기재", "경력 조건 확인 필요"
NO_EMPLOYMENT, OTHER_EMPLOYMENT = "고용 형태 미기재", "고용 형태 확인 필요"
NO_LOCATION, OTHER_LOCATION = "근무지 미기재", "근무지 확인 필요"


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def career(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", NO_CAREER).otherwise(F.coalesce(F.try_element_at(_table(CAREER), c), F.lit(OTHER_CAREER)))


def employment(c: Column) -> Column:
    """Several kinds may be named, divided by , | ; or /; unknown ones are left out unless all are."""
    known = F.array_distinct(F.array_compact(F.transform(F.split(c, "[,|;/]+"), lambda x: F.try_element_at(_table(EMPLOYMENT), F.trim(x)))))
    return F.when(F.coalesce(c, F.lit("")) == "", NO_EMPLOYMENT).when(F.size(known) > 0, F.array_join(known, " · ")).otherwise(OTHER_EMPLOYMENT)


def location(c: Column) -> Column:
    """A code's name; a code without one is to be checked; other text stays."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == "", NO_LOCATION).otherwise(F.coalesce(F.try_element_at(_table(LOCATION), text), F.when(text.rlike("^[A-Z0-9_]+$"), OTHER_LOCATION), text))


HEADS, BULLET = r"#{2,4}\s+", r"[*•◦-]\s+"


def description_blocks(text: Column) -> Column:
    """Array of (kind, level, text, items): headings, paragraphs, and lists of what stands behind bullets in lines that follow each other.

    Headings and bullets may also begin within a line.  Bulleted lines are joined
    by a mark before the text is cut into lines, so each chunk is one block.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, rf"[ \t]+(?={HEADS})", "\n"), rf"[ \t]+(?={BULLET})", "\n")
    lines = F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), "\n")
    joined = F.regexp_replace(lines, rf"(?m)^({BULLET}[^\n]+)\n(?={BULLET}[^\n])", "$1\u0001")
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def block(x):
        head, listed = x.rlike(rf"^{HEADS}[^\n]"), x.rlike(rf"^{BULLET}[^\n]")
        items = F.transform(F.split(x, "\u0001"), lambda i: trimmed(F.regexp_replace(i, rf"^{BULLET}", "")))
        return F.struct(
            F.when(head, "heading").when(listed, "list").otherwise("paragraph").alias("kind"), F.when(head, F.when(x.rlike(r"^###"), 3).otherwise(2)).alias("level"), F.when(head, trimmed(F.regexp_replace(x, rf"^{HEADS}", ""))).when(~listed, x).alias("text"),
            F.when(~head & listed, items).otherwise(F.array().cast("array<string>")).alias("items"),
        )

    return F.when(joined == "", F.expr("array()").cast("array<struct<kind:string,level:int,text:string,items:array<string>>>")).otherwise(F.transform(F.split(joined, "\n"), block))
