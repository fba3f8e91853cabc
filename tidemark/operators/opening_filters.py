"""Which openings of a source count as technical: a rule per family of sources, compiled into one expression.

A family without a rule is judged by its titles, and a source that doesn't aim at
technical roles keeps all.  A null title or text is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import roles
from tidemark.functions.text import contains_any
from tidemark.operators.skill_mentions import held

# Words of building sites and, against them, of software.
SITES = ("bim", "공조", "기계", "소방", "시공", "시설", "안전관리", "전기")
SOFTWARE = ("ai ", "backend", "cloud platform", "data ", "developer", "devops", "security", "software", "개발", "데이터", "보안", "소프트웨어")
# Departments that are technical as a whole.
MICROSOFT = (
    "applied sciences", "cloud solution architecture", "critical environment ops", "data center technicians", "data science", "electrical engineering", "hardware engineering", "quantum engineering", "research sciences", "security engineering", "security operations engineering",
    "service engineering", "silicon engineering", "site reliability engineering", "software engineering", "solution architecture",
)
QUALCOMM = ("asics engineering", "interim engineering intern - hw", "interim engineering intern - sw", "machine learning engineering", "manufacturing engineering", "software engineering", "systems engineering", "technical standards engineering")


@dataclass(frozen=True)
class Rule:
    """All that is named must hold.

    ``role``: title, texts (title and text), detail, home, home_or_url, or any;
    ``begins``: the title does; ``ends``: the text does, with one of them;
    ``lacks``: the title does; ``department``: the whole text is one of them;
    ``labelled``: the text's first word; ``pool``: no pool of talents; ``sites``: no building site without software.
    """

    role: str = "title"
    begins: str = ""
    ends: tuple[str, ...] = ()
    lacks: str = ""
    department: tuple[str, ...] = ()
    labelled: str = ""
    pool: bool = False
    sites: bool = False


# The rules of families.
RULES = {name: Rule("any") for name in (
    "amazon_jobs_korea_tech", "lg_ai_research_public_api_tech", "hyundai_mobis_html_tech", "kia_enterprise_json_tech", "jibe_api_korea_tech", "lablup_next_data_tech", "liner_next_data_tech", "atlassian_public_jobs_korea_tech", "breezy_public_html_korea_tech", "sap_public_jobs_korea_tech",
    "google_careers_korea_tech", "synopsys_talentbrew_korea_tech",
)} | {name: Rule("home") for name in ("ashby_public_api_korea_tech", "greeting_korea_tech", "lever_greenhouse_korea_tech", "channel_next_data_tech")} | {
    "skcareers_ax_tech": Rule("texts"),
    "kt_core_enterprise_json_tech": Rule("detail", begins="[kt]"),
    "kt_cloud_enterprise_json_tech": Rule("detail", begins="[kt cloud]", sites=True),
    "skcareers_intellix_tech": Rule("texts", ends=(" it/it",)),
    "skcareers_keyfoundry_tech": Rule("texts", ends=(" dt", " 정보보안")),
    "lg_careers_lguplus_tech": Rule("title", lacks="전기/기계 엔지니어"),
    "workday_public_api_korea_tech": Rule("home_or_url"),
    "naver_company_json_tech": Rule("any", labelled="tech", pool=True),
    "naver_webtoon_json_tech": Rule("any", labelled="tech", pool=True),
    "microsoft_pcsx_korea_tech": Rule("any", department=MICROSOFT),
    "qualcomm_pcsx_korea_tech": Rule("any", department=QUALCOMM),
}


def facts() -> dict[str, Column]:
    """What the rules ask of an opening."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("description_text", F.lit(""))
    both, compact = F.lower(F.concat_ws(" ", title, text)), F.regexp_replace(F.lower(title), r"(?U)\s+", "")
    return {
        "_title": roles.technical(title),
        "_texts": roles.technical(title, roles.TECHNICAL, roles.BLOCKED, text),
        "_detail": roles.technical_in_detail(title, text, signals=roles.IN_DETAIL),
        "_home": roles.technical_at_home(title, F.col("location")),
        "_home_or_url": roles.technical_at_home(title, F.concat_ws(" ", F.coalesce("location", F.lit("")), F.coalesce("url", F.lit("")))),
        "_any": F.lit(True),
        "_low": F.lower(title),
        "_body": F.lower(text),
        "_site": contains_any(both, SITES) & ~contains_any(both, SOFTWARE),
        "_pool": contains_any(compact, ("인재pool", "talentpool")),
    }


def holds(rule: Rule) -> Column:
    """A rule over an opening's facts."""
    ok, body = F.col(f"_{rule.role}"), F.col("_body")
    if rule.begins:
        ok = F.startswith(F.ltrim("_low"), F.lit(rule.begins)) & ok
    if rule.ends:
        ends = F.lit(False)
        for e in rule.ends:
            ends = ends | F.endswith(body, F.lit(e))
        ok = ends & ok
    if rule.lacks:
        ok = ok & ~F.contains(F.coalesce("title", F.lit("")), F.lit(rule.lacks))
    if rule.department:
        ok = ok & F.trim(body).isin(*rule.department)
    if rule.labelled:
        ok = ok & (F.regexp_extract(body, r"(?U)^\s*(\S+)", 1) == rule.labelled)
    if rule.pool:
        ok = ok & ~F.col("_pool")
    if rule.sites:
        ok = ok & ~F.col("_site")
    return ok


def kept(openings: DataFrame, family: str = "family", technical_only: str = "targets_technical_roles") -> DataFrame:
    """Openings (title, description_text, location, url, and their source's family and aim) that count."""
    groups: dict[Rule, list[str]] = {}
    for name, rule in RULES.items():
        groups.setdefault(rule, []).append(name)
    counts = F.when(~F.coalesce(technical_only, F.lit(False)), F.lit(True))
    for rule, names in groups.items():
        counts = counts.when(F.col(family).isin(*names), holds(rule))
    known = held(openings, **facts())  # behind a generator, or the filter would be pushed down and every fact repeated in every rule
    return known.filter(counts.otherwise(holds(Rule()))).select(*openings.columns)
