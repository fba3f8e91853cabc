"""Technical roles by words of title, description and place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import contained, contains_any, folded

# Words of technical roles, of roles that aren't, further words that count in a description, places at home, and how a title says so.
TECHNICAL = (
    "ai ", "android", "applied scientist", "architect", "azure cloud", "backend", "cloud architect", "compiler", "data analysis", "data analyst", "data architect", "data engineer", "data science", "data scientist", "database", "dba", "developer", "development", "devops",
    "engineer", "engineering", "frontend", "infrastructure", "it infra", "ios", "k8s", "machine learning", "member of technical staff", "mlops", "platform", "programmer", "qa", "research scientist", "rpa", "security", "server", "site reliability", "software",
    "solution architect", "soc design", "개발", "개발자", "데이터 분석", "데이터과학", "데이터 사이언", "데이터 엔지니어", "데이터엔지니어", "데이터베이스", "보안", "모의해킹", "소프트웨어", "프로그래머", "엔지니어", "인프라", "서버 개발", "시스템 개발", "취약점", "앱 개발", "웹 개발", "s/w",
)
BLOCKED = (
    "account executive", "artist", "business development", "business developer", "civil engineer", "counsel", "customer service", "clinical research", "compliance manager", "coordinator", "data assistant", "facilities", "facility", "field application engineer", "hvac", "icqa",
    "lawyer", "legal", "loss prevention", "marketing", "medical device qa", "mechanical engineer", "product manager", "product owner", "product yield", "program manager", "project manager", " pm", "sales", "safety manager", "business strategy", "strategy developer", "tech bd",
    "associate problem solver", "냉난방", "노무", "마케팅", "변호사", "사업법", "사업개발", "상담 품질", "세일즈", "시설", "영업", "경영전략", "커피챗", "기획", "운영 개선", "공조", "과제책임자", "프로젝트 매니저", "의료기기 qa", "임상연구",
)
IN_DETAIL = TECHNICAL + ("aws", "cloud", "gcp", "java", "javascript", "kafka", "kubernetes", "python", "pytorch", "react", "spring", "sql", "terraform", "typescript", "데이터 파이프라인", "분산 처리")
DOMESTIC = ("gyeonggi", "korea", "pangyo", "seoul", "대한민국", "서울", "성남", "판교")
DOMESTIC_TITLES = ("[kr]", "(kr)", "kr ")


def said(*texts: Column) -> Column:
    """Texts in one, small letters, without null ones."""
    return F.lower(F.concat_ws(" ", *(F.when(t != "", t) for t in texts)))


def technical(text: Column, markers=TECHNICAL, blocked=BLOCKED, *more: Column) -> Column:
    """A marker and no blocked word in the texts."""
    t = said(text, *more)
    return contains_any(t, markers) & ~contains_any(t, blocked)


def technical_in_detail(title: Column, description: Column, markers=TECHNICAL, blocked=BLOCKED, signals=None) -> Column:
    """By title; else, if the title holds no blocked word, by two different signals (the markers, if none are named) in the description."""
    d = F.lower(F.coalesce(description, F.lit("")))
    return technical(title, markers, blocked) | (~contains_any(said(title), blocked) & (F.size(contained(d, signals or markers)) >= 2))


def technical_at_home(title: Column, location: Column, markers=TECHNICAL, blocked=BLOCKED, home=DOMESTIC, titles=DOMESTIC_TITLES) -> Column:
    """Technical, and a place at home or a title that begins by saying so."""
    begins, t = F.lit(False), folded(F.coalesce(title, F.lit("")))
    for prefix in titles:
        begins = begins | F.startswith(t, F.lit(prefix))
    return (contains_any(F.lower(F.coalesce(location, F.lit(""))), home) | begins) & technical(title, markers, blocked)
