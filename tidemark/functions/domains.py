"""The fields of work that postings and profiles are sorted into."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Domain:
    id: str
    label: str
    title_terms: tuple[str, ...]
    responsibility_terms: tuple[str, ...]
    strong_skills: tuple[str, ...]
    supporting_skills: tuple[str, ...]
    work_types: tuple[str, ...] = ()


# Per field its label, terms of titles and duties, skills that mark it and skills that support it, kinds of work.
DOMAINS = (
    Domain("backend", "백엔드", ("backend", "back-end", "백엔드", "서버 개발", "server engineer"), ("api 개발", "서버 개발", "분산 시스템", "결제 api", "백엔드 서비스"), ("spring", "spring boot", "django", "fastapi", "nestjs", "kafka", "redis"), ("java", "kotlin", "go", "python", "node.js", "postgresql", "mysql"), ("development", "operations", "automation")),
    Domain("frontend", "프론트엔드", ("frontend", "front-end", "프론트엔드", "web frontend"), ("웹 화면", "사용자 인터페이스", "웹 프론트", "디자인 시스템", "브라우저"), ("react", "vue", "angular", "next.js", "svelte"), ("typescript", "javascript", "html", "css"), ("development",)),
    Domain("mobile", "모바일", ("mobile", "모바일", "android", "ios", "앱 개발"), ("모바일 앱", "안드로이드", "아이폰 앱", "앱 서비스"), ("swift", "swiftui", "kotlin", "flutter", "react native"), ("java", "typescript", "dart"), ("development",)),
    Domain("data", "데이터", ("data engineer", "data analyst", "analytics engineer", "데이터 엔지니어", "데이터 분석"), ("데이터 파이프라인", "데이터 웨어하우스", "etl", "지표 분석", "데이터 모델링"), ("airflow", "spark", "flink", "bigquery", "snowflake", "dbt"), ("sql", "python", "kafka", "pandas"), ("development", "analysis", "automation")),
    Domain("ai", "AI", ("ai engineer", "machine learning", "ml engineer", "인공지능", "머신러닝", "llm engineer"), ("모델 학습", "모델 추론", "llm", "rag", "생성형 ai", "머신러닝 모델"), ("pytorch", "tensorflow", "hugging face", "vllm", "langchain"), ("python", "numpy", "pandas", "cuda"), ("development", "analysis")),
    Domain("mlops", "MLOps", ("mlops", "machine learning platform", "ai platform", "머신러닝 플랫폼"), ("모델 배포", "학습 파이프라인", "모델 서빙", "모델 모니터링", "ai 인프라"), ("mlflow", "kubeflow", "vllm", "ray"), ("python", "kubernetes", "docker", "airflow", "prometheus"), ("development", "operations", "automation", "analysis")),
    Domain("devops", "DevOps·플랫폼", ("devops", "sre", "platform engineer", "플랫폼 엔지니어", "site reliability"), ("배포 자동화", "ci/cd", "장애 대응", "플랫폼 운영", "관측성", "인프라 자동화"), ("kubernetes", "terraform", "ansible", "helm", "prometheus", "grafana"), ("docker", "linux", "aws", "gcp", "azure", "python", "go"), ("operations", "automation", "development")),
    Domain("cloud", "클라우드", ("cloud engineer", "cloud architect", "클라우드 엔지니어", "클라우드 아키텍트"), ("클라우드 인프라", "클라우드 전환", "클라우드 아키텍처", "멀티 클라우드"), ("aws", "gcp", "azure", "terraform", "cloudformation"), ("kubernetes", "docker", "linux", "python", "go"), ("operations", "automation", "development", "planning")),
    Domain("security", "보안", ("security engineer", "security analyst", "보안 엔지니어", "보안 분석", "information security"), ("침해 탐지", "보안 사고", "취약점", "보안 정책", "위협 분석", "보안 관제", "보안 자동화"), ("siem", "splunk", "wazuh", "burp suite", "nmap"), ("linux", "python", "aws", "kubernetes", "network"), ("operations", "analysis", "automation", "development")),
    Domain("embedded", "임베디드", ("embedded", "firmware", "임베디드", "펌웨어"), ("펌웨어 개발", "디바이스 드라이버", "실시간 운영체제", "하드웨어 제어"), ("rtos", "embedded linux", "autosar", "can"), ("c", "c++", "linux", "cmake"), ("development", "operations")),
    Domain("automotive", "자동차 소프트웨어", ("automotive", "vehicle software", "자동차 소프트웨어", "차량 소프트웨어"), ("차량 제어", "차량용", "전장", "adas", "인포테인먼트"), ("autosar", "can", "matlab", "simulink"), ("c", "c++", "python", "linux"), ("development", "analysis")),
    Domain("robotics", "로보틱스", ("robotics", "robot engineer", "로봇", "로보틱스"), ("로봇 제어", "모션 플래닝", "slam", "센서 융합", "로봇 플랫폼"), ("ros", "ros2", "moveit", "gazebo"), ("c++", "python", "linux", "opencv"), ("development", "analysis", "operations")),
    Domain("qa", "QA·테스트 자동화", ("qa engineer", "test engineer", "sdet", "품질 엔지니어", "테스트 엔지니어"), ("테스트 자동화", "품질 보증", "테스트 시나리오", "회귀 테스트"), ("selenium", "playwright", "cypress", "appium"), ("python", "javascript", "typescript", "pytest"), ("development", "automation", "analysis")),
    Domain("product", "프로덕트", ("product manager", "product owner", "프로덕트 매니저", "서비스 기획"), ("제품 전략", "서비스 기획", "요구사항 정의", "제품 지표", "로드맵"), ("figma", "amplitude", "mixpanel"), ("sql", "jira"), ("planning", "analysis", "leadership")),
    Domain("game", "게임 개발", ("game developer", "game programmer", "게임 개발", "게임 프로그래머"), ("게임 클라이언트", "게임 서버", "게임플레이", "게임 엔진"), ("unity", "unreal engine", "godot"), ("c#", "c++", "python"), ("development",)),
)
# Names of kinds of work.
WORK_TYPES = {"development": "개발", "operations": "운영", "analysis": "분석", "automation": "자동화", "planning": "기획", "leadership": "리더십"}
