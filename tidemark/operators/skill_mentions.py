"""Skill mentions of postings: blocks with a requirement, spellings found by one automaton, scores, the best mention a skill.

Blocks come from column expressions over a posting's lines (a page is first
walked to headings, items and paragraphs); nothing is shuffled for them.  One
Aho-Corasick automaton holds every spelling and every word that vouches for
one, so a block is read once whatever the dictionary's size.  What it finds is
tested as intervals: the characters on both sides, and the spans that a name
must not lie in.  Scores are column expressions again, and the best mention per
posting and skill is a maximum.

A null title, page or text has no blocks; postings without blocks give no rows;
rows with one key are one posting.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.functions.skills import CONFIRMED, DICTIONARY, Skill, clean
from tidemark.functions.text import held
from tidemark.operators.evidence import requirement_rank
from tidemark.sources import markup

# Phrases of headings that open required, preferred and technical sections, and plain headings that end one.
REQUIRED = (
    "minimum qualifications", "basic qualifications", "required qualifications", "requirements", "qualifications", "자격 요건", "자격요건", "필수 자격 요건", "필수자격요건", "지원 자격", "지원자격", "이런 분을 찾고 있어요", "이런 분들을 찾고 있어요",
    "이런 분과 함께하고 싶어요", "이런 분과 함께 하고 싶어요", "함께하기 위해 필요한 기본 요건이에요", "이런 기술이 필요해요", "어떤 경력과 역량이 필요한가요",
)
PREFERRED = (
    "우대 사항", "우대사항", "일반 우대사항", "이런 분이면 더 좋아요", "이런 분이라면 더 좋아요", "이런 점이 있으면 더 좋아요", "preferred", "preferred qualifications", "preferred experience", "nice to have", "nice to haves", "bonus qualifications", "what will help you succeed",
)
TECHNICAL = ("사용중인 기술", "사용 중인 기술", "이런 기술들을 사용하고 있어요", "이런 기술을 활용해요", "기술 스택", "tech stack")
RESET = ("responsibilities", "key responsibilities", "what you will do", "what you'll do", "주요 업무", "담당 업무", "복리 후생", "benefits", "about the role", "about us")
#: A required heading that also opens a technical section.
WANTED_SKILLS = "이런 기술이 필요해요"
# What a block says about itself, signs of a list, the characters of names, a name beside another, companions of R.
SAYS_PREFERRED = r"(?i)(우대|선호|있으면\s+(?:더\s+)?좋|\bpreferred\b|\bnice[- ]to[- ]have\b|\ba plus\b)"
SAYS_REQUIRED = r"(?i)(필수|반드시|\brequired\b|\bmust\b)"
SEPARATES = r"(?i)[,/]|(?:^|\s)(?:및|와|과|또는|or|and)(?:\s|$)"
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+#.")
C_BESIDE_CPP = r"(?<![A-Za-z0-9_+#.])C\s*/\s*C\+\+"
DATA_LANGUAGES = ("Python", "SQL")
# Confidence by reason.
CONFIDENCE = {
    "distinct_alias": 1.0, "strict_compound_alias": 0.95, "strict_data_language_list": 0.95, "strict_alias_with_context": 0.95, "contextual_alias_with_terms": 0.95, "strict_alias_with_section": 0.85, "contextual_alias_with_section": 0.85,
    "ambiguous_alias_candidate": 0.5,
}
#: Longest leaf of a page, and longest line of a text, that can be a heading.
PAGE_HEADING, LINE_HEADING = 80, 100


def any_of(phrases: Sequence[str]) -> str:
    return "|".join(re.escape(p) for p in phrases)


# Blocks ----------------------------------------------------------------------


def leaves(page: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a page's elements as they close: heading, item, label (a short leaf that may head a section), text."""
    open_: list[dict] = []
    for event, value, _ in markup.events(page):
        if event == "text":
            for e in open_:
                e["text"].append(value)
            if not open_ and value.strip():
                yield "text", clean(value)
        elif event == "open" and value not in markup.VOID:
            if value in ("div", "p", "li", "ul", "ol", "table", "section", "article"):
                for e in open_:
                    e["leaf"] = False
            open_.append({"tag": value, "text": [], "leaf": True})
        elif event == "close" and any(e["tag"] == value for e in open_):
            closed = None
            while closed != value:
                e = open_.pop()
                closed, said, around = e["tag"], clean(" ".join(e["text"])), {o["tag"] for o in open_}
                headed = bool(around & markup.HEADINGS)
                kinds = {"li": "item", "strong": "label" if e["leaf"] and not headed else None, "p": "text" if e["leaf"] and "li" not in around else "label" if e["leaf"] else None}
                kind = "heading" if closed in markup.HEADINGS else kinds.get({"b": "strong", "div": "p"}.get(closed, closed))
                if said and kind and (kind != "label" or len(said) <= PAGE_HEADING):
                    yield kind, said


@F.pandas_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("text", T.StringType())))
def page_leaves(page: pd.Series) -> pd.Series:
    return pd.Series([list(leaves(p)) if p else [] for p in page])


def lines(text: Column) -> Column:
    """Lines and sentences of a text, collapsed, without empty ones."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)\n+|(?<=[.!?。])\s+")
    return F.transform(F.filter(F.transform(parts, tx.collapsed), lambda p: p != ""), lambda p: F.struct(F.lit("line").alias("kind"), p.alias("text")))


def blocks(postings: DataFrame, key: str, title: str | None, page: str | None, text: str | None) -> DataFrame:
    """A row per block: key, position, text, requirement_type, technical, list_item.

    The title is the first block; a page's blocks follow or, where it has none,
    those of the text.  A unit that reads as a heading opens a section, which
    lasts to the next heading; a block's own words outrank its section.
    """
    unit = "array<struct<kind:string,text:string>>"
    df = postings.select(F.col(key), *(F.col(c).alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in ((title, "_title"), (text, "_text"))), *([page_leaves(page).alias("_page")] if page else []))

    def sections(units: Column) -> Column:
        def short(u):
            return (u["kind"] == "heading") | ((u["kind"] != "item") & (F.length(u["text"]) <= F.when(u["kind"] == "line", LINE_HEADING).otherwise(PAGE_HEADING)))

        def edged(text):
            return F.substring(text, 1, 20).rlike(r"(?U)^\W{20}") | F.substring(text, -20, 20).rlike(r"(?U)^\W{20}")

        def opened(u):
            h = u["h"]
            opens = F.when(u["short"], F.when(h.rlike(any_of(PREFERRED)), "preferred").when(h.rlike(any_of(REQUIRED)), "required").when(h.rlike(any_of(TECHNICAL)), "technical"))
            ends = (u["kind"] == "heading") | ((u["kind"] == "line") & h.isin(*RESET))
            return F.struct(u["kind"].alias("kind"), u["text"].alias("text"), opens.alias("opens"), ends.alias("ends"), h.contains(WANTED_SKILLS).alias("wants"))

        # A lambda's value is computed once, an expression in it as often as it is named: hence a step for each.
        # Only what is short can be a heading, or a line that is long by its edges alone: the phrases that end a section
        # are much shorter, so twenty characters and more were stripped at an end.
        said = F.transform(units, lambda u: F.struct(u["kind"].alias("kind"), u["text"].alias("text"), short(u).alias("short"), F.when(short(u) | ((u["kind"] == "line") & edged(u["text"])), tx.heading(u["text"])).alias("h")))
        made = F.transform(said, opened)
        return F.transform(made, lambda u: F.struct(u["kind"].alias("kind"), u["text"].alias("text"), u["opens"].alias("opens"), (u["opens"].isNotNull() | F.coalesce(u["ends"], F.lit(False))).alias("heads"), (u["wants"] & (u["opens"] == "required")).alias("wanted")))

    def body(df: DataFrame, units: Column, name: str) -> DataFrame:
        df = held(df, _units=sections(units))
        none = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("opens"), F.lit(False).alias("wanted")))
        heads = F.filter(F.transform("_units", lambda u, i: F.struct(i.alias("at"), u["opens"].alias("opens"), u["wanted"].alias("wanted"), u["heads"].alias("heads"))), lambda h: h["heads"])
        df = held(df, _heads=F.concat(none, F.transform(heads, lambda h: F.struct(h["at"].alias("at"), h["opens"].alias("opens"), h["wanted"].alias("wanted")))))

        def section(above, n):
            """The blocks below a heading, to the next one: each unit is looked at once, however many headings there are."""
            end = F.coalesce(F.try_element_at(F.col("_heads.at"), n + 2), F.size("_units"))
            inherited = F.when(above["opens"].isin("required", "preferred"), above["opens"]).otherwise("unspecified")
            technical = F.coalesce((above["opens"] == "technical") | above["wanted"], F.lit(False))

            def block(u):
                own = F.when(u["text"].rlike(SAYS_PREFERRED), "preferred").when(u["text"].rlike(SAYS_REQUIRED), "required").otherwise(inherited)
                return F.struct(u["text"].alias("text"), own.alias("requirement_type"), technical.alias("technical"), (u["kind"] == "item").alias("list_item"), F.lit(False).alias("skip"))

            below = F.slice(F.col("_units"), above["at"] + 2, end - above["at"] - 1)
            return F.transform(F.filter(below, lambda u: u["kind"] != "label"), block)

        return held(df, **{name: F.flatten(F.transform("_heads", section))}).drop("_units", "_heads")

    if page:
        df = body(df, F.col("_page").cast(unit), "_body")
        df = body(df, F.when(F.size("_body") == 0, lines(F.col("_text"))).otherwise(F.array().cast(unit)), "_plain")
        found = F.concat("_body", "_plain")
    else:
        df = body(df, lines(F.col("_text")), "_body")
        found = F.col("_body")
    named = tx.collapsed(F.coalesce("_title", F.lit("")))
    head = F.array(F.struct(named.alias("text"), F.lit("unspecified").alias("requirement_type"), F.lit(False).alias("technical"), F.lit(False).alias("list_item"), F.lit(False).alias("skip")))
    return df.select(key, F.posexplode(F.concat(F.filter(head, lambda b: b["text"] != ""), found)).alias("position", "b")).select(key, "position", "b.text", "b.requirement_type", "b.technical", "b.list_item")


# Spellings -------------------------------------------------------------------


class Spellings:
    """The automaton of a dictionary: every spelling, with what it is a spelling of, and every word that vouches."""

    def __init__(self, dictionary: Sequence[Skill]):
        self.aliases = [(s, a) for s in dictionary for a in s.aliases]
        self.never = [[re.compile(n, re.I) for n in a.never] for _, a in self.aliases]
        self.context = [frozenset(t.lower() for t in a.context) for _, a in self.aliases]
        entries: dict[str, list] = {}
        for n, (_, a) in enumerate(self.aliases):
            entries.setdefault(a.value.lower(), []).append((n, a.value if a.case else None, any(c.isascii() and c.isalnum() for c in a.value), False))
            for form in a.forms:
                entries.setdefault(form.lower(), []).append((n, form, True, True))
            for term in self.context[n]:
                entries.setdefault(term, [])
        self.automaton = ahocorasick.Automaton()
        for word, uses in entries.items():
            self.automaton.add_word(word, (word, uses))
        self.automaton.make_automaton()

    @staticmethod
    def bounded(text: str, start: int, end: int, whole_word: bool) -> bool:
        after = text[end : end + 1]
        return not (start and text[start - 1] in TOKEN) and not ((after.isalnum() or after == "_") if whole_word else after in TOKEN and after)

    def found(self, text: str) -> list[tuple[int, bool]]:
        """Aliases of a text by number, and whether a word of the text vouches for them."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose small form is longer stays as it is, so that places agree
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        spans: dict[int, list[tuple[int, int]]] = {}
        said = set()
        for last, (word, uses) in self.automaton.iter(low):
            said.add(word)
            start, end = last + 1 - len(word), last + 1
            for n, written, token, whole_word in uses:
                if (written is None or text[start:end] == written) and (not token or self.bounded(text, start, end, whole_word)):
                    spans.setdefault(n, []).append((start, end))
        out = []
        for n in sorted(spans):
            barred = [m.span() for never in self.never[n] for m in never.finditer(text)]
            if any(all(end <= x or y <= start for x, y in barred) for start, end in spans[n]):
                out.append((n, not said.isdisjoint(self.context[n])))
        return out


@functools.cache
def spellings(dictionary: tuple[Skill, ...]) -> Spellings:
    return Spellings(dictionary)


def mentions(found: DataFrame, dictionary: Sequence[Skill] = DICTIONARY) -> DataFrame:
    """Blocks as (blocks' columns, distinct, skill, category, policy, alias, vouched): a row per block and alias in it; ``distinct`` are the block's skills that are sure by their name."""
    dictionary = tuple(dictionary)
    schema = found.schema.simpleString()[7:-1] + ",distinct:array<string>,skill:string,category:string,policy:string,alias:int,vouched:boolean"

    def run(batches):
        known = spellings(dictionary)
        for b in batches:
            rows, sure, hits = [], [], []
            for i, t in enumerate(b["text"].to_pylist()):
                got = known.found(t)
                if got:
                    names = sorted({known.aliases[n][0].name for n, _ in got if known.aliases[n][1].policy == "distinct"})
                    rows += [i] * len(got)
                    sure += [names] * len(got)
                    hits += got
            of = [known.aliases[n] for n, _ in hits]
            more = [pa.array(sure, pa.list_(pa.string())), *(pa.array(c, pa.string()) for c in ([s.name for s, _ in of], [s.category for s, _ in of], [a.policy for _, a in of])), pa.array([n for n, _ in hits], pa.int32()), pa.array([v for _, v in hits], pa.bool_())]
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*b.schema.names, "distinct", "skill", "category", "policy", "alias", "vouched"])

    return found.mapInArrow(run, schema)


def said_in(texts: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """(name, documents): in how many texts each name, in lower case, lies anywhere.

    One automaton of all names reads a text once; a batch hands on one row a name.
    """
    lowered = texts.filter(F.col(text).isNotNull()).select(F.lower(text).alias("t"))
    names = sorted(set(names))

    def run(batches):
        known = ahocorasick.Automaton()
        for n in names:
            known.add_word(n, n)
        known.make_automaton()
        for b in batches:
            found = Counter(n for t in b["t"].to_pylist() for n in {n for _, n in known.iter(t)})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["name", "documents"])

    return lowered.mapInArrow(run, "name string, documents long").groupBy("name").agg(F.sum("documents").alias("documents"))


# Scores ----------------------------------------------------------------------


def scored(found: DataFrame) -> DataFrame:
    """Mentions with ``match_reason`` and ``confidence``.

    A distinct name needs nothing.  Others are sure beside a word that vouches
    (C also in front of C++, R also in a list with a data language), likely in a
    technical section or in a list with a sure name, and candidates otherwise.
    """
    text, policy = F.col("text"), F.col("policy")
    company = F.array_remove("distinct", F.col("skill"))
    likely = F.col("technical") | ((F.size(company) > 0) & (F.col("list_item") | text.rlike(SEPARATES)))
    beside = F.when((F.col("skill") == "C") & text.rlike(C_BESIDE_CPP), "strict_compound_alias").when((F.col("skill") == "R") & F.arrays_overlap(company, F.array(*map(F.lit, DATA_LANGUAGES))), "strict_data_language_list")
    by_word = F.when(F.col("vouched"), F.when(policy == "strict", "strict_alias_with_context").otherwise("contextual_alias_with_terms"))
    by_place = F.when(likely, F.concat(policy, F.lit("_alias_with_section")))
    reason = F.coalesce(F.when(policy == "distinct", "distinct_alias"), F.when(policy == "strict", beside), by_word, by_place, F.lit("ambiguous_alias_candidate"))
    confidence = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    return found.withColumn("match_reason", reason).withColumn("confidence", F.element_at(confidence, F.col("match_reason")))


def extract(postings: DataFrame, key: str = "posting_id", title: str | None = "title", page: str | None = "description_html", text: str | None = "description_text", dictionary: Sequence[Skill] = DICTIONARY) -> DataFrame:
    """One row per posting and skill: the best mention (confirmed, then the stronger requirement, the confidence, the earlier block), and ``confirmed``."""
    sure = F.col("confidence") >= CONFIRMED
    order = F.struct(sure.alias("c"), requirement_rank(F.col("requirement_type")).alias("r"), F.col("confidence").alias("s"), (-F.col("position")).alias("p"), (-F.col("alias")).alias("a"))
    mention = F.struct("requirement_type", F.col("text").alias("evidence_text"), "confidence", "match_reason")
    best = scored(mentions(blocks(postings, key, title, page, text), dictionary)).groupBy(key, "skill", "category").agg(F.max_by(mention, order).alias("m"))
    return best.select(key, "skill", "category", "m.*").withColumn("confirmed", sure)
