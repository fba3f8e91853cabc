"""Text expressions; white space and words are Unicode (`(?U)`), as Hangul is no word character otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once a row: without the generator between them the optimizer would put an expression into lambdas, once an element."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clipped(c: Column, size: int = 120) -> Column:
    """Collapsed text of at most ``size`` characters, the last one an ellipsis if it was cut."""
    text = collapsed(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 1), F.lit("…")))


def unescaped(c: Column) -> Column:
    """The five character references of XML as characters."""
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def folded(c: Column) -> Column:
    return F.lower(F.trim(c))


def joined(*cols: Column) -> Column:
    """Non-empty values, separated by a space, folded."""
    return folded(F.concat_ws(" ", *(F.when(c != "", c) for c in cols)))


def contained(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur in a folded text, in their given order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)) if terms else F.array().cast("array<string>")


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def words(text: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct words of two characters or more, in order, without stop words."""
    found = F.filter(F.array_distinct(F.split(F.lower(text), r"(?U)[^\w+#.]+")), lambda w: F.length(w) >= 2)
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def heading(c: Column) -> Column:
    """A heading without number signs, brackets and edge punctuation, in lower case."""
    plain = F.regexp_replace(F.lower(collapsed(c)), r"^#+\s*", "")
    plain = F.regexp_replace(plain, r"^[\[\]【】(){}]+|[\[\]【】(){}]+$", "")
    return collapsed(F.regexp_replace(plain, r"(?U)^[^\w]+|[^\w]+$", ""))


# Place names of postings and the region each belongs to.
LOCATIONS = {
    "서울": "seoul",
    "seoul": "seoul",
    "경기": "gyeonggi",
    "성남": "gyeonggi",
    "분당": "gyeonggi",
    "판교": "gyeonggi",
    "수원": "gyeonggi",
    "gyeonggi": "gyeonggi",
    "인천": "incheon",
    "incheon": "incheon",
    "부산": "busan",
    "busan": "busan",
    "대전": "daejeon",
    "daejeon": "daejeon",
    "원격": "remote",
    "재택": "remote",
    "remote": "remote",
}


def location_keys(c: Column) -> Column:
    """Regions a place text names; failing that, the text without spaces; empty text has none."""
    text = folded(F.coalesce(c, F.lit("")))
    known = F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in LOCATIONS.items()))))
    other = F.when(text != "", F.array(F.regexp_replace(text, SPACES, ""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(known) > 0, known).otherwise(other)


def career_words(c: Column) -> Column:
    """Career type from the words for newcomer and experienced."""
    new, old = F.contains(c, F.lit("신입")), F.contains(c, F.lit("경력"))
    return F.when(new & old, "mixed").when(new, "new_comer").when(old, "experienced")


def relevance(text: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 contained, null otherwise."""
    t, q = folded(text), query.strip().lower()
    return F.when(t == q, 0).when(F.startswith(t, F.lit(q)), 1).when(F.contains(t, F.lit(q)), 2)


def query_key(c: Column) -> Column:
    """A saved search's text: trimmed, collapsed, at most 200 characters, in lower case."""
    return F.lower(F.substring(collapsed(c), 1, 200))


def tags_valid(tags: Column) -> Column:
    """At most 4 tags, each trimmed and of 1 to 40 characters without control characters, distinct without regard to case."""
    fine = F.forall(tags, lambda t: t.isNotNull() & (F.trim(t) == t) & F.length(t).between(1, 40) & ~t.rlike(r"\p{Cntrl}"))
    lower = F.transform(tags, lambda t: F.lower(t))
    return F.coalesce((F.size(tags) <= 4) & fine & (F.size(F.array_distinct(lower)) == F.size(tags)), F.lit(False))


def slugs(values: Column, limit: int) -> Column:
    """Distinct well-formed slugs, the first ``limit``."""
    clean = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.slice(F.array_distinct(F.filter(clean, lambda v: v.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"))), 1, limit)


def character_sum(c: Column, modulus: int) -> Column:
    """Sum of the code points of a text, modulo."""
    return F.aggregate(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x)), F.lit(0), lambda a, x: a + x) % modulus
