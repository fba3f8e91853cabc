"""Calendar of Asia/Seoul over timestamps in UTC (the session's time zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def local_date(ts: Column) -> Column:
    """The local day of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def local_midnight(day: Column) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def monday(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def lenient_timestamp(c: Column) -> Column:
    """An instant from the formats that job boards use; null for what is none of them.

    A text without a zone is local; epoch seconds and milliseconds are told by their length.
    """
    text = F.trim(c)
    zoned = F.try_to_timestamp(F.when(text.rlike(r"[zZ]$|[+-]\d\d:?\d\d$"), text))
    plain = F.regexp_replace(F.regexp_replace(text, r"^(\d{4})[./년]\s*(\d{1,2})[./월]\s*(\d{1,2})[.일]?", "$1-$2-$3"), r"^(\d{4})-(\d)-", "$1-0$2-")
    plain = F.regexp_replace(plain, r"^(\d{4}-\d\d)-(\d)(?!\d)", "$1-0$2")
    local = F.to_utc_timestamp(F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyyMMdd", "yyyyMMddHHmmss"))), ZONE)
    millis = F.when(text.rlike(r"^\d{13}$"), F.timestamp_millis(text.try_cast("bigint")))
    seconds = F.when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(text.try_cast("bigint")))
    return F.coalesce(millis, seconds, zoned, local)


def freshness(last: Column, now: Column, hours: int) -> Column:
    """Whether ``last`` is no older than ``hours`` before ``now``."""
    return last >= now - F.make_interval(hours=F.lit(hours))


def relative_label(ts: Column, now: Column) -> Column:
    """minutes, hours or days since ``ts``."""
    age = F.unix_timestamp(now) - F.unix_timestamp(ts)
    unit = lambda n, name: F.concat(F.floor(age / n).cast("string"), F.lit(name))
    return F.when(age < 60, "now").when(age < 3600, unit(60, "m")).when(age < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))
