"""Hashes, keys and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def payload_hash(*cols: str) -> Column:
    """Hash of a row's fields as JSON in name order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def url_id(url: Column) -> Column:
    """An id for a posting that has none: 32 hexadecimal digits of its address's hash."""
    return F.substring(F.sha2(url, 256), 1, 32)


def blob_key(digest: Column, suffix: str = ".html") -> Column:
    """Place of a raw page in a content-addressed store."""
    return F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(suffix))


def company_key(slug: Column, name: Column) -> Column:
    return F.coalesce(F.when(slug != "", slug), F.lower(F.trim(name)))


def crawl_group(provider: Column, url: Column, source_id: Column, suffixes: list[str]) -> Column:
    """What must not be fetched side by side: the provider, a shared host suffix, the host, or the source itself."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    by_suffix = F.coalesce(*(F.when(F.endswith(host, F.lit(s)), F.lit(s)) for s in suffixes)) if suffixes else F.lit(None).cast("string")
    return F.coalesce(F.when(provider != "", provider), by_suffix, host, source_id.cast("string"))


def retry_delay(status: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next try: a throttled request waits what it is told (0 to 60) or 10 per attempt; others double up to 8."""
    told = F.greatest(F.lit(0.0), F.least(retry_after.cast("double"), F.lit(60.0)))
    throttled = F.greatest(F.coalesce(told, F.lit(0.0)), F.least(attempt * 10.0, F.lit(60.0)))
    return F.when(status == 429, throttled).otherwise(F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(8.0)))


def priority_score(brand: Column, tech: Column, volume: Column, reuse: Column, risk: Column, noise: Column) -> Column:
    plus = [F.coalesce(c, F.lit(0)) for c in (brand, tech, volume, reuse)]
    return plus[0] + plus[1] + plus[2] + plus[3] - F.coalesce(risk, F.lit(0)) - F.coalesce(noise, F.lit(0))
