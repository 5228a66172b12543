"""Ingest: gating and staleness of sources, seen keys, skip reasons, uniqueness of urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(batch: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key isn't known yet."""
    return batch.join(known.select(*key), key, "left_anti")


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Sources that may be scraped: not stopped any more, and active or past their cooldown."""
    stopped = F.coalesce(F.col("stop_until") > now, F.lit(False))
    resting = F.coalesce(F.col("inactive"), F.lit(False)) & ~F.coalesce(F.col("inactive_until") <= now, F.lit(False))
    return sources.where(~stopped & ~resting)


def stale(sources: DataFrame, now: Column, max_empty: int = 5, max_days: int = 30) -> DataFrame:
    """Sources to disable, with the reason."""
    why = F.when(F.coalesce("empty_runs", F.lit(0)) >= max_empty, "empty_runs").when(F.col("last_scraped_at").isNull(), "never_scraped").when(F.col("last_scraped_at") < now - F.expr(f"INTERVAL {max_days} DAYS"), "stale")
    return sources.withColumn("reason", why).where("reason is not null")


def least_recently_used(df: DataFrame, n: int, used: str, row_id: str) -> DataFrame:
    """The ``n`` rows that were used longest ago, never used ones first."""
    return df.orderBy(F.asc_nulls_first(used), row_id).limit(n)


def repeated(df: DataFrame, key: Column) -> DataFrame:
    """(key, n): keys that more than one row has."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def needs_backfill(published: Column, created: Column) -> Column:
    """A publish date that is missing or within 5 seconds of the row's creation."""
    return published.isNull() | (F.abs(F.unix_millis(published) - F.unix_millis(created)) <= 5000)


def counts_by_reason(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def cursor(df: DataFrame, source: str, message: str, floor: DataFrame | None = None) -> DataFrame:
    """(source, last_message_id): the greatest message id of each source, never under its stored floor."""
    got = df.groupBy(source).agg(F.max(message).alias("last_message_id"))
    if floor is None:
        return got
    stored = floor.select(source, F.col("last_message_id").alias("_floor"))
    return got.join(stored, source, "full").select(source, F.greatest("last_message_id", "_floor").alias("last_message_id"))


def backfill(jobs: DataFrame, dates: DataFrame, key: str, column: str = "published_at") -> DataFrame:
    """``jobs`` with ``column`` from ``dates`` (key, column) where they lack it; of repeated keys the earliest date."""
    known = dates.groupBy(key).agg(F.min(column).alias("_date"))
    return jobs.join(known, key, "left").withColumn(column, F.coalesce(column, "_date")).drop("_date").select(jobs.columns)


def enrich(listing: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Listing rows with what their detail row says, where it says anything; of repeated details one counts."""
    own = [c for c in listing.columns if c != key]
    more = detail.select(key, *(F.col(c).alias(f"_{c}") for c in own if c in detail.columns)).dropDuplicates([key])
    return listing.join(more, key, "left").select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in detail.columns else F.col(c) for c in own))


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """The distinct values in the order in which they first occur."""
    return df.groupBy(value).agg(F.min(order).alias("first")).orderBy("first", value)


def any_contains(array: Column, words: list[str]) -> Column:
    """Whether an element holds one of the words, case-insensitively; no words are no condition."""
    if not words:
        return F.lit(True)
    pattern = "|".join(f"\\Q{w.lower()}\\E" for w in words)
    return F.coalesce(F.exists(array, lambda x: F.rlike(F.lower(x), F.lit(pattern))), F.lit(False))


def filtered(jobs: DataFrame, tags: list[str] = (), location: str = "", company: str = "", search: str = "", remote_only: bool = False, limit: int | None = None) -> DataFrame:
    """A feed's own filters on mapped rows: substrings of tags, location, company and of title or description; a limit of the feed's."""
    hold = lambda c, w: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(w.lower())), F.lit(False))
    out = jobs.where(any_contains(F.split(F.coalesce("tags", F.lit("")), ", "), list(tags)))
    if location:
        out = out.where(hold("location", location))
    if company:
        out = out.where(hold("company", company))
    if search:
        out = out.where(hold("title", search) | hold("description", search))
    if remote_only:
        out = out.where(hold("tags", "remote") | hold("location", "remote"))
    return out if limit is None else out.orderBy(F.desc_nulls_last("published_at"), "external_id").limit(limit)
