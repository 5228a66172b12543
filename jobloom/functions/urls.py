"""Urls as columns: normal form, host, kind of source, Telegram names, hints by host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import has


def is_rss(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(low.contains("/feed") | low.contains("/rss") | low.endswith(".xml") | low.endswith(".rss") | low.contains("rss.xml") | low.contains("feed.xml"), F.lit(False))


def normalize(url: Column) -> Column:
    """Lower case, no scheme, www, ``/s/`` of t.me or trailing slashes; only a feed keeps its query apart while the rest is trimmed."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    split = is_rss(low) & low.contains("?")
    path = F.when(split, F.substring_index(low, "?", 1)).otherwise(low)
    query = F.when(split, F.substring(low, F.instr(low, "?"), F.length(low))).otherwise("")
    for pattern, by in ((r"^https?://", ""), (r"^www\.", ""), (r"^t\.me/s/", "t.me/"), (r"/+$", "")):
        path = F.regexp_replace(path, pattern, by)
    return F.concat(path, query)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def valid_link(url: Column) -> Column:
    """The link if it is http or https, else null."""
    return F.when(has(url, r"^https?://[^\s/]"), F.trim(url))


def source_type(stated: Column, url: Column) -> Column:
    """The stated type where it names a feed, else what the url shows."""
    bare = F.regexp_replace(F.lower(url), r"^https?://", "")
    facebook, telegram = F.coalesce(has(bare, r"(^|\.)facebook\.com/"), F.lit(False)), F.coalesce(has(url, r"t\.me/"), F.lit(False))
    return F.when(stated.isin("telegram", "rss"), stated).when((stated == "facebook") | facebook, "facebook").when(telegram, "telegram").when(is_rss(url), "rss").otherwise(F.coalesce(F.nullif(stated, F.lit("")), F.lit("site")))


def telegram_slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)t\.me/(?:s/)?([A-Za-z0-9_]+)", 1), F.lit(""))


def telegram_message(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)t\.me/(?:s/)?[A-Za-z0-9_]+/(\d+)", 1), F.lit("")).cast("bigint")


def trim_end(url: Column) -> Column:
    """Without punctuation that follows a url in prose."""
    return F.regexp_replace(url, r"[),.;:\]]+$", "")


#: (ending of the host, country, currency), the first that fits (fixed values).
HINTS = [(".uk", "GB", "GBP"), (".gr", "GR", "EUR"), (".cy", "CY", "EUR"), (".de", None, "EUR"), (".fr", None, "EUR"), (".nl", None, "EUR"), (".es", None, "EUR"), (".it", None, "EUR"), (".ch", "CH", "CHF"), (".se", "SE", "SEK"), (".no", "NO", "NOK"), (".dk", "DK", "DKK"), (".pl", None, "PLN"), (".com", None, "USD")]


def hints(url: Column) -> Column:
    """struct<country, currency> by the end of the host."""
    h, country, currency = host(url), F.lit(None).cast("string"), F.lit(None).cast("string")
    for end, c, money in reversed(HINTS):
        country, currency = F.when(h.endswith(end), F.lit(c).cast("string")).otherwise(country), F.when(h.endswith(end), money).otherwise(currency)
    return F.struct(country.alias("country"), currency.alias("currency"))
