"""Scans that stop and repair: feeds and channel pages as they were recorded, read up to where the last run ended.

``read_feeds`` parses RSS and Atom payloads up a ladder: each repair is tried only on payloads that the one before left
unreadable, and what no parser takes is read item by item, so a malformed or cut feed keeps its items.  ``scan_feeds``
takes a feed's items in order up to the first that is known or too old; ``scan_channels`` takes a channel's messages
from the newest down, over as many pages as have something new.  ``check_feeds`` and ``check_channels`` say whether a
source can be added and why not; ``channel_profile`` reads a channel's page.

A feed's items are one bounded array of its payload's row, so nothing of a feed is shuffled; of channels, some facts of
each page meet in a window over at most ``PAGES`` pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions import text
from jobloom.functions.gate import challenge_page
from jobloom.functions.patterns import first, has, java, let, replace

#: Items of a feed and days that they may be old; pages of a channel and days of its messages; days since a channel's last message.
ITEMS, FEED_DAYS, PAGES, CHANNEL_DAYS, ALIVE_DAYS = 50, 30, 10, 14, 21
# Entities that a feed may name, with what they stand for in XML.
ENTITIES = {"amp": "&amp;", "lt": "&lt;", "gt": "&gt;", "quot": "&quot;", "apos": "&apos;", "nbsp": "&#160;", "mdash": "&#8212;", "ndash": "&#8211;", "copy": "&#169;", "reg": "&#174;"}
_RSS = "title:string,link:string,guid:string,description:string,`content:encoded`:string,pubDate:string,`dc:date`:string,category:array<string>"
_ATOM = "title:string,link:array<struct<_href:string,_rel:string>>,id:string,updated:string,published:string,summary:string,content:string,category:array<struct<_term:string>>"
FEED = f"channel struct<title:string,item:array<struct<{_RSS}>>>, item array<struct<{_RSS}>>, title string, entry array<struct<{_ATOM}>>, _corrupt string"
ITEM = "struct<title:string,link:string,guid:string,content:string,published:string,categories:array<string>>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _trimmed(x: Column) -> Column:
    return F.nullif(text.trim(x), F.lit(""))


# -- the ladder -----------------------------------------------------------------------------------------------------


def begun(payload: Column) -> Column:
    """A payload from its first mark on; empty if it has none."""
    return F.regexp_extract(payload, r"(?s)<.*", 0)


def with_entities(xml: Column) -> Column:
    """Known entities closed and in XML's terms, all other ampersands escaped."""
    out = F.regexp_replace(xml, f"&({'|'.join(ENTITIES)})(?=[^;a-zA-Z0-9#&])", "&$1;")
    for name, stands in ENTITIES.items():
        if stands != f"&{name};":
            out = F.regexp_replace(out, f"&{name};", stands)
    return F.regexp_replace(out, r"&(?!(?:amp|lt|gt|quot|apos|#\d{1,7}|#x[0-9A-Fa-f]{1,6});)", "&amp;")


#: What no parser takes outside of CDATA: comments, instructions, document types, tags that hold another's start, tags that begin with white space.
BROKEN = [r"<!--[\s\S]*?-->", r"<\?(?!xml\s)[^>]*\?>", r"<!(?i:DOCTYPE)[^>]*>", r"</?[A-Za-z][^<>]*(?=<)", r"</?\s+[A-Za-z][^<>]*>"]


def without_broken_tags(xml: Column) -> Column:
    """Without what is ``BROKEN``; marks that begin no tag are escaped.  CDATA stays as it is."""
    data = r"(<!\[CDATA\[[\s\S]*?\]\]>)"
    for broken in BROKEN:
        xml = F.regexp_replace(xml, f"{data}|{broken}", "$1")
    return F.regexp_replace(xml, r"<(?![A-Za-z/!?])", "&lt;")


def without_controls(xml: Column) -> Column:
    return F.regexp_replace(xml, r"[\x00-\x08\x0B\x0C\x0E-\x1F]|&#(?:[0-8]|1[124-9]|2\d|3[01]);", "")


def _parsed(xml: Column) -> Column:
    return F.from_xml(xml, FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def _items(p: Column) -> Column:
    """array<ITEM> of a parsed feed; null if it is none."""
    rss = lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["guid"].alias("guid"), F.coalesce(_trimmed(i["description"]), i["content:encoded"]).alias("content"), F.coalesce(i["pubDate"], i["dc:date"]).alias("published"), i["category"].alias("categories"))

    def atom(e: Column) -> Column:
        own = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        link = F.coalesce(F.get(own, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])
        return F.struct(e["title"].alias("title"), link.alias("link"), e["id"].alias("guid"), F.coalesce(_trimmed(e["content"]), e["summary"]).alias("content"), F.coalesce(e["published"], e["updated"]).alias("published"), F.transform(e["category"], lambda c: c["_term"]).alias("categories"))

    found = F.coalesce(F.transform(F.coalesce(p["channel"]["item"], p["item"]), rss).cast(f"array<{ITEM}>"), F.transform(p["entry"], atom).cast(f"array<{ITEM}>"), F.when(p["channel"].isNotNull(), F.array().cast(f"array<{ITEM}>")))
    return F.when(p["_corrupt"].isNull(), found)


def tolerant_items(payload: Column) -> Column:
    """array<ITEM> of whatever stands between item or entry tags, closed or not; null if there are none."""
    whole = F.regexp_extract_all(payload, F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>.*?(?=</(?:item|entry)>|<(?:item|entry)[\s>]|\z)"), F.lit(0))

    def inner(x: Column, tag: str) -> Column:
        raw = F.regexp_extract(x, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}\s*>|\z)", 1)
        return _trimmed(F.regexp_replace(raw, r"<!\[CDATA\[|\]\]>", ""))

    def one(x: Column) -> Column:
        each = F.transform(F.regexp_extract_all(x, F.lit(r"(?is)<category(?:\s[^>]*)?>(.*?)(?:</category\s*>|\z)"), F.lit(1)), lambda c: text.trim(F.regexp_replace(c, r"<!\[CDATA\[|\]\]>", "")))
        link = F.coalesce(inner(x, "link"), F.nullif(F.regexp_extract(x, r"(?is)<link\s[^>]*href=[\"']([^\"']*)", 1), F.lit("")))
        return F.struct(inner(x, "title").alias("title"), link.alias("link"), F.coalesce(inner(x, "guid"), inner(x, "id"), link).alias("guid"), F.coalesce(inner(x, "description"), inner(x, "content:encoded"), inner(x, "summary"), inner(x, "content")).alias("content"), F.coalesce(inner(x, "pubDate"), inner(x, "dc:date"), inner(x, "published"), inner(x, "updated")).alias("published"), F.filter(each, lambda c: c != "").alias("categories"))

    return let(whole, lambda w: F.when(F.size(w) > 0, F.transform(w, one).cast(f"array<{ITEM}>")))


def read_feeds(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with ``items`` (array, in feed order), ``repair`` and ``feed_title``.

    ``repair`` is the step that made a payload readable: none, tags, controls or items; ``no_feed`` for JSON and empty
    payloads, ``challenge`` for a page that asks for a browser, ``unreadable`` for the rest; those three have null
    items.  All other columns stay.
    """
    bare = F.trim(F.coalesce(F.col(column), F.lit("")))
    kind = F.when((bare == "") | F.rlike(bare, F.lit(r"^[{\[]")), "no_feed").when(challenge_page(F.col(column)) & ~has(F.col(column), r"<(rss|feed|rdf)[\s>:]"), "challenge")
    out = payloads.withColumn("kind", kind).withColumn("xml", F.when(kind.isNull(), with_entities(begun(F.col(column)))))
    out = out.withColumn("p0", _parsed(F.col("xml"))).withColumn("i0", _items(F.col("p0")))
    mend = F.when(F.col("i0").isNull() & F.col("kind").isNull(), without_broken_tags(F.col("xml")))
    out = out.withColumn("x1", mend).withColumn("p1", _parsed(F.col("x1"))).withColumn("i1", _items(F.col("p1")))
    out = out.withColumn("p2", _parsed(F.when(F.col("i1").isNull(), without_controls(F.col("x1"))))).withColumn("i2", _items(F.col("p2")))
    out = out.withColumn("i3", F.when(F.col("x1").isNotNull() & F.col("i1").isNull() & F.col("i2").isNull(), tolerant_items(F.col(column))))
    repair = F.coalesce("kind", *(F.when(F.col(f"i{k}").isNotNull(), name) for k, name in enumerate(("none", "tags", "controls", "items"))), F.lit("unreadable"))
    title = F.coalesce(*(F.coalesce(F.col(f"p{k}.channel.title"), F.col(f"p{k}.title")) for k in range(3)))
    return out.withColumn("items", F.coalesce("i0", "i1", "i2", "i3")).withColumn("repair", repair).withColumn("feed_title", _trimmed(title)).drop("kind", "xml", "x1", *(f"{a}{k}" for a in "pi" for k in range(3)), "i3")


# -- feeds ----------------------------------------------------------------------------------------------------------


def published(value: Column) -> Column:
    """A feed's date: RFC 822 with a zone's name or offset, or ISO 8601."""
    plain = F.regexp_replace(F.regexp_replace(text.trim(value), r"^\w{3},\s*", ""), r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm Z")), text.parse_date(value))


def absolute(link: Column, base: Column) -> Column:
    """A link, completed by its feed's address if it is a relative one."""
    site = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    joined = F.when(F.rlike(link, F.lit("^https?://")) | (site == ""), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link)).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), link))
    return F.nullif(joined, F.lit(""))


def normalized(items: Column, feed_url: Column) -> Column:
    """Items as postings, in order: plain title and description, absolute link, tags, date, hash; ``item_id`` is what a cursor holds."""

    def one(i: Column) -> Column:
        link = absolute(F.coalesce(_trimmed(i["link"]), _trimmed(i["guid"]), F.lit("")), feed_url)
        facts = F.struct(text.preprocessed(F.coalesce(i["title"], F.lit(""))).alias("title"), F.nullif(text.preprocessed(i["content"]), F.lit("")).alias("description"), link.alias("link"), published(i["published"]).alias("published_at"), F.nullif(F.array_join(F.filter(F.transform(i["categories"], text.trim), lambda c: c != ""), ", "), F.lit("")).alias("tags"), F.coalesce(_trimmed(i["guid"]), _trimmed(i["link"]), F.lit("")).alias("item_id"))
        return let(facts, lambda f: F.struct(f["title"].alias("title"), f["description"].alias("description"), f["link"].alias("link"), f["tags"].alias("tags"), f["published_at"].alias("published_at"), f["item_id"].alias("item_id"), text.item_hash(f["item_id"], f["link"], f["title"], f["published_at"]).alias("hash"), ((f["title"] != "") | f["description"].isNotNull()).alias("there")))

    return F.transform(items, one)


def scan_feeds(feeds: DataFrame, as_of: Column, items: int = ITEMS, days: int = FEED_DAYS) -> DataFrame:
    """(source, place, title, description, link, tags, published_at, item_id, hash, repair): the new items of each feed.

    ``feeds``: source, url, payload, last_item (a hash or an id, or null) and seen (array of hashes, or null).  Of the
    first ``items`` items those before the first that is older than ``days``, or is the last known one, are taken;
    items whose hash was seen are passed over, also as a stop by their id; items without title and text are passed over
    altogether.  Unreadable payloads, nulls and empty feeds give no rows.
    """
    old = lambda x: F.coalesce(x["published_at"] < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    known = lambda x: F.coalesce(F.array_contains("seen", x["hash"]), F.lit(False))
    last = lambda v: F.coalesce((F.col("last_item") != "") & (v == F.col("last_item")), F.lit(False))
    stops = lambda x: x["there"] & (old(x) | last(x["hash"]) | (~known(x) & last(x["item_id"])))
    size = lambda rows, stop: F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size(rows))

    def taken(rows: Column) -> Column:
        stop = F.array_position(F.transform(rows, stops), F.lit(True))
        return F.transform(F.slice(rows, F.lit(1), size(rows, stop)), lambda x: F.when(x["there"] & ~known(x), x))

    new = let(normalized(F.slice(F.coalesce("items", F.array().cast(f"array<{ITEM}>")), 1, items), F.col("url")), taken)
    # the outer form, as else the optimizer would evaluate the array once more in a filter before it
    each = read_feeds(feeds).select("source", "repair", F.posexplode_outer(new).alias("place", "x")).where("x IS NOT NULL")
    return each.select("source", "place", "x.title", "x.description", "x.link", "x.tags", "x.published_at", "x.item_id", "x.hash", "repair")


def check_feeds(feeds: DataFrame) -> DataFrame:
    """(source, ok, reason, feed_title): whether a feed can be added; ``feeds``: source, payload, content_type.

    Reasons: ``no_feed`` (neither the content type nor the first hundred characters say that it is one), ``unreadable``,
    ``no_items``, ``no_content`` (no item with a title or a text).
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    named = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))
    start = F.lower(F.substring(F.coalesce("payload", F.lit("")), 1, 100))
    feed = named(kind, ["xml", "rss", "atom", "json", "text/plain"]) | named(start, ["<?xml", "<rss", "<feed", "{"])
    content = F.exists("items", lambda i: _trimmed(i["title"]).isNotNull() | _trimmed(i["content"]).isNotNull())
    reason = F.when(~feed, "no_feed").when(F.col("items").isNull(), "unreadable").when(F.size("items") == 0, "no_items").when(~content, "no_content")
    return read_feeds(feeds).select("source", reason.isNull().alias("ok"), reason.alias("reason"), "feed_title")


# -- channels -------------------------------------------------------------------------------------------------------


def messages(html: Column) -> Column:
    """array<struct<id, published_at, description>> of a channel's page, from its end to its start."""
    blocks = F.split(html, r'data-post="')
    body = lambda b: F.regexp_extract(b, r"(?s)tgme_widget_message_text[^>]*>(.*?)</div>", 1)
    one = lambda b: F.struct(F.regexp_extract(b, r"^[^\"/]*/(\d+)", 1).cast("bigint").alias("id"), F.try_to_timestamp(F.nullif(F.regexp_extract(b, r'<time[^>]*datetime="([^"]+)"', 1), F.lit(""))).alias("published_at"), text.preprocessed(body(b)).alias("description"))
    found = F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), one)
    return F.reverse(F.filter(found, lambda m: F.coalesce(m["id"] > 0, F.lit(False))))


def scan_channels(pages: DataFrame, as_of: Column, pages_read: int = PAGES, days: int = CHANNEL_DAYS) -> DataFrame:
    """(channel, page, message_id, title, description, link, published_at, hash): new messages of each channel.

    ``pages``: channel, page (from 1, each further back), html, last_seen (a message id, or null).  A page's messages are
    taken from its end up to the first that was seen or is older than ``days``.  Pages are read in order until one has
    such a message, has none at all, has reached the first message, or isn't further back than the one before it; a
    page that wasn't recorded or is empty also ends a channel.
    """
    stops = lambda m: F.coalesce(m["id"] <= F.col("last_seen"), F.lit(False)) | F.coalesce(m["published_at"] < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    own = pages.where(F.col("page").between(1, pages_read)).select("channel", "page", F.coalesce("last_seen", F.lit(0)).alias("last_seen"), messages(F.col("html")).alias("all"))
    own = own.withColumn("stop", F.array_position(F.transform("all", stops), F.lit(True)).cast("int"))
    met = F.when(F.col("stop") > 0, F.slice("all", F.lit(1), F.col("stop"))).otherwise(F.col("all"))  # a stopping message still counts for how far back a page goes
    own = own.withColumn("least", F.array_min(F.transform(met, lambda m: m["id"])))
    by_page = Window.partitionBy("channel").orderBy("page")
    ends = (F.col("stop") > 0) | F.col("least").isNull() | (F.col("least") <= 1) | F.coalesce(F.col("least") >= F.lag("least").over(by_page), F.lit(False))
    before = by_page.rowsBetween(Window.unboundedPreceding, -1)
    told = own.withColumn("ends", F.coalesce(ends, F.lit(True)))
    read = told.withColumn("ended", F.coalesce(F.max("ends").over(before), F.lit(False))).withColumn("rank", F.row_number().over(by_page)).where("NOT ended AND rank = page")
    taken = F.when(F.col("stop") > 0, F.slice("all", F.lit(1), F.col("stop") - 1)).otherwise(F.col("all"))
    each = read.select("channel", "page", F.explode(taken).alias("m")).select("channel", "page", F.col("m.id").alias("message_id"), "m.description", "m.published_at")
    title = F.when(F.col("description") == "", "Вакансия").otherwise(text.first_line_title(F.col("description")))
    return each.withColumn("title", title).withColumn("link", F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), "message_id")).withColumn("hash", text.text_hash(F.col("description")))


def check_channels(probes: DataFrame, as_of: Column, days: int = ALIVE_DAYS) -> DataFrame:
    """(source, ok, reason, last_message_at): whether a channel can be added; ``probes``: source, html, status, final_url.

    Reasons: ``not_public`` (redirected elsewhere), ``unavailable`` (its status), ``no_messages``, ``no_date``,
    ``silent`` (the latest message is older than ``days``).  A page that shows a channel but no messages is fine.
    """
    page = F.coalesce("html", F.lit(""))
    channel = F.contains(page, F.lit("tgme_page_extra")) | F.contains(page, F.lit("Telegram: View")) | (F.contains(page, F.lit("members")) & F.contains(page, F.lit("online")))
    shown = F.contains(page, F.lit("tgme_widget_message")) | F.contains(page, F.lit("tgme_channel_history"))
    times = F.regexp_extract_all(page, F.lit(r'<time[^>]*datetime="([^"]+)"'), F.lit(1))
    facts = probes.select("source", "status", F.coalesce("final_url", F.lit("")).alias("url"), channel.alias("channel"), shown.alias("shown"), F.rlike(page, F.lit(r'class="[^"]*\btgme_widget_message(?![\w-])')).alias("any"), F.array_max(F.transform(times, lambda t: F.try_to_timestamp(t))).alias("last_message_at"))
    late = F.col("last_message_at") < as_of - F.expr(f"INTERVAL {days} DAYS")
    dated = F.when(F.col("last_message_at").isNull(), F.when(F.col("any"), "no_date").when(~F.col("channel"), "no_messages")).when(late, "silent")
    reason = F.when(~F.col("channel") & ~F.contains("url", F.lit("t.me")), "not_public").when(~F.col("channel") & ~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "unavailable").when(F.col("shown"), dated)
    return facts.select("source", reason.isNull().alias("ok"), reason.alias("reason"), "last_message_at")


# How a page counts a channel's readers.
READERS = [r"([\d\s.,]+)\s*(K|M|тыс|млн)?\s*(?:members|subscribers|подписчик|участник)", r"(?:members|subscribers|подписчик|участник)[:\s]+([\d\s.,]+)\s*(K|M|тыс|млн)?"]


def channel_profile(html: Column) -> Column:
    """struct<title, avatar, subscribers> of a channel's page; what it doesn't show is null."""
    meta = lambda name: _trimmed(F.regexp_extract(html, rf'(?is)<meta[^>]*property="og:{name}"[^>]*content="([^"]*)"', 1))
    inner = lambda cls: F.regexp_extract(html, rf'(?is)<(\w+)[^>]*class="[^"]*\b{cls}(?![\w-])[^"]*"[^>]*>(.*?)</\1>', 2)
    plain = lambda x: _trimmed(F.regexp_replace(text.strip_html(x), r"\s+", " "))
    title = _trimmed(replace(F.coalesce(meta("title"), plain(inner("tgme_page_title"))), r"^Telegram:\s*", ""))
    slug = _trimmed(F.regexp_replace(first(title, r"t\.me/([^/\s]+)", 1), "^s/", ""))
    image = _trimmed(F.regexp_extract(html, r'(?is)tgme_page_photo_image[^>]*>\s*<img[^>]*src="([^"]*)"', 1))

    def counted(where: Column, pattern: str) -> Column:
        number = F.regexp_extract(where, java(pattern), 1)
        value = F.regexp_extract(F.regexp_replace(F.regexp_replace(number, java(r"\s+", False), ""), ",", "."), r"^\d+(?:\.\d+)?|^\.\d+", 0).try_cast("double")
        unit = F.upper(F.regexp_extract(where, java(pattern), 2))
        times = F.when(unit.isin("K", "ТЫС"), 1000).when(unit.isin("M", "МЛН"), 1_000_000).otherwise(1)
        return F.when(value > 0, F.floor(value * times + 0.5))

    extra = plain(inner("tgme_page_extra"))
    return F.struct(F.coalesce(slug, title).alias("title"), F.coalesce(meta("image"), image).alias("avatar"), F.coalesce(*(counted(extra, p) for p in READERS), counted(meta("description"), READERS[0])).alias("subscribers"))
