"""Recorded feed payloads as posting rows: one mapping per feed, all to the same columns, so that feeds union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom import schemas
from jobloom.functions import text, urls

COLUMNS = ["source_type", "external_id", "title", "company", "location", "link", "tags", "description", "published_at", "hash"]
#: Feeds by name: where the list is in a payload (none: the payload is the list) and the schema of its elements.
FEEDS = {
    "remotive": ("jobs", schemas.REMOTIVE),
    "arbeitnow": ("data", schemas.ARBEITNOW),
    "themuse": ("results", schemas.THEMUSE),
    "remoteok": (None, schemas.REMOTEOK),
    "jobicy": ("jobs", schemas.JOBICY),
    "findwork": ("results", schemas.FINDWORK),
}


def _tags(*parts: Column) -> Column:
    """The distinct tags that aren't blank, joined by commas; null if there are none."""
    all_ = F.array_distinct(F.filter(F.transform(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
    return F.nullif(F.array_join(all_, ", "), F.lit(""))


def _one(x: Column) -> Column:
    return F.array(x)


def _names(x: Column) -> Column:
    return F.transform(x, lambda y: y["name"])


def _money(low: Column, high: Column, currency: Column | None = None) -> Column:
    """A salary as a tag; null without amounts."""
    amount = F.concat_ws("-", F.nullif(low.cast("string"), F.lit("0")), F.nullif(high.cast("string"), F.lit("0")))
    return F.when(amount != "", F.concat_ws(" ", amount, currency) if currency is not None else amount)


def _row(feed: str, j: Column) -> dict[str, Column]:
    iso = text.parse_date
    return {
        "remotive": lambda: dict(external_id=j["id"], title=j["title"], company=j["company_name"], location=j["candidate_required_location"], link=j["url"], tags=_tags(j["tags"], _one(j["category"]), _one(j["job_type"]), _one(j["salary"])), description=j["description"], published_at=iso(j["publication_date"])),
        "arbeitnow": lambda: dict(external_id=j["slug"], title=j["title"], company=j["company_name"], location=j["location"], link=j["url"], tags=_tags(j["tags"], j["job_types"], _one(F.when(j["remote"], "remote"))), description=j["description"], published_at=F.timestamp_seconds(j["created_at"])),
        "themuse": lambda: dict(external_id=j["id"], title=j["name"], company=j["company"]["name"], location=F.array_join(_names(j["locations"]), ", "), link=j["refs"]["landing_page"], tags=_tags(_names(j["categories"]), _names(j["levels"])), description=j["contents"], published_at=iso(j["publication_date"])),
        "remoteok": lambda: dict(external_id=j["id"], title=j["position"], company=j["company"], location=j["location"], link=j["url"], tags=_tags(j["tags"], _one(_money(j["salary_min"], j["salary_max"]))), description=j["description"], published_at=F.coalesce(F.timestamp_seconds(j["epoch"]), iso(j["date"]))),
        "jobicy": lambda: dict(external_id=j["id"], title=j["jobTitle"], company=j["companyName"], location=j["jobGeo"], link=j["url"], tags=_tags(j["jobIndustry"], j["jobType"], _one(j["jobLevel"]), _one(_money(j["annualSalaryMin"], j["annualSalaryMax"], j["salaryCurrency"]))), description=F.coalesce(j["jobDescription"], j["jobExcerpt"]), published_at=iso(j["pubDate"])),
        "findwork": lambda: dict(external_id=j["id"], title=j["role"], company=j["company_name"], location=j["location"], link=j["url"], tags=_tags(j["keywords"], _one(j["employment_type"]), _one(F.when(j["remote"], "remote"))), description=j["text"], published_at=iso(j["date_posted"])),
    }[feed]()


def mapped(payloads: DataFrame, feed: str, column: str = "value") -> DataFrame:
    """Rows of a feed's payloads (one JSON text per row): elements without a title or link go, markup is stripped, fields stay null where a feed lacks them."""
    place, element = FEEDS[feed]
    schema = f"array<struct<{_colons(element)}>>" if place is None else f"struct<{place}:array<struct<{_colons(element)}>>>"
    parsed = F.from_json(F.col(column), schema)
    items = payloads.select(F.explode(parsed if place is None else parsed[place]).alias("j"))
    row = _row(feed, F.col("j"))
    row["description"], row["external_id"] = text.preprocessed(row["description"]), row["external_id"].cast("string")
    out = items.select(F.lit(feed).alias("source_type"), *(row[c].alias(c) for c in COLUMNS if c in row))
    out = out.withColumn("link", urls.valid_link(F.col("link"))).where("title is not null and trim(title) <> '' and link is not null")
    return out.withColumn("hash", text.item_hash(F.col("external_id"), F.col("link"), F.col("title"), F.col("published_at"))).select(*COLUMNS)


def _colons(fields: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    out = []
    for part in fields.split(", "):
        name, _, kind = part.partition(" ")
        out.append(f"{name}:{kind}")
    return ",".join(out)


def devit(lists: DataFrame, details: DataFrame, list_column: str = "value") -> DataFrame:
    """DevITjobs: recorded lists (one JSON text a row), each job joined with its recorded page (slug, html) where there is one.

    A page holds the job as an embedded script, an assignment or a page's data; a job without name, company or link goes.
    """
    job = f"struct<{_colons(schemas.DEVIT)}>"
    listed = lists.select(F.explode(F.from_json(F.col(list_column), f"array<{job}>")).alias("j")).withColumn("slug", F.col("j.jobUrl"))
    assigned = F.from_json(F.regexp_extract("html", r"(?s)window\.__detailedJob\s*=\s*(\{.*?\})</script>", 1), job)
    data = F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>', 1)
    inside = [F.from_json(F.get_json_object(data, f"$.{p}"), job) for p in ("props.pageProps.job", "props.pageProps.jobDetails", "pageProps.job")]
    paged = details.select("slug", F.coalesce(F.when(assigned["name"].isNotNull(), assigned), *inside).alias("d")).where("d is not null").dropDuplicates(["slug"])
    j = F.col("j")
    both = listed.join(paged, "slug", "left").select(F.coalesce("d", "j").alias("j"))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    meta = F.concat_ws("\n", F.concat(F.lit("Company type: "), clean(j["companyType"])), F.concat(F.lit("Size: "), clean(j["companySize"])))
    description = F.concat_ws("\n\n", *(clean(j[c]) for c in ("description", "responsibilitiesTextArea", "requirementsMustTextArea")), clean(meta))
    link = F.coalesce(clean(j["redirectJobUrl"]), F.concat(F.lit("https://devitjobs.uk/jobs/"), j["jobUrl"]))
    tags = _tags(j["technologies"], _one(j["techCategory"]), _one(j["jobType"]), _one(j["expLevel"]), _one(j["workplace"]))
    out = both.select(F.lit("devitjobs").alias("source_type"), F.coalesce(F.concat(F.lit("devitjobs:"), j["_id"]), link).alias("external_id"), clean(j["name"]).alias("title"), clean(j["company"]).alias("company"), F.coalesce(clean(j["actualCity"]), clean(j["cityCategory"])).alias("location"), link.alias("link"), tags.alias("tags"), text.preprocessed(description).alias("description"), text.parse_date(j["activeFrom"]).alias("published_at"))
    return out.where("title is not null and company is not null and link is not null").withColumn("hash", text.item_hash(F.col("external_id"), F.col("link"), F.col("title"), F.col("published_at"))).select(*COLUMNS)


def arbeitsagentur(lists: DataFrame, details: DataFrame, list_column: str = "value") -> DataFrame:
    """Arbeitsagentur: recorded result pages (one JSON text a row), each listing joined with its recorded details (key, value) by the base64 form of its number."""
    listed = lists.select(F.explode(F.from_json(F.col(list_column), f"struct<stellenangebote:array<struct<{_colons(schemas.ARBEIT_LIST)}>>>")["stellenangebote"]).alias("j")).where("j.refnr <> ''").withColumn("key", F.base64(F.encode("j.refnr", "UTF-8")))
    known = details.select("key", F.from_json("value", f"struct<{_colons(schemas.ARBEIT_DETAIL)}>").alias("d")).dropDuplicates(["key"])
    j, d = F.col("j"), F.col("d")
    places = F.array_join(F.filter(F.transform(d["stellenlokationen"], lambda x: x["adresse"]["ort"]), lambda x: F.coalesce(x != "", F.lit(False))), ", ")
    published = text.parse_date(F.coalesce(d["veroeffentlichungszeitraum"]["von"], d["datumErsteVeroeffentlichung"], j["aktuelleVeroeffentlichungsdatum"]))
    out = listed.join(known, "key", "left").select(
        F.lit("arbeitsagentur").alias("source_type"), j["refnr"].alias("external_id"), F.trim(F.coalesce(d["stellenangebotsTitel"], j["titel"], j["beruf"], d["hauptberuf"], F.lit("Без названия"))).alias("title"), F.nullif(F.coalesce(d["firma"], j["arbeitgeber"]), F.lit("")).alias("company"), F.coalesce(places, j["arbeitsort"]["ort"], j["arbeitsort"]["region"], j["arbeitsort"]["land"]).alias("location"),
        F.concat(F.lit("https://www.arbeitsagentur.de/jobsuche/jobdetail/"), j["refnr"]).alias("link"), d["arbeitgeberKundennummerHash"].alias("tags"), F.trim(F.coalesce(d["stellenangebotsBeschreibung"], j["titel"], j["beruf"], F.lit("Описание недоступно"))).alias("description"), published.alias("published_at"), j["refnr"].alias("hash"),
    )
    return out.select(*COLUMNS)


def facebook(pages: DataFrame, most: int = 30, window: int = 12_000, least: int = 40) -> DataFrame:
    """Posts of recorded Facebook pages (url, html): the first text within ``window`` characters after each post id, at least ``least`` long, each text once a page.

    A page without such posts gives its message texts, linked by their hash.
    """
    message = r'"message":\{"text":"((?:\\.|[^"\\])+)"'
    plain = lambda x: F.trim(F.get_json_object(F.concat(F.lit('{"t":"'), x, F.lit('"}')), "$.t"))
    base = F.regexp_replace("url", "/+$", "")
    after = F.slice(F.split("html", r'(?="post_id":"\d{6,}")'), 2, 1_000_000)
    starts = pages.select("url", F.posexplode(after).alias("i", "piece"), F.col("html"))
    place = starts.withColumn("at", F.sum(F.length("piece")).over(Window.partitionBy("url", "html").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)))
    first_at = F.regexp_instr("html", F.lit(r'"post_id":"\d{6,}"'))
    near = F.substring(F.col("html"), first_at + F.coalesce("at", F.lit(0)), F.lit(window))
    posts = place.select("url", "html", "i", F.regexp_extract("piece", r'"post_id":"(\d+)"', 1).alias("id"), plain(F.regexp_extract(near, message, 1)).alias("description"), F.timestamp_seconds(F.nullif(F.regexp_extract(near, r'"creation_time":(\d{10})', 1), F.lit("")).cast("bigint")).alias("published_at"))
    found = posts.where(F.length("description") >= least)
    rest = pages.join(found.select("url", "html").distinct(), ["url", "html"], "left_anti").select("url", "html", F.posexplode(F.regexp_extract_all("html", F.lit(message), F.lit(1))).alias("i", "raw")).select("url", "html", "i", F.lit(None).cast("string").alias("id"), plain(F.col("raw")).alias("description"), F.lit(None).cast("timestamp").alias("published_at")).where(F.length("description") >= least)
    once = Window.partitionBy("url", "html", "description").orderBy("i")
    ranked = found.unionByName(rest).withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("n", F.row_number().over(Window.partitionBy("url", "html").orderBy("i"))).where(F.col("n") <= most)
    hashed = text.text_hash(F.col("description"))
    link = F.when(F.col("id").isNotNull(), F.concat(base, F.lit("/posts/"), F.col("id"))).otherwise(F.concat(base, F.lit("?jf_post="), F.substring(hashed, 1, 12)))
    return ranked.select("url", text.first_line_title(F.col("description")).alias("title"), "description", link.alias("link"), "published_at", hashed.alias("hash"))


def compare_dump(dumps: DataFrame, column: str = "value") -> DataFrame:
    """Jobs of comparison dumps (one whole text a row): (id, meta, original, parsed), by their marker lines; JSON that can't be read is null."""
    jobs = dumps.select(F.explode(F.slice(F.split(F.col(column), r"(?m)^===== JOB "), 2, 1_000_000)).alias("b"))
    part = lambda p: text.trim(F.regexp_extract("b", p, 1))
    json = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return jobs.select(
        F.nullif(part(r"^(.*?)\s*(?:=====)?\s*(?:\n|$)"), F.lit("")).alias("id"),
        json(part(r"(?m)^META:(.*)$")).alias("meta"),
        part(r"(?ms)^--- ORIGINAL TEXT ---[^\n]*\n(.*?)(?=^--- |\z)").alias("original"),
        json(part(r"(?ms)^--- PARSED JSON ---[^\n]*\n[^{]*(\{.*?^\}|\{[^\n]*\})")).alias("parsed"),
    )


def union(frames: list[DataFrame]) -> DataFrame:
    """All feeds as one table of postings."""
    return reduce(DataFrame.unionByName, frames)


def rss(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Items of RSS payloads (one XML text per row), repaired first: what precedes the declaration goes, bare ampersands are escaped."""
    fixed = F.regexp_replace(F.regexp_replace(F.col(column), r"^[^<]+", ""), r"&(?!(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    item = "title string, link string, guid string, description string, pubDate string, category array<string>"
    parsed = F.from_xml(fixed, f"channel struct<item:array<struct<{_colons(item)}>>>", {"mode": "PERMISSIVE"})
    j = F.col("j")
    rows = payloads.select(F.explode(parsed["channel"]["item"]).alias("j")).select(
        F.lit("rss").alias("source_type"), F.coalesce(j["guid"], j["link"]).alias("external_id"), F.trim(j["title"]).alias("title"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("location"), urls.valid_link(j["link"]).alias("link"), _tags(j["category"]).alias("tags"), text.preprocessed(j["description"]).alias("description"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(j["pubDate"], r"^\w{3}, ", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published_at"),
    )
    return rows.withColumn("hash", text.item_hash(F.col("external_id"), F.col("link"), F.col("title"), F.col("published_at"))).select(*COLUMNS)


def telegram(pages: DataFrame, column: str = "html") -> DataFrame:
    """Messages of recorded Telegram channel pages: (slug, message_id, description, title, published_at, hash)."""
    blocks = F.slice(F.split(F.col(column), r'data-post="'), 2, 1_000_000)
    message = pages.select(F.explode(blocks).alias("b"))
    body = F.regexp_extract("b", r'(?s)tgme_widget_message_text[^>]*>(.*?)</div>', 1)
    out = message.select(F.regexp_extract("b", r"^([A-Za-z0-9_]+)/(\d+)", 1).alias("slug"), F.regexp_extract("b", r"^([A-Za-z0-9_]+)/(\d+)", 2).cast("bigint").alias("message_id"), text.preprocessed(body).alias("description"), F.try_to_timestamp(F.regexp_extract("b", r'datetime="([^"]+)"', 1)).alias("published_at"))
    return out.where("description <> ''").withColumn("title", text.first_line_title(F.col("description"))).withColumn("hash", text.text_hash(F.col("description")))


def main_content(html: Column, least: int = 200) -> Column:
    """The text of the first main or article element if it is long enough, else of the body."""
    of = lambda tag: text.preprocessed(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)(?:</{tag}>|\z)", 1))
    return F.when(F.length(of("main")) >= least, of("main")).when(F.length(of("article")) >= least, of("article")).otherwise(of("body"))
