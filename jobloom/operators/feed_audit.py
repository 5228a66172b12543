"""Audits of feed postings against what was parsed from them (AGG-11, AGG-12).

Rows hold a posting (``title``, ``description``, ``link``) and its record as ``plans.parse.parsed`` gives it (a struct
for each field, ``warnings``).  ``accuracy`` cross-checks each field with what plain patterns expect in the text,
``feed_issues`` looks for known kinds of mistakes.  Both give one row for each issue of each posting: (id, issue,
severity, expected, found); ``report`` and ``examples`` count and show them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import first, has, java
from .audits import SEVERITY
from .postings import top_n

# What names a company, pay or a place in a posting, in the order of trust, and words that are none.
NAME = r"([A-ZА-Я][A-Za-zА-Яа-я0-9\s&'.-]{2,60}?)"
NAME_END = r"(?:\s*\n|\s*URL|\s*$)"
HEADQUARTERS = rf"headquarters\s*:\s*{NAME}{NAME_END}"
COMPANY = [HEADQUARTERS, rf"(?:company|компания|организация)[\s:]+{NAME}{NAME_END}", rf"(?:at|в|от)\s+{NAME}{NAME_END}"]
COMPANY_FIRST = rf"^{NAME}\s*[:\-–—]"
NOT_COMPANY = ["headquarters", "headquarter", "hq", "remote", "location", "url"]
GENERIC_COMPANY = ["headquarters", "headquarter", "hq", "company", "компания", "remote"]
SALARY = [r"(?:salary|зарплата|compensation|оплата)[\s:]+([0-9,\s]+[$₽€£]?)", r"([0-9,\s]+)\s*(?:USD|EUR|RUB|₽|\$|€|£)\s*(?:per|в|за)\s*(?:month|year|месяц|год)"]
LOCATION = r"(?:location|локация|место)[\s:]+([A-ZА-Я][A-Za-zА-Яа-я\s,.-]{2,60})"
PAY = ["salary", "compensation", "pay", "rate", "$", "€", "₽", "usd", "eur", "rub"]
PAY_IN_TEXT = ["salary", "compensation", "pay", "rate", "зарплат", "оплат"]
TECH = ["django", "fastapi", "nestjs", "node", "react", "angular", "vue", "python", "java"]
EMAIL, HANDLE = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(^|\s)@([a-zA-Z0-9_]{3,32})\b"
SENIOR = ["senior", "lead", "head of", "director", "manager"]
FULL_TIME = ["full-time", "full time", "полная занятость"]
TITLE_COMPANY = r"^([A-Z][A-Za-z0-9\s&'.-]{2,60})\s*[:\-–—]"
URL_DOMAIN = r"url\s*:\s*https?://(?:www\.)?([a-z0-9][a-z0-9-]{1,40}\.[a-z]{2,})"
CURRENCY = ["$", "€", "₽", "usd", "eur", "rub", "gbp", "£"]
ICELAND = ["iceland", "reykjavik", "исландия", "рейкьявик"]
FEED_TECH = ["django", "fastapi", "nestjs", "node", "react", "angular", "vue", "kafka", "docker", "gitlab", "github", "python", "java", "javascript"]
FEED_WORDS = ["years", "year", "working", "hours", "experience", "benefits", "requirements", "responsibilities", "salary", "compensation"]
ABOUT_ROLE = ["about the role", "о роли"]
FORMATS = ["remote", "удален", "удалён", "work from home", "wfh", "onsite", "on-site", "in office", "в офисе", "hybrid", "гибрид"]
EXPERIENCE = ["years of experience", "лет опыта", "опыт работы", "experience required"]
COMMON_TECH = ["react", "angular", "vue", "node", "python", "java", "typescript", "javascript", "docker", "kubernetes", "aws", "figma", "sketch"]

#: The record's fields whose confidence is looked at.
FIELDS = ["title", "company", "salary", "location", "employment", "work_format", "experience", "tech", "contacts"]
_WHITE = " \t\r\n"


@dataclass
class Rule:
    """An issue: its severity, when a row has it, and what the row shows for it."""

    issue: str
    severity: str
    when: Column
    expected: Column | None = None
    found: Column | None = None


def any_of(low: Column, needles: list[str]) -> Column:
    """Whether a lower-cased text holds one of these strings; false for null."""
    out = F.lit(False)
    for x in needles:
        out = out | F.contains(low, F.lit(x))
    return F.coalesce(out, F.lit(False))


def _low(value: Column) -> Column:
    return F.btrim(F.lower(value), F.lit(_WHITE))


def _name(raw: Column) -> Column:
    """A company's name with single spaces, or null if it is a word that none is called."""
    return F.btrim(F.regexp_replace(raw, r"\s+", " "), F.lit(_WHITE))


def _company(found: list[Column]) -> Column:
    names = [_name(x) for x in found]
    return F.coalesce(*(F.when((F.length(n) >= 2) & ~_low(n).isin(*NOT_COMPANY) & ~_low(n).startswith("url"), n) for n in names))


def _within(low: Column, value: Column) -> Column:
    return F.contains(low, _low(value))


def _unlike(a: Column, b: Column) -> Column:
    """Neither of two lower-cased texts holds the other."""
    return ~F.contains(a, b) & ~F.contains(b, a)


def _sure(confidences: dict[str, Column], least: float) -> Column:
    """Names of the fields whose confidence is lower."""
    return F.array_compact(F.array(*(F.when(c < least, F.lit(n)) for n, c in confidences.items())))


def checked(df: DataFrame) -> DataFrame:
    """``df`` with what the rules share: the whole text, and what it says of company, pay and place."""
    out = df.withColumn("full", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))).withColumn("low", F.lower("full"))
    own_case = F.nullif(F.regexp_extract("full", java(COMPANY_FIRST, fold=False), 1), F.lit(""))
    hq = _name(first(F.col("full"), HEADQUARTERS, 1))
    return out.select(
        "*",
        _company([*(first(F.col("full"), p, 1) for p in COMPANY), own_case]).alias("says_company"),
        F.when((F.length(hq) >= 2) & ~_low(hq).isin(*NOT_COMPANY), hq).alias("says_headquarters"),
        F.coalesce(*(F.btrim(first(F.col("full"), p, 1), F.lit(_WHITE)) for p in SALARY)).alias("says_salary"),
        F.btrim(first(F.col("full"), LOCATION, 1), F.lit(_WHITE)).alias("says_location"),
    )


def accuracy_rules(confidences: dict[str, Column]) -> list[Rule]:
    """AGG-11, for rows of ``checked``."""
    low = F.col("low")
    given, named = _low(F.col("posting_title")), _low(F.col("record.title.value"))
    there = (named != "") & (given != "")
    apart = there & _unlike(given, named)
    company, says, hq = F.col("record.company.name"), F.col("says_company"), F.col("says_headquarters")
    parts = F.filter(F.split(_low(company), r"\s+"), lambda p: F.length(p) > 2)
    part_seen = F.exists(parts, lambda p: F.contains(low, p))
    generic = _low(company).isin(*GENERIC_COMPANY)
    least, most = F.col("record.salary.min"), F.col("record.salary.max")
    place = F.concat_ws(" ", F.nullif("record.location.city", F.lit("")), F.nullif("record.location.country", F.lit("")))
    city, country = F.lower("record.location.city"), F.lower("record.location.country")
    either = lambda a, b: F.coalesce(F.when(a != 0, a), b).cast("string")
    as_text = lambda name: F.lower(F.to_json(F.col(f"record.{name}")))

    def against(name: str, severity: str, said: Column, unseen: Column | None) -> list[Rule]:
        value = F.col(f"record.{name}")
        rules = [Rule(f"{name}_missed", severity, said.isNotNull() & value.isNull(), said)]
        if unseen is not None:
            rules.append(Rule(f"{name}_false_positive", severity, said.isNull() & value.isNotNull() & unseen, None, as_text(name)))
        return [*rules, Rule(f"{name}_mismatch", "medium", said.isNotNull() & value.isNotNull() & _unlike(as_text(name), _low(said)), said, as_text(name))]

    shown = F.concat_ws("-", least.cast("string"), most.cast("string"))
    low_fields = _sure(confidences, 0.3)
    return [
        Rule("title_truncated", "high", there & (F.length(named) < F.length(given) - 5) & F.contains(given, named) & (F.length(named) < 15), F.col("posting_title"), F.col("record.title.value")),
        Rule("title_from_description", "medium", apart & F.contains(F.lower("description"), named), F.col("posting_title"), F.col("record.title.value")),
        Rule("title_mismatch", "high", apart & ~F.coalesce(F.contains(F.lower("description"), named), F.lit(False)), F.col("posting_title"), F.col("record.title.value")),
        Rule("title_missed", "high", (F.coalesce(F.col("record.title.value"), F.lit("")) == "") & (F.length("posting_title") > 5), F.col("posting_title")),
        *against("company", "high", says, F.when(F.coalesce(company, F.lit("")) == "", True).otherwise(~_within(low, company) & ~part_seen)),
        *against("salary", "high", F.col("says_salary"), None),
        *against("location", "medium", F.col("says_location"), (place != "") & ~_within(low, place)),
        Rule("employment_false_positive", "medium", F.col("record.employment").isNotNull() & ~F.contains(low, as_text("employment")), None, as_text("employment")),
        Rule("work_format_false_positive", "medium", F.col("record.work_format").isNotNull() & ~F.contains(low, as_text("work_format")), None, as_text("work_format")),
        Rule("company_generic_name", "high", generic, hq, company),
        Rule("company_mismatch_with_headquarters", "high", ~generic & (company != "") & hq.isNotNull() & _unlike(_low(company), _low(hq)), hq, company),
        Rule("company_missed_from_headquarters", "high", (F.coalesce(company, F.lit("")) == "") & hq.isNotNull(), hq),
        Rule("salary_year_false_positive", "high", least.between(1900, 2100) & most.between(1900, 2100) & ~any_of(low, PAY), None, shown),
        Rule("salary_amount_not_found", "medium", (least.isNotNull() | most.isNotNull()) & ~any_of(low, PAY_IN_TEXT) & ~F.coalesce(F.contains(low, either(least, most)), F.lit(False)) & ~F.coalesce(F.contains(low, either(most, least)), F.lit(False)), None, shown),
        Rule("location_tech_token_false_positive", "high", any_of(city, TECH) | any_of(country, TECH), None, place),
        Rule("contacts_email_missed", "high", has(F.col("full"), EMAIL) & (F.coalesce(F.size("record.contacts.emails"), F.lit(0)) <= 0), first(F.col("full"), EMAIL)),
        Rule("contacts_telegram_missed", "medium", has(F.col("full"), HANDLE) & (F.coalesce(F.size("record.contacts.telegram"), F.lit(0)) <= 0), first(F.col("full"), HANDLE, 2)),
        Rule("low_confidence", "info", F.size(low_fields) > 0, None, F.array_join(low_fields, ",")),
    ]


def feed_rules(confidences: dict[str, Column]) -> list[Rule]:
    """AGG-12, for rows of ``checked``."""
    low, original, title = F.col("low"), F.coalesce("description", F.lit("")), F.coalesce("posting_title", F.lit(""))
    said = F.lower(original)
    types, company = F.col("record.employment.types"), F.nullif("record.company.name", F.lit(""))
    intern = F.coalesce(F.array_contains(types, "internship"), F.lit(False))
    in_title = F.nullif(F.regexp_extract(title, java(TITLE_COMPANY, fold=False), 1), F.lit(""))
    domain = F.split_part(first(original, URL_DOMAIN, 1), F.lit("."), F.lit(1))
    from_url = F.concat(F.upper(F.substring(domain, 1, 1)), F.substring(domain, 2, 64))
    least, most, money = F.col("record.salary.min"), F.col("record.salary.max"), F.col("record.salary.currency")
    paid = least.isNotNull() | most.isNotNull()
    year = lambda a, b: F.coalesce(F.coalesce(a, b).between(1900, 2100), F.lit(False))
    city, country = F.lower(F.coalesce("record.location.city", F.lit(""))), F.lower(F.coalesce("record.location.country", F.lit("")))
    where, shown = F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(country, F.lit(""))), F.concat_ws("-", least.cast("string"), most.cast("string"))
    value, raw = F.col("record.title.value"), F.col("record.title.raw")
    about = F.instr(said, "about the role")
    none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    trailing = F.filter("record.contacts.urls", lambda u: F.rlike(F.trim(u), F.lit(r"[),.;:]$")))
    mentioned = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), t) for t in COMMON_TECH)))
    low_fields = _sure(confidences, 0.5)
    return [
        Rule("employment_wrong_type_internship", "high", intern & (any_of(low, SENIOR) | any_of(low, FULL_TIME)), None, F.array_join(types, ",")),
        Rule("company_name_headquarters_false_positive", "high", F.contains(F.lower(company), F.lit("headquarter")) | (F.lower(company) == "hq"), None, company),
        Rule("company_name_truncated", "medium", F.contains(title, company) & in_title.isNotNull() & (in_title != company), in_title, company),
        Rule("company_name_missed_from_url", "medium", company.isNotNull() & from_url.isNotNull() & (F.lower(company) != F.lower(from_url)) & ~F.contains(F.lower(company), F.lower(domain)), from_url, company),
        Rule("company_name_missed", "high", company.isNull() & in_title.isNotNull(), in_title),
        Rule("company_name_missed_from_url", "high", company.isNull() & from_url.isNotNull(), from_url),
        Rule("salary_false_positive_year", "high", paid & year(least, most) & year(most, least) & ~any_of(said, PAY), None, shown),
        Rule("salary_currency_unknown_but_mentioned", "medium", paid & (F.coalesce(money, F.lit("UNKNOWN")) == "UNKNOWN") & any_of(said, CURRENCY), None, shown),
        Rule("location_false_positive_iceland", "high", (country == "iceland") & ~any_of(low, ICELAND), None, where),
        Rule("location_false_positive_tech_tokens", "high", any_of(city, FEED_TECH) | any_of(country, FEED_TECH), None, where),
        Rule("location_false_positive_common_words", "high", F.trim(city).isin(*FEED_WORDS) | F.trim(country).isin(*FEED_WORDS), None, where),
        Rule("title_truncated", "high", (value != "") & (F.length(value) < 10) & (F.length(raw) > F.length(value) + 10) & (F.position(F.lower(value), low) > 1), raw, value),
        Rule("title_too_long_or_glued", "medium", (F.coalesce(value, F.lit("")) == "") & (F.length(raw) > 140), None, raw),
        Rule("title_cut_by_about_the_role", "medium", (value != "") & any_of(said, ABOUT_ROLE) & (F.length(value) < F.length(title)) & about.between(2, 100), title, value),
        Rule("contacts_missed", "medium", none("record.contacts.emails") & none("record.contacts.telegram") & (has(original, EMAIL) | has(original, HANDLE)), F.coalesce(first(original, EMAIL), first(original, HANDLE, 2))),
        Rule("contacts_urls_trailing_punct", "low", F.size(trailing) > 0, None, F.array_join(F.slice(trailing, 1, 5), " ")),
        Rule("work_format_unknown_but_mentioned", "medium", (F.col("record.work_format.value") == "unknown") & any_of(low, FORMATS)),
        Rule("experience_missed", "medium", F.col("record.experience.min_years").isNull() & F.col("record.experience.max_years").isNull() & any_of(low, EXPERIENCE)),
        Rule("tech_stack_missed", "low", (F.size(mentioned) > 0) & none("record.tech.all"), F.array_join(F.slice(mentioned, 1, 5), ",")),
        Rule("parser_warnings", "info", F.size("record.warnings") > 0, None, F.array_join("record.warnings", ",")),
        Rule("low_confidence_fields", "info", F.size(low_fields) > 0, None, F.array_join(low_fields, ",")),
    ]


def audited(df: DataFrame, rules, least: str = "info", blank: bool = False) -> DataFrame:
    """(id, issue, severity, expected, found): a row for each issue of each row, of at least that severity.

    ``df``: id, title, description and ``record``, the structs of ``FIELDS`` with ``warnings``.  Rows without any text
    have no issues unless ``blank``.  ``rules``: ``accuracy_rules`` or ``feed_rules``.
    """
    plain = checked(df.withColumnRenamed("id", "posting_id").withColumn("posting_title", F.col("title")))
    confidences = {n: F.col(f"record.{n}.confidence") for n in FIELDS if "confidence" in df.select(f"record.{n}.*").columns}
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    hit = lambda r: F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.issue).alias("issue"), F.lit(r.severity).alias("severity"), text(r.expected).alias("expected"), text(r.found).alias("found")))
    hits = F.array_compact(F.array(*(hit(r) for r in rules(confidences) if SEVERITY[r.severity] >= SEVERITY[least])))
    judged = plain if blank else plain.where(F.btrim("full", F.lit(_WHITE)) != "")
    return judged.select(F.col("posting_id").alias("id"), F.explode(hits).alias("i")).select("id", "i.*")


def accuracy(df: DataFrame, least: str = "low", blank: bool = False) -> DataFrame:
    return audited(df, accuracy_rules, least, blank)


def feed_issues(df: DataFrame, least: str = "info", blank: bool = False) -> DataFrame:
    return audited(df, feed_rules, least, blank)


def record(parsed: DataFrame, *keep: Column | str) -> DataFrame:
    """Rows of ``plans.parse.parsed`` with their fields as one struct ``record``, and the columns ``keep``."""
    return parsed.select(*keep, F.struct(*FIELDS, "warnings").alias("record"))


def report(found: DataFrame) -> DataFrame:
    """(issue, severity, n): most frequent first."""
    return found.groupBy("issue", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue", "severity")


def severities(found: DataFrame) -> DataFrame:
    """(severity, n) for all severities, none left out."""
    every = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SEVERITY))).alias("severity"))
    return every.join(found.groupBy("severity").agg(F.count("*").alias("k")), "severity", "left").select("severity", F.coalesce("k", F.lit(0)).alias("n"))


def examples(found: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each issue by id."""
    return top_n(found, "issue", ["id"], n)


def resolved(jobs: DataFrame, pages: DataFrame, least: int = 400) -> DataFrame:
    """``jobs`` (link, description, ..) with the text of their page in place of a description that is too short.

    ``pages``: (url, text).  A page counts if it has any text; without one the description stays.
    """
    base = F.btrim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " "), F.lit(_WHITE))
    page = pages.select(F.col("url").alias("page_url"), F.btrim(F.regexp_replace("text", r"\s+", " "), F.lit(_WHITE)).alias("page_text")).dropDuplicates(["page_url"])
    own = jobs.withColumn("base", base).withColumn("wanted", F.when(F.length("base") < least, F.nullif("link", F.lit(""))))
    joined = own.join(page, own["wanted"] == page["page_url"], "left")
    return joined.withColumn("description", F.coalesce(F.nullif("page_text", F.lit("")), F.col("base"))).drop("base", "wanted", "page_url", "page_text")
