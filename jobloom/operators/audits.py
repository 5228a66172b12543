"""Reports over parsed postings: shares, warnings, issues with examples, coverage of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import has, replace
from ..functions.titles import FORMAT_WORDS
from .postings import top_n

SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 3}


def share(condition: Column) -> Column:
    """Per cent of the rows, to one decimal, rounded half up."""
    return F.floor(F.count_if(condition) * 1000 / F.count("*") + 0.5) / 10


def metrics(parsed: DataFrame) -> DataFrame:
    """One row: how many records, and the shares with a doubtful title, with a salary and without contacts."""
    contacts = F.size("contacts.emails") + F.size("contacts.phones") + F.size("contacts.telegram") + F.size("contacts.urls")
    return parsed.agg(F.count("*").alias("total"), share(F.col("title.confidence") < 0.6).alias("title_low"), share(F.col("salary.min").isNotNull() | F.col("salary.max").isNotNull()).alias("salary_found"), share(contacts == 0).alias("no_contacts"))


def top_counts(df: DataFrame, array: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent elements of an array column; ties by name."""
    each = df.select(F.explode(array).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "name").limit(k)


def issues(df: DataFrame, rules: dict[str, tuple[str, Column]], row_id: str, least: str = "low") -> DataFrame:
    """(id, issue, severity): one row per rule that a row breaks, of at least that severity."""
    kept = {k: v for k, v in rules.items() if SEVERITY[v[0]] >= SEVERITY[least]}
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("issue"), F.lit(level).alias("severity"))) for name, (level, c) in kept.items())))
    return df.select(row_id, F.explode(hits).alias("i")).select(row_id, "i.issue", "i.severity")


def histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("issue", "severity").agg(F.count("*").alias("n"))


def totals(found: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """One row: rows, rows with issues, issues."""
    return rows.agg(F.count("*").alias("rows")).join(found.agg(F.count_distinct(row_id).alias("rows_with_issues"), F.count("*").alias("issues")))


def examples(found: DataFrame, row_id: str, n: int = 15) -> DataFrame:
    """The first ``n`` rows of each issue."""
    return top_n(found, "issue", [row_id], n)


def title_issues(title: Column) -> dict[str, tuple[str, Column]]:
    """Rules of the title audit."""
    size = F.length(title)
    return {
        "title_null": ("high", title.isNull() | (F.trim(title) == "")),
        "title_too_long": ("medium", size > 90),
        "title_too_short": ("medium", size.between(1, 3)),
        "title_has_url": ("high", F.rlike(title, F.lit("(?i)https?://|www\\."))),
        "title_has_email": ("medium", F.rlike(title, F.lit("(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}"))),
        "title_is_sentence": ("low", F.rlike(title, F.lit("[.!?]\\s+\\S"))),
    }


# Pay and section words of the title audit.
TITLE_PAY = r"(\d{2,}\s*(?:₽|\$|€|usd|eur|rub|gbp|chf|pln|sek|nok|dkk|ron|bgn)|\b(руб|usd|eur|salary|compensation|заработ|оклад|оплат)\b)"
TITLE_SECTION = r"\b(требовани|обязанност|услови|о проекте|мы предлагаем|что мы предлагаем|responsibilities|requirements|benefits|about the project)\b"


def title_quality(title: Column) -> dict[str, tuple[str, Column]]:
    """AGG-10: a missing title, or else format words alone, too long, with pay, section words or a link."""
    there = F.trim(F.coalesce(title, F.lit(""))) != ""
    return {
        "title_null": ("high", ~there),
        "title_workformat_only": ("high", there & ~has(replace(title, FORMAT_WORDS, " "), "[a-zа-яё]")),
        "title_too_long": ("medium", F.length(F.trim(title)) > 80),
        "title_contains_salary": ("medium", there & has(title, TITLE_PAY)),
        "title_contains_section_words": ("medium", there & has(title, TITLE_SECTION)),
        "title_contains_url": ("high", there & has(title, r"https?://")),
    }


# Words that a parsed place can't be.
TECH_PLACES = ["django", "fastapi", "nestjs", "node", "react", "angular", "vue", "kafka", "docker", "gitlab", "github"]
WORD_PLACES = ["years", "year", "working", "hours", "experience", "benefits", "requirements", "responsibilities", "salary", "compensation", "offer", "retirement", "pto", "bonus", "k", "ote"]
PAY_WORDS = r"(salary|compensation|оклад|зарплат|зп\b|\bpay\b|gehalt|доход)"
MONEY = r"([₽$€£]|\b(usd|eur|rub|gbp)\b|руб)"


def parse_issues(original: Column) -> dict[str, tuple[str, Column]]:
    """AGG-8: what a parsed record says against its text; for rows of ``parse.parsed`` (salary, title, location, contacts, warnings)."""
    low, high, currency = F.col("salary.min"), F.col("salary.max"), F.col("salary.currency")
    amounts = low.isNotNull() | high.isNotNull()
    year = lambda x: F.coalesce(x.between(1900, 2100), F.lit(False))
    city, country = F.lower(F.coalesce("location.city", F.lit(""))), F.lower(F.coalesce("location.country", F.lit("")))
    tech = F.lit(False)
    for t in TECH_PLACES:
        tech = tech | city.contains(t) | country.contains(t)
    raw = F.coalesce("title.raw", F.lit(""))
    handles = has(original, r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}") | has(original, r"(^|\s)@([a-zA-Z0-9_]{3,32})\b")
    return {
        "salary_false_positive_year": ("medium", amounts & year(F.coalesce(low, high)) & year(F.coalesce(high, low)) & ~has(original, PAY_WORDS)),
        "salary_currency_unknown_but_mentioned": ("medium", amounts & F.coalesce(currency.isin("UNKNOWN"), F.lit(True)) & has(original, MONEY)),
        "warning_salary_not_found_but_has_values": ("low", F.array_contains("warnings", "salary_not_found") & amounts),
        "title_glued_or_too_long_raw": ("medium", F.col("title.value").isNull() & (F.length(raw) >= 140)),
        "title_starts_with_hashtags": ("low", F.rlike(raw, F.lit(r"^\s*(?:#\S+\s*){2,}"))),
        "location_false_positive_tech_tokens": ("high", tech),
        "location_false_positive_common_words": ("high", city.isin(*WORD_PLACES) | country.isin(*WORD_PLACES)),
        "contacts_urls_trailing_punct": ("low", F.exists("contacts.urls", lambda u: F.rlike(u, F.lit(r"[),.;:]$")))),
        "contacts_missed_obvious": ("high", (F.size("contacts.emails") == 0) & (F.size("contacts.telegram") == 0) & handles),
        "original_text_looks_like_multi_vacancy_dump": ("low", (F.length(original) > 900) & has(original, r"(понравились\s+вакансии|разместить\s+вакансию)") & ~F.array_contains("warnings", "input_truncated")),
    }


def report_lines(found: DataFrame, rows: int, row_id: str, n: int = 10) -> DataFrame:
    """(place, line) of a report: totals, the issues with their counts, most frequent first, and the first ``n`` rows of each."""
    told = found.groupBy("issue", "severity").agg(F.count("*").alias("n"))
    some = examples(found, row_id, n).groupBy("issue").agg(F.array_sort(F.collect_list(F.col(row_id))).alias("ids"))  # at most n of each issue
    head = found.agg(F.count("*").alias("issues"), F.count_distinct(row_id).alias("rows")).select(F.concat(F.lit(f"rows: {rows}, with issues: "), "rows", F.lit(", issues: "), "issues").alias("line"), F.lit(-1).cast("bigint").alias("n"), F.lit("").alias("issue"))
    body = told.join(some, "issue", "left").select(F.concat("issue", F.lit(" ("), "n", F.lit(") ["), "severity", F.lit("]: "), F.array_join(F.col("ids").cast("array<string>"), ", ")).alias("line"), "n", "issue")
    order = Window.orderBy(F.when(F.col("n") < 0, 0).otherwise(1), F.desc("n"), "issue")  # a line for each rule: a few dozen rows
    return head.unionByName(body).select((F.row_number().over(order) - 1).alias("place"), "line")


def write_report(found: DataFrame, rows: int, row_id: str, path: str, n: int = 10) -> None:
    """Write ``found`` as JSON lines to ``path``/json and its report as text to ``path``/text; a failed write leaves the last ones."""
    found.write.mode("overwrite").json(f"{path}/json")
    report_lines(found, rows, row_id, n).orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/text")
