"""The composed extraction record of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import extract, places, text, titles
from jobloom.functions.salary import salary


def sectioned(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the normalised text, its lines and sections; each is computed in a projection of its own, once."""
    return (
        df.withColumn("sanitized", text.sanitized(F.col(column)))
        .withColumn("normalized", text.preprocessed(F.col("sanitized.text")))
        .withColumn("lines", text.lines(F.col("normalized")))
        .withColumn("sections", text.sections(F.col("lines")))
    )


FIELDS = ["contacts", "salary", "employment", "work_format", "schedule", "location", "title", "experience", "tech", "languages", "benefits", "interview", "company"]
#: Fields that are worked out together, so that no projection grows too large to plan or compile.
GROUPS = [["contacts", "company"], ["salary"], ["employment", "work_format", "schedule"], ["location"], ["title"], ["experience", "tech"], ["languages", "benefits", "interview"]]


def parsed(df: DataFrame, column: str, country: Column | None = None, currency: Column | None = None, strict: bool = False) -> DataFrame:
    """``df`` with one struct per field, ``total`` (the greatest confidence), ``detected_lang`` and ``warnings``.

    ``country`` and ``currency`` hint at what a text doesn't say; ``strict`` takes no amount without a currency or a word for pay.
    """
    lang = F.col("detected_lang")
    home = F.coalesce(country if country is not None else F.lit(None).cast("string"), F.when(lang.isin("ru", "mixed"), "RU"))

    def field(name: str) -> Column:
        if name == "salary":
            return salary(F.col("sections"), country, currency, strict)
        if name == "title":
            return titles.title(F.col("lines"), strict)
        if name == "location":
            return places.location(F.col("sections"), country)
        if name == "contacts":
            return extract.contacts(F.col("normalized"), home)
        return getattr(extract, name)(F.col("normalized" if name == "company" else "sections"))

    out = sectioned(df, column).withColumn("detected_lang", text.detect_lang(F.col("normalized")))
    for group in GROUPS:
        out = out.select("*", *(field(n).alias(n) for n in group))
    warned = [F.when(F.col("normalized") == "", "empty_text"), F.when(lang == "unknown", "lang_unknown"), *(F.when(F.col(f"{n}.confidence") == 0, f"{n}_not_found") for n in FIELDS if n != "title")]
    bare = F.col("salary.min").isNull() & F.col("salary.max").isNull() & (F.col("salary.confidence") > 0)
    conflicts = [F.when(bare, "salary_currency_only"), F.when(F.col("employment.conflict"), "employment_conflict_full_part"), F.when(F.col("work_format.conflict"), "work_format_conflict_remote_onsite")]
    regions = F.transform("location.regions", lambda r: F.concat(F.lit("location_region_only:"), r))
    return out.select("*", F.greatest(*(F.col(f"{n}.confidence") for n in FIELDS)).alias("total"), F.concat(F.col("sanitized.warnings"), F.array_compact(F.array(*warned, *conflicts)), F.col("title.warnings"), regions).alias("warnings"))
