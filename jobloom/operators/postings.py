"""Listing, deduplication, retention and merging of postings."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROTECTED = ("shortlisted", "applied")


def dedup_key(source: Column, link: Column | None, title: Column, description: Column, row_id: Column) -> Column:
    """What makes two postings the same: source and link, else source, title and the first 300 characters, else the row itself."""
    own = F.coalesce(source.cast("string"), F.lit("no_source"))
    title, short = F.trim(F.coalesce(title, F.lit(""))), F.substring(F.trim(F.coalesce(description, F.lit(""))), 1, 300)
    text = F.when((title == "") & (short == ""), F.concat(own, F.lit(":id:"), row_id.cast("string"))).otherwise(F.concat(own, F.lit(":text:"), title, F.lit(":"), short))
    return text if link is None else F.when(F.trim(F.coalesce(link, F.lit(""))) != "", F.concat(own, F.lit(":link:"), F.trim(link))).otherwise(text)


def keep_first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key by ``order`` (struct order), as one pre-aggregated minimum: a very frequent key isn't sorted in one task."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold, for one of the ``|`` alternatives, all of its words (up to 8 of 8) as case-insensitive substrings."""
    parts = [[t for t in part.replace(",", " ").replace(";", " ").split()][:8] for part in query.strip().lower().split("|")]
    parts = [p for p in parts if p][:8]
    if not parts:
        return df
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    return df.where(reduce(or_, (reduce(and_, (F.contains(hay, F.lit(t)) for t in p)) for p in parts)))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in a total order; Spark keeps the top rows of each partition only."""
    return df.orderBy(*order).offset(number * size).limit(size)


def unprotected(jobs: DataFrame, applications: DataFrame, status: str | None = None) -> DataFrame:
    """Jobs that no funnel protects: of no protected status and without applications."""
    open_ = jobs.where(~F.coalesce(F.col(status).isin(*PROTECTED), F.lit(False))) if status else jobs
    return open_.join(applications.select(F.col("job_id").alias("id")), "id", "left_anti")


def survivors(jobs: DataFrame, applications: DataFrame, published: str, created: str, cutoff: Column, status: str | None = None) -> DataFrame:
    """What retention keeps: rows published (or else created) since ``cutoff``, and protected ones; one join, nothing collected."""
    applied = applications.select(F.col("job_id").alias("id")).distinct().withColumn("_applied", F.lit(True))
    age = F.coalesce(F.col(published), F.col(created))
    kept = F.coalesce(F.col("_applied"), F.lit(False)) | ~F.coalesce(age < cutoff, F.lit(False))
    if status:
        kept = kept | F.coalesce(F.col(status).isin(*PROTECTED), F.lit(False))
    return jobs.join(applied, "id", "left").where(kept).drop("_applied")


def insert_absent(main: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """``main`` and those rows of ``other`` whose key it lacks."""
    return main.unionByName(other.join(main.select(*key), key, "left_anti"), allowMissingColumns=True)


def detach(children: DataFrame, parent: str, removed: DataFrame) -> DataFrame:
    """``children`` with a null ``parent`` where ``removed`` (of one column, the id) names it."""
    gone = removed.toDF(parent).distinct().withColumn("_gone", F.lit(True))
    return children.join(gone, parent, "left").withColumn(parent, F.when(F.col("_gone").isNull(), F.col(parent))).drop("_gone").select(children.columns)


def set_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``jobs`` with the statuses of ``changes`` (id, status), as far as they are allowed."""
    allowed = changes.where(F.col("status").isin("new", "shortlisted", "applied", "archived")).groupBy("id").agg(F.max("status").alias("_new"))
    return jobs.join(allowed, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def latest_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert by key: of each key the row with the greatest ``order``."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(*key).agg(F.max_by(row, F.struct(order, row)).alias("_row")).select("_row.*")


def ring(df: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """(key, values): the last ``size`` values of each key, oldest first.

    Each task keeps at most ``size`` of a key before the shuffle, so a key with very many rows stays small.
    """
    pick = Window.partitionBy(key, "_part").orderBy(*(F.desc(c) for c in order))
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    first = df.select(key, *order, value).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= size)
    some = first.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= size)
    each = F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])
    return some.groupBy(key).agg(each.alias("values"))


def top_n(df: DataFrame, key: str, order: list[str], n: int, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, in two steps: within salted parts of a key, then of the key."""
    salt = F.pmod(F.xxhash64(*order), F.lit(parts))
    first = df.withColumn("_part", salt).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).where(F.col("_n") <= n).drop("_part")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def purge(jobs: DataFrame, applications: DataFrame, bad: Column, status: str | None = None) -> DataFrame:
    """``jobs`` without the bad ones, as far as no funnel protects them; duplicates of a reason don't matter, it is one predicate."""
    applied = applications.select(F.col("job_id").alias("id")).distinct().withColumn("_applied", F.lit(True))
    kept = F.coalesce("_applied", F.lit(False)) | ~F.coalesce(bad, F.lit(False))
    if status:
        kept = kept | F.coalesce(F.col(status).isin(*PROTECTED), F.lit(False))
    return jobs.join(applied, "id", "left").where(kept).drop("_applied")


def apply_new(batch: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a batch of new applications (id, job_id, kind, sent_at): the jobs, those applied to marked so, and one score event per application."""
    applied = batch.select(F.col("job_id").alias("id")).distinct().withColumn("_applied", F.lit(True))
    marked = jobs.join(applied, "id", "left").withColumn("status", F.when(F.col("_applied"), "applied").otherwise(F.col("status"))).drop("_applied")
    points = F.when(F.col("kind") == "adapted", 2).otherwise(1)
    return marked, batch.select(F.col("sent_at").alias("at"), F.col("kind").alias("type"), points.alias("points"), F.col("id").alias("application_id"))


def single_default(resumes: DataFrame) -> DataFrame:
    """(id, name, is_default, updated_at): of rows marked default only the last updated one stays so; without any the first by id is."""
    chosen = resumes.agg(F.coalesce(F.max_by(F.when(F.col("is_default"), F.col("id")), F.when(F.col("is_default"), F.struct("updated_at", "id"))), F.min("id")).alias("_default"))
    return resumes.join(F.broadcast(chosen)).withColumn("is_default", F.col("id") == F.col("_default")).drop("_default")
