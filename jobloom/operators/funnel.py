"""Application funnel: counts, comparison of resume versions, follow-ups, score events and their calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MANUAL = ["touch", "call", "post", "artifact"]
FOLLOWUP_DAYS = 3


def _reached(*statuses: str, at: Column | None = None) -> Column:
    hit = F.col("status").isin(*statuses)
    return hit if at is None else hit | at.isNotNull()


def _when(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def stats(applications: DataFrame) -> DataFrame:
    """One row of funnel counts, in one pass."""
    replied = _reached("replied", "interview", "offer", at=_when(applications, "replied_at"))
    met = _reached("interview", "offer", at=_when(applications, "interview_at"))
    total, adapted = F.count("*"), F.count_if(F.col("kind") == "adapted")
    return applications.agg(total.alias("total"), adapted.alias("adapted"), (total - adapted).alias("template"), F.count_if(replied).alias("replied"), F.count_if(met).alias("interviews"), F.count_if(F.col("status") == "offer").alias("offers"), F.count_if(F.col("status") == "rejected").alias("rejected"))


def manual_counts(events: DataFrame) -> DataFrame:
    """One row with the number of events of each manual type, 0 where there is none."""
    return events.agg(*(F.count_if(F.col("type") == t).alias(t) for t in MANUAL))


def by_resume(applications: DataFrame) -> DataFrame:
    """Sent, replied and interviews for each resume version that is known."""
    replied = _reached("replied", "interview", "offer", at=_when(applications, "replied_at"))
    met = _reached("interview", "offer", at=_when(applications, "interview_at"))
    return applications.where("resume_version is not null").groupBy("resume_version").agg(F.count("*").alias("sent"), F.count_if(replied).alias("replied"), F.count_if(met).alias("interviews"))


def followups(applications: DataFrame, jobs: DataFrame, as_of: Column, days: int = FOLLOWUP_DAYS) -> DataFrame:
    """Applications without an answer that were sent more than ``days`` before ``as_of``, with their posting, oldest first."""
    open_ = applications.where(F.col("status").isin("pending", "sent") & (F.col("sent_at") < as_of - F.expr(f"INTERVAL {days} DAYS")))
    if "replied_at" in applications.columns:
        open_ = open_.where("replied_at is null")
    return open_.join(jobs.select(F.col("id").alias("job_id"), "title", "company"), "job_id", "left").orderBy("sent_at", "id")


def apply_updates(updates: DataFrame) -> DataFrame:
    """From a log of (application_id, status, at) the state of each application.

    The first answer and the first interview count; an interview is an answer too; the last status stands.
    """
    first = lambda *s: F.min(F.when(F.col("status").isin(*s), F.col("at")))
    return updates.groupBy("application_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), first("replied", "interview", "offer", "rejected").alias("replied_at"), first("interview").alias("interview_at"))


def by_day(events: DataFrame) -> DataFrame:
    """Points and events of each day, in the session's time zone."""
    return events.groupBy(F.to_date("at").alias("day")).agg(F.sum("points").alias("points"), F.count("*").alias("events"))


def target(day: Column) -> Column:
    """The day's target: 6 on weekdays, 10 on Saturday, none on Sunday."""
    return F.when(F.dayofweek(day) == 1, 0).when(F.dayofweek(day) == 7, 10).otherwise(6)


def _days(events: DataFrame, first: Column, last: Column) -> DataFrame:
    return events.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))


def week_to_date(events: DataFrame, as_of: str) -> DataFrame:
    """Each day from Monday to ``as_of`` with its points (0 where there is no event), target and the sum so far."""
    now = F.lit(as_of).cast("date")
    monday = F.date_trunc("week", now).cast("date")
    days = _days(events, monday, now)
    mine = by_day(events.where((F.col("at") >= monday) & (F.col("at") < F.date_add(now, 1))))
    return days.join(mine, "day", "left").select("day", F.coalesce("points", F.lit(0)).alias("points"), target(F.col("day")).alias("target"), F.coalesce(F.sum("points").over(Window.orderBy("day")), F.lit(0)).alias("so_far"))


def red_flags(events: DataFrame, first: str, last: str) -> DataFrame:
    """Each day with whether the two days before it, Sundays left out, had no points; never if there is no event at all."""
    days = _days(events, F.date_sub(F.lit(first).cast("date"), 3), F.lit(last).cast("date")).join(by_day(events), "day", "left").select("day", F.coalesce("points", F.lit(0)).alias("points"))
    work = days.withColumn("sunday", F.dayofweek("day") == 1)
    # a Sunday takes the two working days before it as well: its own 0 points are counted out by the rank
    rank = F.sum(F.when(F.col("sunday"), 0).otherwise(1)).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    ranked = work.withColumn("rank", F.coalesce(rank, F.lit(0)))
    done = ranked.where(~F.col("sunday")).select((F.col("rank") + 1).alias("k"), F.col("points").alias("p"))
    two = ranked.join(F.broadcast(done), (F.col("k") <= F.col("rank")) & (F.col("k") > F.col("rank") - 2), "left").groupBy("day", "points").agg(F.sum("p").alias("before"))
    return two.where(F.col("day") >= F.lit(first).cast("date")).select("day", "points", F.coalesce(F.col("before") == 0, F.lit(False)).alias("red_flag"))


def next_checkpoint(days: DataFrame, checkpoints: list[tuple[str, str]]) -> DataFrame:
    """For each day the first checkpoint (label, date) on or after it, else the last one: a fold over a short literal list."""
    ordered = sorted(checkpoints, key=lambda c: c[1])
    pick = F.lit(ordered[-1][0])
    for label, date in reversed(ordered[:-1]):
        pick = F.when(F.col("day") <= F.lit(date).cast("date"), label).otherwise(pick)
    return days.select("*", pick.alias("checkpoint"))
