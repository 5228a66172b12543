"""The given tables in the shapes of the job-posting model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as postings: the first line is the title, the text the description."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), F.col("source").alias("source_id"), "lang")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as applications: one per order, sent on its date."""
    status = F.when(F.col("o_orderstatus") == "O", "sent").when(F.col("o_orderstatus") == "P", "replied").otherwise("offer")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("job_id"),
        status.alias("status"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "adapted").otherwise("template").alias("kind"),
        F.col("o_orderpriority").alias("resume_version"),
        F.col("o_orderdate").alias("sent_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as the postings that applications refer to."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("company"), F.col("c_nationkey").alias("source_id"))


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as score events; a type's points are by its place in POINTS, others give 1."""
    kinds = {"click": "touch", "view": "post", "purchase": "artifact", "signup": "call"}
    kind, points = F.col("event_type"), F.lit(1)
    for k, name in kinds.items():
        kind = F.when(F.col("event_type") == k, name).otherwise(kind)
        points = F.when(F.col("event_type") == k, POINTS[name]).otherwise(points)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("type"), points.cast("bigint").alias("points"), F.col("user_id").alias("application_id"))


#: Points of each score type (fixed values).
POINTS = {"adapted": 2, "template": 1, "touch": 3, "call": 8, "interview": 8, "post": 5, "artifact": 4}
EVENT_SQL = """(SELECT event_id AS id, ts AS happened, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'post' WHEN 'purchase' THEN 'artifact' WHEN 'signup' THEN 'call' ELSE event_type END AS type,
 CAST(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 ELSE 1 END AS BIGINT) AS points, user_id AS application_id FROM events)"""
APPLICATION_SQL = """(SELECT o_orderkey AS id, o_custkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'sent' WHEN 'P' THEN 'replied' ELSE 'offer' END AS status,
 CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'adapted' ELSE 'template' END AS kind, o_orderpriority AS resume_version, o_orderdate AS sent_at FROM orders)"""
JOB_SQL = "(SELECT c_custkey AS id, c_name AS title, c_mktsegment AS company, c_nationkey AS source_id FROM customer)"
POSTING_SQL = "(SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description, source AS source_id, lang FROM documents)"


# What the recorded parses hold by a document's number: the texts that stand before a description, and the fields.
_BEFORE = ["Headquarters: Acme Labs\nURL: https://www.northwind.io/jobs\n", "Company: Blue River\nSalary: 5,000 $\n", "Location: Berlin, Germany\nabout the role\n", "Senior lead, full-time, remote\n", "5 years of experience with python and docker\n", "apply to jobs@acme.io or @acme_jobs, paid in EUR\n", "", ""]
_RECORD = {
    "title": "named_struct('value', CASE doc_id % 5 WHEN 0 THEN left(title, 6) WHEN 2 THEN title WHEN 3 THEN substr(body, 101, 40) WHEN 4 THEN concat('Another ', lang) END, 'raw', title, 'confidence', CAST((doc_id % 10) / 10.0 AS DOUBLE))",
    "company": "named_struct('name', CASE doc_id % 7 WHEN 0 THEN 'Headquarters' WHEN 1 THEN 'Acme' WHEN 2 THEN 'Blue River' WHEN 3 THEN source WHEN 4 THEN 'Northwind' END, 'confidence', CAST(0.6 AS DOUBLE))",
    "salary": "named_struct('min', CAST(CASE doc_id % 6 WHEN 0 THEN 2013 WHEN 1 THEN 5000 WHEN 2 THEN 777 END AS BIGINT), 'max', CAST(CASE doc_id % 6 WHEN 0 THEN 2014 WHEN 1 THEN 6000 END AS BIGINT), 'currency', CASE WHEN doc_id % 6 = 1 THEN 'USD' ELSE 'UNKNOWN' END, 'confidence', CAST(0.6 AS DOUBLE))",
    "location": "named_struct('city', CASE doc_id % 9 WHEN 0 THEN 'Django' WHEN 1 THEN 'Berlin' WHEN 3 THEN 'years' END, 'country', CASE doc_id % 9 WHEN 1 THEN 'Germany' WHEN 2 THEN 'Iceland' END, 'confidence', CAST(0.6 AS DOUBLE))",
    "employment": "named_struct('types', CASE WHEN doc_id % 4 = 3 THEN array('internship') ELSE array() END, 'confidence', CAST(0.6 AS DOUBLE))",
    "work_format": "named_struct('value', CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'remote' END, 'confidence', CAST(0.6 AS DOUBLE))",
    "experience": "named_struct('min_years', CASE WHEN doc_id % 2 = 1 THEN 3 END, 'max_years', CAST(NULL AS INT), 'confidence', CAST(0.6 AS DOUBLE))",
    "tech": "named_struct('all', CASE WHEN doc_id % 3 = 0 THEN array() ELSE array('Python') END, 'confidence', CAST(0.6 AS DOUBLE))",
    "contacts": "named_struct('emails', CASE WHEN doc_id % 4 = 1 THEN array('a@b.io') ELSE array() END, 'telegram', CAST(array() AS array<string>), 'phones', CAST(array() AS array<string>), 'urls', CASE WHEN doc_id % 6 = 0 THEN array('https://x.io/a,', 'https://x.io/b') ELSE array() END, 'confidence', CAST(0.6 AS DOUBLE))",
    "warnings": "CASE WHEN doc_id % 5 = 0 THEN array('lang_unknown') ELSE array() END",
}


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as postings with a recorded parse (id, title, description, record), right ones and wrong ones by the document's number."""
    before = F.element_at(F.array(*map(F.lit, _BEFORE)), (F.col("doc_id") % len(_BEFORE) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    line = F.substring_index("body", "\n", 1)
    title = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("Acme Labs: "), F.substring(line, 1, 60))).otherwise(F.substring(line, 1, 80))
    named = d.withColumn("title", title).withColumn("description", F.concat(before, F.col("body")))
    return named.select(F.col("doc_id").alias("id"), "title", "description", F.struct(*(F.expr(x).alias(n) for n, x in _RECORD.items())).alias("record"))


RECORDED_SQL = """(WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS body FROM documents), t AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'Acme Labs: ' || left(split_part(body, chr(10), 1), 60) ELSE left(split_part(body, chr(10), 1), 80) END AS title FROM d)
SELECT doc_id AS id, title, ([{before}])[doc_id % 8 + 1] || body AS description,
 CASE doc_id % 5 WHEN 0 THEN left(title, 6) WHEN 2 THEN title WHEN 3 THEN substr(body, 101, 40) WHEN 4 THEN 'Another ' || lang END AS title_value, (doc_id % 10) / 10.0 AS sure,
 CASE doc_id % 7 WHEN 0 THEN 'Headquarters' WHEN 1 THEN 'Acme' WHEN 2 THEN 'Blue River' WHEN 3 THEN source WHEN 4 THEN 'Northwind' END AS company,
 CASE doc_id % 6 WHEN 0 THEN 2013 WHEN 1 THEN 5000 WHEN 2 THEN 777 END AS low_pay, CASE doc_id % 6 WHEN 0 THEN 2014 WHEN 1 THEN 6000 END AS high_pay, CASE WHEN doc_id % 6 = 1 THEN 'USD' ELSE 'UNKNOWN' END AS money,
 CASE doc_id % 9 WHEN 0 THEN 'Django' WHEN 1 THEN 'Berlin' WHEN 3 THEN 'years' END AS city, CASE doc_id % 9 WHEN 1 THEN 'Germany' WHEN 2 THEN 'Iceland' END AS country,
 doc_id % 4 = 3 AS intern, doc_id % 3 = 0 AS no_format, doc_id % 2 = 0 AS no_years, doc_id % 3 = 0 AS no_tech, doc_id % 4 <> 1 AS no_email, doc_id % 6 = 0 AS bad_url, doc_id % 5 = 0 AS warned FROM t)""".format(before=", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _BEFORE))
