"""Audits of feeds: each rule met and missed by literal rows."""

import pytest
from pyspark.sql import functions as F

from jobloom.operators import feed_audit

RECORD = """struct<title:struct<value:string,raw:string,confidence:double>,company:struct<name:string,confidence:double>,salary:struct<min:bigint,max:bigint,currency:string,confidence:double>,
location:struct<city:string,country:string,confidence:double>,employment:struct<types:array<string>,confidence:double>,work_format:struct<value:string,confidence:double>,experience:struct<min_years:int,max_years:int,confidence:double>,
tech:struct<all:array<string>,confidence:double>,contacts:struct<emails:array<string>,telegram:array<string>,urls:array<string>,confidence:double>,warnings:array<string>>"""


def record(title="Go Developer", raw=None, company="Acme", pay=(None, None, "UNKNOWN"), place=(None, None), types=(), fmt="remote", years=(1, None), tech=("Go",), emails=(), telegram=(), urls=(), warnings=(), sure=0.9):
    return ((title, raw or title, sure), (company, 0.9), (*pay, 0.9), (*place, 0.9), (list(types), 0.9), (fmt, 0.9), (*years, 0.9), (list(tech), 0.9), (list(emails), list(telegram), list(urls), 0.9), list(warnings))


ALWAYS = {"employment_false_positive", "work_format_false_positive"}  # a struct's JSON is never part of a text
ACCURACY = [
    ("Go Developer", "at Acme\n", record(), set()),
    ("Go Developer for payments", "at Acme\n", record(title="Go Developer"), {"title_truncated"}),
    ("Go Developer", "at Acme\nlooking for a Tester", record(title="Tester"), {"title_from_description"}),
    ("Go Developer", "at Acme\n", record(title="Tester"), {"title_mismatch"}),
    ("Go Developer", "at Acme\n", record(title=None), {"title_missed"}),
    ("Dev", "at Acme\n", record(title=None), set()),
    ("Go Developer", "we build things", record(company="Initech Labs"), {"company_false_positive"}),
    ("Go Developer", "the Labs of tomorrow", record(company="Initech Labs"), set()),
    ("Go Developer", "nothing", record(company=None), {"company_false_positive"}),
    ("Go Developer", "Headquarters: Blue River\nURL: https://x.io", record(company="Acme"), {"company_mismatch", "company_mismatch_with_headquarters"}),
    ("Go Developer", "Headquarters: Blue River\nURL: https://x.io", record(company=None), {"company_mismatch", "company_missed_from_headquarters"}),
    ("Go Developer", "company: hq\n", record(company="HQ"), {"company_generic_name", "company_mismatch"}),  # the first line and "company" stand before a colon
    ("Go Developer", "at Acme\nsalary: 900 $", record(pay=(None, None, "USD")), {"salary_mismatch"}),
    ("Go Developer", "at Acme\nsalary: 900", record(pay=(900, None, "USD")), set()),
    ("Go Developer", "at Acme\nfrom 2011 to 2013", record(pay=(2011, 2013, None)), {"salary_year_false_positive"}),
    ("Go Developer", "at Acme\nplain", record(pay=(700, 900, "USD")), {"salary_amount_not_found"}),
    ("Go Developer", "at Acme\nlocation: Berlin", record(place=("Paris", None)), {"location_mismatch"}),
    ("Go Developer", "at Acme\n", record(place=("Paris", "France")), {"location_false_positive"}),
    ("Go Developer", "at Acme\nDjango", record(place=("Django", None)), {"location_tech_token_false_positive"}),
    ("Go Developer", "at Acme\nwrite x@y.io", record(), {"contacts_email_missed"}),
    ("Go Developer", "at Acme\nwrite x@y.io", record(emails=["x@y.io"]), set()),
    ("Go Developer", "at Acme\nwrite @someone", record(), {"contacts_telegram_missed"}),
    ("Go Developer", "at Acme\n", record(sure=0.2), {"low_confidence"}),
]
FEED = [
    ("Go Developer", "Go", record(), set()),
    ("Senior Go Developer", "", record(types=["internship"]), {"employment_wrong_type_internship"}),
    ("Intern", "", record(types=["internship"]), set()),
    ("Go Developer", "", record(company="Our Headquarters"), {"company_name_headquarters_false_positive"}),
    ("Acme Labs: Go", "", record(company="Acme"), {"company_name_truncated"}),
    ("Go", "URL: https://www.initech.com/jobs", record(), {"company_name_missed_from_url"}),
    ("Go", "URL: https://www.acme.com/jobs", record(), set()),
    ("Acme Labs: Go", "URL: https://initech.com", record(company=None), {"company_name_missed", "company_name_missed_from_url"}),
    ("Go", "in 2011", record(pay=(2011, None, "USD")), {"salary_false_positive_year"}),
    ("Go", "900 EUR", record(pay=(900, None, None)), {"salary_currency_unknown_but_mentioned"}),
    ("Go", "this is it", record(place=(None, "Iceland")), {"location_false_positive_iceland"}),
    ("Go", "Reykjavik", record(place=(None, "Iceland")), set()),
    ("Go", "", record(place=("Kafka", None)), {"location_false_positive_tech_tokens"}),
    ("Go", "", record(place=(" Benefits ", None)), {"location_false_positive_common_words"}),
    ("AI Creative Operator", "", record(title="reative", raw="AI Creative Operator"), {"title_truncated"}),
    ("Go", "", record(title=None, raw="x" * 141), {"title_too_long_or_glued"}),
    ("Go Developer in Berlin", "x About the role", record(), {"title_cut_by_about_the_role"}),
    ("Go", "mail a@b.io", record(), {"contacts_missed"}),
    ("Go", "mail a@b.io", record(telegram=["@x"]), set()),
    ("Go", "", record(urls=["https://x.io/a,", "https://x.io"]), {"contacts_urls_trailing_punct"}),
    ("Go", "fully remote", record(fmt="unknown"), {"work_format_unknown_but_mentioned"}),
    ("Go", "5 years of experience", record(years=(None, None)), {"experience_missed"}),
    ("Go", "python", record(tech=[]), {"tech_stack_missed"}),
    ("Go", "", record(warnings=["lang_unknown"]), {"parser_warnings"}),
    ("Go", "", record(sure=0.4), {"low_confidence_fields"}),
]


@pytest.mark.parametrize("cases,audit,always", [(ACCURACY, feed_audit.accuracy, ALWAYS), (FEED, feed_audit.feed_issues, set())])
def test_rules(spark, cases, audit, always):
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], f"id int, title string, description string, record {RECORD}")
    got = {}
    for r in audit(df, "info").collect():
        got.setdefault(r.id, set()).add(r.issue)
    assert [got.get(k, set()) - always for k in range(len(cases))] == [c[3] for c in cases]
    if always:
        assert all(always <= got[k] for k in range(len(cases)))


def test_nulls_severity_and_reports(spark):
    kind = f"id int, title string, description string, record {RECORD}, issue string"
    df = spark.createDataFrame([(1, None, None, record(), "x"), (2, None, "text", None, "x"), (2, None, "text", None, "x"), (3, "Go Developer", None, record(title="Tester", company="Go"), "x")], kind)
    high = feed_audit.accuracy(df, "high")
    assert {(r.id, r.issue) for r in high.collect()} == {(3, "title_mismatch")}
    counts = {r.severity: r.n for r in feed_audit.severities(high).collect()}
    assert counts == {"info": 0, "low": 0, "medium": 0, "high": 1}
    assert [(r.issue, r.n) for r in feed_audit.report(high).collect()] == [("title_mismatch", 1)]
    assert feed_audit.feed_issues(df.limit(0)).count() == 0
    many = df.sparkSession.range(30).select(F.col("id"), F.lit("a").alias("issue"))
    assert [r.id for r in feed_audit.examples(many).orderBy("id").collect()] == list(range(10))


def test_short_descriptions_take_their_page(spark):
    jobs = spark.createDataFrame([(1, "u", " short \n text "), (2, "v", "short"), (3, None, None), (4, "u", "x" * 400)], "id int, link string, description string")
    pages = spark.createDataFrame([("u", "long  page"), ("v", " "), (None, "nobody")], "url string, text string")
    assert {r.id: r.description for r in feed_audit.resolved(jobs, pages).collect()} == {1: "long page", 2: "short", 3: "", 4: "x" * 400}
