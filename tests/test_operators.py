"""Operators on small frames: deduplication, retention, funnel, ingest, feeds and streams."""

import base64
import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobloom.operators import audits, funnel, ingest, postings
from jobloom.sources import feeds
from jobloom.streaming import ingest as streams

DAY = dt.datetime(2024, 1, 10)


def test_dedup_key_and_keep_first(spark):
    rows = [(1, "s", "http://a", "t", "d"), (2, "s", "http://a", "u", "e"), (3, "s", None, "t", "d"), (4, "s", "", "t", "d"), (5, None, None, "", ""), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, s string, link string, t string, d string")
    key = postings.dedup_key(F.col("s"), F.col("link"), F.col("t"), F.col("d"), F.col("id"))
    assert sorted(r.id for r in postings.keep_first(df, key, F.col("id")).collect()) == [1, 3, 5, 6]


def test_retention_keeps_recent_and_protected(spark):
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(1, old, new, "new"), (2, None, old, "new"), (3, None, new, "new"), (4, old, old, "applied"), (5, old, old, "new"), (6, None, None, "new")], "id int, p timestamp, c timestamp, status string")
    apps = spark.createDataFrame([(5,), (5,)], "job_id int")
    got = postings.survivors(jobs, apps, "p", "c", F.lit(dt.datetime(2023, 1, 1)), "status")
    assert sorted(r.id for r in got.collect()) == [3, 4, 5, 6]
    assert sorted(r.id for r in postings.unprotected(jobs, apps, "status").collect()) == [1, 2, 3, 6]


def test_status_ring_and_latest(spark):
    jobs = spark.createDataFrame([(1, "new"), (2, "new")], "id int, status string")
    changed = postings.set_status(jobs, spark.createDataFrame([(1, "applied"), (2, "nonsense")], "id int, status string"))
    assert {r.id: r.status for r in changed.collect()} == {1: "applied", 2: "new"}
    df = spark.createDataFrame([("a", i, f"h{i}") for i in range(300)] + [("b", 1, "x")], "k string, at int, h string")
    got = {r.k: r["values"] for r in postings.ring(df, "k", ["at"], "h", 200).collect()}
    assert got == {"a": [f"h{i}" for i in range(100, 300)], "b": ["x"]}
    assert {r.k: r.h for r in postings.latest_of(df, ["k"], "at").collect()} == {"a": "h299", "b": "x"}


@pytest.mark.parametrize("query, want", [("", [1, 2, 3]), ("RED fox", [1]), ("red, cat | owl", [2, 3]), (" | ", [1, 2, 3])])
def test_search(spark, query, want):
    df = spark.createDataFrame([(1, "Red fox", None), (2, "red", "cat"), (3, None, "Owl")], "id int, a string, b string")
    assert sorted(r.id for r in postings.search(df, query, ["a", "b"]).collect()) == want


def test_updates_and_red_flags(spark):
    log = spark.createDataFrame([(1, "sent", DAY), (1, "interview", DAY + dt.timedelta(1)), (1, "offer", DAY + dt.timedelta(2)), (2, "sent", DAY)], "application_id int, status string, at timestamp")
    got = {r.application_id: r for r in funnel.apply_updates(log).collect()}
    assert (got[1].status, got[1].replied_at, got[1].interview_at, got[2].replied_at) == ("offer", DAY + dt.timedelta(1), DAY + dt.timedelta(1), None)
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 3), 5)], "id int, at timestamp, points int")  # a Wednesday
    flags = {str(r.day): r.red_flag for r in funnel.red_flags(events, "2024-01-04", "2024-01-09").collect()}
    assert flags == {"2024-01-04": False, "2024-01-05": False, "2024-01-06": True, "2024-01-07": True, "2024-01-08": True, "2024-01-09": True}
    assert [r.target for r in funnel.week_to_date(events, "2024-01-07").orderBy("day").collect()] == [6, 6, 6, 6, 6, 10, 0]


def test_source_gates(spark):
    now, soon = F.lit(DAY), DAY + dt.timedelta(1)
    rows = [(1, None, None, None), (2, soon, None, None), (3, DAY, True, None), (4, None, True, DAY), (5, None, True, soon)]
    df = spark.createDataFrame(rows, "id int, stop_until timestamp, inactive boolean, inactive_until timestamp")
    assert sorted(r.id for r in ingest.due(df, now).collect()) == [1, 4]
    s = spark.createDataFrame([(1, 9, DAY), (2, 0, None), (3, None, dt.datetime(2023, 1, 1)), (4, 0, DAY)], "id int, empty_runs int, last_scraped_at timestamp")
    assert {r.id: r.reason for r in ingest.stale(s, now).collect()} == {1: "empty_runs", 2: "never_scraped", 3: "stale"}


FEEDS = {
    "remotive": {"jobs": [{"id": 1, "url": "https://r/1", "title": "Dev", "company_name": "C", "category": "it", "tags": ["a", "a", ""], "publication_date": "2024-01-02T03:04:05", "description": "<p>x</p>"}, {"id": 2, "title": "no link"}]},
    "arbeitnow": {"data": [{"slug": "s", "title": "T", "url": "https://a/1", "remote": True, "created_at": 1700000000}]},
    "themuse": {"results": [{"id": 3, "name": "N", "locations": [{"name": "A"}, {"name": "B"}], "refs": {"landing_page": "https://m/3"}, "company": {"name": "C"}}]},
    "remoteok": [{"id": "7", "position": "P", "url": "https://o/7", "epoch": 1700000000, "salary_min": 10, "salary_max": 20}],
    "jobicy": {"jobs": [{"id": 8, "jobTitle": "J", "url": "https://j/8", "annualSalaryMin": "5", "salaryCurrency": "USD", "jobExcerpt": "short"}]},
    "findwork": {"results": [{"id": 9, "role": "R", "url": "https://f/9", "remote": False, "date_posted": "2024-01-02T00:00:00Z"}]},
}


def test_feeds_union(spark):
    frames = [feeds.mapped(spark.createDataFrame([(json.dumps(p),), ("not json",), (None,)], "value string"), name) for name, p in FEEDS.items()]
    got = {r.source_type: r for r in feeds.union(frames).collect()}
    assert set(got) == set(FEEDS)
    assert (got["remotive"].tags, got["remotive"].description, got["remotive"].company) == ("a, it", "x", "C")
    assert (got["arbeitnow"].tags, got["themuse"].location, got["remoteok"].tags, got["jobicy"].tags) == ("remote", "A, B", "10-20", "5 USD")
    assert got["jobicy"].description == "short" and len(got["findwork"].hash) == 16


def test_rss_and_telegram(spark):
    xml = "\n junk<rss><channel><item><title>A & B</title><link>https://x/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><category>c</category><description>&lt;p&gt;hi&lt;/p&gt;</description></item><item><title>T</title><link>https://x/2</link></item></channel></rss>"
    got = feeds.rss(spark.createDataFrame([(xml,)], "value string")).orderBy("link").collect()
    assert [(r.title, r.link, r.tags) for r in got] == [("A & B", "https://x/1", "c"), ("T", "https://x/2", None)]
    assert (got[0].description, str(got[0].published_at)) == ("hi", "2024-01-02 03:04:05")
    page = '<div data-post="chan/5"><div class="tgme_widget_message_text js">Hello<br/>world</div><time datetime="2024-01-02T03:04:05+00:00"></time></div><div data-post="chan/6"></div>'
    row = feeds.telegram(spark.createDataFrame([(page,)], "html string")).collect()
    assert [(r.slug, r.message_id, r.description, r.title) for r in row] == [("chan", 5, "Hello\nworld", "Hello")]


def test_devit_and_arbeitsagentur(spark):
    jobs = [{"_id": "1", "name": " Dev ", "company": "C", "jobUrl": "dev-c", "activeFrom": "2024-01-02T03:04:05Z", "cityCategory": "London", "companySize": "10", "technologies": ["Go"]}, {"_id": "2", "name": "Ops", "company": "D", "redirectJobUrl": "https://d/2", "jobUrl": "ops-d"}, {"name": "no company"}]
    page = "<script>window.__detailedJob = " + json.dumps({**jobs[0], "description": "Long text", "actualCity": "Leeds"}) + "</script>"
    other = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"job": {**jobs[1], "description": "From data"}}}}) + "</script>"
    got = {r.title: r for r in feeds.devit(spark.createDataFrame([(json.dumps(jobs),), (None,)], "value string"), spark.createDataFrame([("dev-c", page), ("ops-d", other), ("x", "<p>")], "slug string, html string")).collect()}
    assert set(got) == {"Dev", "Ops"} and (got["Dev"].location, got["Dev"].link, got["Dev"].external_id) == ("Leeds", "https://devitjobs.uk/jobs/dev-c", "devitjobs:1")
    assert got["Dev"].description == "Long text\n\nSize: 10" and got["Ops"].description == "From data" and got["Ops"].link == "https://d/2"
    pages = [{"stellenangebote": [{"refnr": "10-ä", "titel": "T", "arbeitgeber": "A", "arbeitsort": {"region": "R"}, "aktuelleVeroeffentlichungsdatum": "2024-01-02"}, {"refnr": "11", "beruf": "B"}, {"titel": "no number"}]}]
    details = [(base64.b64encode("10-ä".encode()).decode(), json.dumps({"stellenangebotsTitel": " Full ", "firma": "F", "stellenlokationen": [{"adresse": {"ort": "X"}}, {"adresse": {"ort": "Y"}}]}))]
    got = {r.external_id: r for r in feeds.arbeitsagentur(spark.createDataFrame([(json.dumps(p),) for p in pages], "value string"), spark.createDataFrame(details, "key string, value string")).collect()}
    assert (got["10-ä"].title, got["10-ä"].company, got["10-ä"].location, got["10-ä"].description) == ("Full", "F", "X, Y", "T")
    assert (got["11"].title, got["11"].company, got["11"].description, got["11"].hash) == ("B", None, "B", "11")


def test_facebook_and_compare_dumps(spark):
    one, two = "First post that is long enough to be kept here.", 'Second "post" that is long enough to be kept, too.'
    post = lambda i, t: f'"post_id":"{i}"' + '{"x":1,"message":' + json.dumps({"text": t}, separators=(",", ":")) + ',"creation_time":1700000000}'
    html = "<html>" + post(1000001, one) + post(1000002, two) + post(1000003, one) + post(1000004, "short")
    bare = '"message":' + json.dumps({"text": one}, separators=(",", ":"))
    got = feeds.facebook(spark.createDataFrame([("https://f/g/", html), ("https://f/h", bare), ("https://f/i", None)], "url string, html string")).orderBy("link").collect()
    assert [(r.link, r.description) for r in got[:2]] == [("https://f/g/posts/1000001", one), ("https://f/g/posts/1000002", two)]
    assert len(got) == 3 and got[2].link.startswith("https://f/h?jf_post=") and got[0].published_at is not None
    dump = 'junk\n===== JOB a1 =====\nMETA: {"k": 1}\n--- ORIGINAL TEXT ---\nline 1\nline 2\n--- PARSED JSON ---\n{\n  "title": {"value": "x"}\n}\n\n===== JOB b2 =====\nMETA: nothing\n--- ORIGINAL TEXT ---\nt\n--- PARSED JSON ---\n{"broken": \n'
    got = {r.id: r for r in feeds.compare_dump(spark.createDataFrame([(dump,)], "value string")).collect()}
    assert got["a1"].original == "line 1\nline 2" and json.loads(got["a1"].parsed) == {"title": {"value": "x"}} and got["a1"].meta == '{"k": 1}'
    assert (got["b2"].original, got["b2"].parsed, got["b2"].meta) == ("t", None, None)


def test_parse_issues(spark):
    kind = "salary struct<min:int,max:int,currency:string>, title struct<value:string,raw:string>, location struct<city:string,country:string>, contacts struct<urls:array<string>,emails:array<string>,telegram:array<string>>, warnings array<string>, text string, id int"
    rows = [((2013, 2014, None), (None, "#a #b " + "x" * 150), ("Django", "years"), (["http://x,"], [], []), ["salary_not_found"], "write to a@b.io, EUR", 1), ((None, None, None), ("T", "T"), (None, None), ([], [], []), [], "plain", 2)]
    df = spark.createDataFrame(rows, kind)
    found = audits.issues(df, audits.parse_issues(F.col("text")), "id")
    assert {r.issue for r in found.collect()} == set(audits.parse_issues(F.col("text"))) - {"original_text_looks_like_multi_vacancy_dump"}
    assert {r.id for r in found.collect()} == {1} and audits.totals(found, df, "id").first().rows_with_issues == 1


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"/tmp/jobloom-test-{name}-{pd.Timestamp.now().value}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_dedup_and_idempotent_append(spark, tmp_path):
    rows = [(1, "a", DAY), (2, "a", DAY), (3, "b", DAY)]
    spark.createDataFrame(rows, "id int, k string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    items = spark.readStream.schema("id int, k string, at timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.k for r in run(streams.distinct_within(items, "at", ["k"]), "first_of_key").collect()) == ["a", "b"]
    assert streams.fresh(spark.read.parquet(str(tmp_path / "in")), "at", F.lit(DAY + dt.timedelta(15))).count() == 0
    write = streams.append_new(str(tmp_path / "out"), ["k"])
    batch = spark.read.parquet(str(tmp_path / "in"))
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_state_of_sources():
    state, seen = (0, 0, "active"), []
    for _ in range(40):
        state = streams.next_state(state, 0, False)
        seen.append(state[2])
    assert (seen[1], seen[2], seen[4], seen[39]) == ("active", "warned", "paused", "disabled")
    assert streams.next_state((4, 0, "warned"), 3, False) == (0, 0, "active")
    state = (0, 0, "active")
    for _ in range(5):
        state = streams.next_state(state, 0, True)
    assert state == (0, 5, "disabled")


def test_lookups_and_feed_filters(spark):
    jobs = spark.createDataFrame([(1, None), (2, DAY), (3, None)], "id int, published_at timestamp")
    dates = spark.createDataFrame([(1, DAY), (1, DAY - dt.timedelta(1)), (2, DAY - dt.timedelta(5))], "id int, published_at timestamp")
    assert {r.id: r.published_at for r in ingest.backfill(jobs, dates, "id").collect()} == {1: DAY - dt.timedelta(1), 2: DAY, 3: None}
    listing, detail = spark.createDataFrame([("a", "short", 1), ("b", "short", 2)], "k string, text string, n int"), spark.createDataFrame([("a", "long"), ("c", "x")], "k string, text string")
    assert sorted(tuple(r) for r in ingest.enrich(listing, detail, "k").collect()) == [("a", "long", 1), ("b", "short", 2)]
    assert [r.k for r in ingest.first_seen(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "k string, n int"), "k", "n").collect()] == ["b", "a"]
    rows = [("1", "Dev", "C", "Berlin", "Python, remote", "x", DAY), ("2", "Ops", "D", "Remote", None, "kube", DAY + dt.timedelta(1)), ("3", "Dev", None, None, "go", None, None)]
    df = spark.createDataFrame(rows, "external_id string, title string, company string, location string, tags string, description string, published_at timestamp")
    ids = lambda **k: sorted(r.external_id for r in ingest.filtered(df, **k).collect())
    assert ids() == ["1", "2", "3"] and ids(tags=["PYTH", "go"]) == ["1", "3"] and ids(location="berl") == ["1"]
    assert ids(company="c") == ["1"] and ids(search="KUBE") == ["2"] and ids(remote_only=True) == ["1", "2"] and ids(limit=1) == ["2"]


def test_locale_order(spark):
    from jobloom.functions import text

    names = ["Zürich", "apple", "Äpfel", "Apple", "école", "ecole", "Éclair", "яблоко", "Арбуз", "арбуз", "éclair", None, "zebra", "ёлка", "еда"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(text.by_locale(F.col("n")), F.col("n").asc_nulls_first()).collect()]
    assert got == [None, "Äpfel", "Apple", "apple", "Éclair", "éclair", "ecole", "école", "zebra", "Zürich", "Арбуз", "арбуз", "еда", "ёлка", "яблоко"]
    row = spark.createDataFrame([(["b", "a", "B", "á", "A", "a", "ä", "b"],), ([],), (None,)], "xs array<string>").select(text.locale_sorted(F.col("xs")).alias("s")).collect()
    assert [r.s for r in row] == [["a", "A", "á", "ä", "b", "B"], [], None] and spark.range(1).select(text.locale_sorted(F.array(F.lit("a")))).schema[0].dataType.simpleString() == "array<string>"


def test_reports_are_written(spark, tmp_path):
    found = spark.createDataFrame([(k, "a", "high") for k in range(12)] + [(1, "b", "low"), (2, "b", "low")], "id int, issue string, severity string")
    audits.write_report(found, 20, "id", str(tmp_path / "r"), n=3)
    assert [r.value for r in spark.read.text(str(tmp_path / "r/text")).collect()] == ["rows: 20, with issues: 12, issues: 14", "a (12) [high]: 0, 1, 2", "b (2) [low]: 1, 2"]
    assert spark.read.json(str(tmp_path / "r/json")).count() == 14
    audits.write_report(found.limit(0), 0, "id", str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r/text")).collect()] == ["rows: 0, with issues: 0, issues: 0"]
