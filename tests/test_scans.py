"""Scans of feeds and channels: every stop against a plain fold, every repair by literal payloads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobloom.sources import scans

NOW = dt.datetime(2024, 1, 31, 12)


def as_of():
    return F.lit(NOW)


def item(title, link=None, guid=None, date=None, content=None, more=""):
    tags = [("title", title), ("link", link), ("guid", guid), ("pubDate", date), ("description", content)]
    return "<item>" + "".join(f"<{t}>{v}</{t}>" for t, v in tags if v is not None) + more + "</item>"


def feed(*items, head="", tail="</channel></rss>"):
    return f"{head}<rss><channel><title>Feed</title>{''.join(items)}{tail}"


PAYLOADS = [
    # payload, repair, titles
    (feed(item("A"), item("B")), "none", ["A", "B"]),
    (feed(item("A & B &nbsp; C &amp D")), "none", ["A & B   C & D"]),
    ("﻿ junk " + feed(item("A"), head='<?xml version="1.0"?>'), "none", ["A"]),
    (feed(item("A", more="<x <y/>")), "tags", ["A"]),
    (feed(item("A", more="< br >")), "tags", ["A"]),
    (feed(item("5 < 6")), "tags", ["5 < 6"]),
    (feed(item("A", more="<!-- a -- b -->")), "tags", ["A"]),
    (feed(item("<![CDATA[A <b>x</b> & y]]>", more="<x <y/>")), "tags", ["A <b>x</b> &amp; y"]),  # text of an item is still markup
    (feed(item("A\x01b")), "controls", ["Ab"]),
    (feed(item("A"), item("B"), tail=""), "items", ["A", "B"]),
    (feed(item("A"), "<item><title>B</title><descr", tail=""), "items", ["A", "B"]),
    ("<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><entry><title type='html'>E</title><id>i</id></entry></feed>", "none", ["E"]),
    (feed(), "none", []),
    ("{}", "no_feed", None),
    (" [1] ", "no_feed", None),
    ("", "no_feed", None),
    (None, "no_feed", None),
    ("plain text", "unreadable", None),
    ("<html><body>nothing</body></html>", "unreadable", None),
    ("<html>Please enable JavaScript, cloudflare</html>", "challenge", None),
]


def test_repairs(spark):
    df = spark.createDataFrame([(k, p) for k, (p, *_) in enumerate(PAYLOADS)], "k int, payload string")
    got = {r.k: (r.repair, r["items"] and [i.title for i in r["items"]] if r["items"] is not None else None) for r in scans.read_feeds(df).collect()}
    assert [got[k] for k in range(len(PAYLOADS))] == [(repair, titles) for _, repair, titles in PAYLOADS]


def test_atom_and_rss_items(spark):
    atom = """<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><entry><title>E</title><link rel='self' href='http://x/self'/><link rel='alternate' href='/jobs/1'/><id>i1</id>
    <updated>2024-01-30T00:00:00Z</updated><summary>short</summary><category term='go'/><category term='spark'/></entry></feed>"""
    rss = feed(item("T &lt;b&gt;x&lt;/b&gt;", "https://y/1", "g1", "Tue, 30 Jan 2024 03:04:05 +0200", "<![CDATA[<p>Hi</p>]]>", "<category>a</category><category> </category><category>b</category>"))
    rows = [("atom", "https://x.io/feed", atom, None, None), ("rss", "https://y.io/", rss, None, None)]
    got = {r.source: r for r in scans.scan_feeds(spark.createDataFrame(rows, "source string, url string, payload string, last_item string, seen array<string>"), as_of()).collect()}
    a, r = got["atom"], got["rss"]
    assert (a.title, a.link, a.tags, a.description, a.item_id, str(a.published_at)) == ("E", "https://x.io/jobs/1", "go, spark", "short", "i1", "2024-01-30 00:00:00")
    assert (r.title, r.link, r.tags, r.description, str(r.published_at)) == ("T x", "https://y/1", "a, b", "Hi", "2024-01-30 01:04:05")


def fold(items, last, seen, limit=50, days=30):
    """What one run takes, item by item."""
    out = []
    for place, (title, guid, age, hash_) in enumerate(items[:limit]):
        if title is None:
            continue
        if age is not None and age > days:
            break
        if last and hash_ == last:
            break
        if hash_ in seen:
            continue
        if last and guid == last:
            break
        out.append((place, title))
    return out


def test_every_stop_of_a_feed(spark):
    rng, rows, want = random.Random(3), [], {}
    schema = "source string, url string, payload string, last_item string, seen array<string>"
    plain = []
    for k in range(60):
        items = [(rng.choice([f"T{i}", f"T{i}", f"T{i}", None]), f"g{i}", rng.choice([None, 1, 2, 3, 29, 31 if rng.random() < 0.3 else 5])) for i in range(rng.choice([0, 3, 12, 55]))]
        xml = feed(*(item(t, f"https://x/{i}", g, None if a is None else (NOW - dt.timedelta(a)).strftime("%a, %d %b %Y %H:%M:%S GMT")) for i, (t, g, a) in enumerate(items)))
        plain.append((f"s{k}", items, xml))
    first = scans.scan_feeds(spark.createDataFrame([(s, "https://x/", x, None, None) for s, _, x in plain], schema), as_of(), items=60, days=9999).collect()
    hashes = {(r.source, r.place): r["hash"] for r in first}
    for s, items, xml in plain:
        with_hash = [(t, g, a, hashes.get((s, i))) for i, (t, g, a) in enumerate(items)]
        there = [i for i in with_hash if i[0]]
        last = rng.choice([None, "", "unknown", *([rng.choice(there)[1], rng.choice(there)[3]] if there else [])])
        seen = rng.choice([None, [], [i[3] for i in there if rng.random() < 0.3]])
        rows.append((s, "https://x/", xml, last, seen))
        want[s] = fold(with_hash, last, seen or [])
    got = {}
    for r in scans.scan_feeds(spark.createDataFrame(rows, schema), as_of()).collect():
        got.setdefault(r.source, []).append((r.place, r.title))
    assert {s: sorted(got.get(s, [])) for s in want} == want


def page(ids, ages, channel="c"):
    return "".join(f'<div class="tgme_widget_message js" data-post="{channel}/{i}"><div class="tgme_widget_message_text">m{i}</div>' + (f'<time datetime="{(NOW - dt.timedelta(a)).isoformat()}+00:00"></time>' if a is not None else "") + "</div>" for i, a in zip(ids, ages))


def fold_channel(pages, last_seen, limit=10, days=14):
    out, before = [], None
    for number in range(1, limit + 1):
        ids, ages = pages.get(number, ([], []))
        stop, least = False, None
        for i, a in reversed(list(zip(ids, ages))):
            least = i if least is None else min(least, i)
            if i <= (last_seen or 0) or (a is not None and a > days):
                stop = True
                break
            out.append((number, i))
        if stop or least is None or least <= 1 or (before is not None and least >= before):
            break
        before = least
    return sorted(out)


def test_every_stop_of_a_channel(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(80):
        top, pages, last = rng.randint(5, 120), {}, rng.choice([None, 0, rng.randint(1, 90)])
        for number in range(1, rng.randint(2, 14)):
            n = rng.randint(1, 9)
            ids = list(range(max(1, top - n), top + 1)) if top >= 1 else []
            old = rng.random() < 0.1
            pages[number] = (ids, [rng.choice([None, 1, 13, 15 if old else 2]) for _ in ids])
            top = top - n - 1 if rng.random() < 0.9 else top  # sometimes no further back
            if rng.random() < 0.05:
                pages[number] = ([], [])
        if rng.random() < 0.1:
            pages.pop(rng.choice(list(pages)))
        rows += [(f"c{k}", number, page(*p, channel=f"c{k}"), last) for number, p in pages.items()]
        want[f"c{k}"] = fold_channel(pages, last)
    got = {}
    for r in scans.scan_channels(spark.createDataFrame(rows, "channel string, page int, html string, last_seen long"), as_of()).collect():
        got.setdefault(r.channel, []).append((r.page, r.message_id))
    assert {c: sorted(got.get(c, [])) for c in want} == want
    assert scans.scan_channels(spark.createDataFrame([("x", 1, None, None)], "channel string, page int, html string, last_seen long"), as_of()).count() == 0


def test_checks_of_sources(spark):
    feeds = [("fine", feed(item("A")), "application/rss+xml", None), ("page", "<html></html>", "text/html", "no_feed"), ("start", feed(item("A")), "text/html", None), ("broken", "text", "text/plain", "unreadable"), ("empty", feed(), "text/xml", "no_items"), ("bare", feed("<item><link>x</link></item>"), "text/xml", "no_content"), ("null", None, None, "no_feed")]
    got = {r.source: (r.ok, r.reason) for r in scans.check_feeds(spark.createDataFrame([f[:3] for f in feeds], "source string, payload string, content_type string")).collect()}
    assert got == {s: (reason is None, reason) for s, _, _, reason in feeds}
    live, silent, undated = page([1, 2], [40, 3]), page([1], [30]), page([1], [None])
    extra = '<div class="tgme_page_extra">1 members</div>'
    probes = [("live", live, 200, "https://t.me/s/c", None), ("silent", silent, 200, "https://t.me/s/c", "silent"), ("undated", undated, 200, "https://t.me/s/c", "no_date"), ("moved", "<p>", 200, "https://else.org", "not_public"), ("gone", "<p>", 404, "https://t.me/c", "unavailable"), ("closed", extra, 302, "", None), ("empty", '<div class="tgme_channel_history">', 200, "https://t.me/s/c", "no_messages"), ("quiet", extra + '<div class="tgme_channel_history">', 200, "", None), ("odd", "<p>", 200, "https://t.me/c", None), ("null", None, None, None, "not_public")]
    got = {r.source: (r.ok, r.reason) for r in scans.check_channels(spark.createDataFrame([p[:4] for p in probes], "source string, html string, status int, final_url string"), as_of()).collect()}
    assert got == {s: (reason is None, reason) for s, *_, reason in probes}


@pytest.mark.parametrize(
    "html, want",
    [
        ('<meta property="og:title" content="Telegram: Jobs"><meta property="og:image" content="https://x/a.jpg"><div class="tgme_page_extra">12 345 members, 10 online</div>', ("Jobs", "https://x/a.jpg", 12345)),
        ('<div class="tgme_page_title"><span>Go &amp; Rust</span></div><div class="tgme_page_extra">1.2M subscribers</div>', ("Go & Rust", None, 1200000)),
        ('<meta property="og:title" content="Telegram: t.me/jobs now"><meta property="og:description" content="3,5 тыс подписчиков">', ("jobs", None, 3500)),
        ('<div class="tgme_page_photo_image x"><img src="p.png"></div><div class="tgme_page_extra">subscribers: 77</div>', (None, "p.png", 77)),
        ("<p>", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_channel_profile(spark, html, want):
    got = spark.createDataFrame([(html,)], "html string").select(scans.channel_profile(F.col("html")).alias("p")).first().p
    assert tuple(got) == want
