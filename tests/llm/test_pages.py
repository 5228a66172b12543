"""HTML extraction, WARC and URL filters."""

import base64
import gzip
import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from jobloom.llm import html, urls, warc

PAGE = "page_id bigint, url string, html string, text string"


def test_new_pages_of_known_layouts():
    model = html.Model()
    wrong = 0
    for page in html.labelled_pages(150, seed=99):
        want = "\n".join(n.text for n in html.tree(page) if n.kept and n.tag == "#text" and n.text)
        wrong += model.extract([page.replace(" data-content=1", "")])[0] != want
    assert wrong <= 6


def test_marginals_are_those_of_all_states():
    import itertools

    model = html.Model(html.labelled_pages(30))
    nodes = html.tree("<div class=menu><a href=/>x</a></div><article><p>One, two.<p>Three.</article>")
    forest = html.Forest([nodes])
    unary = model.unary(forest)
    total, want = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        p = np.exp(sum(u * v for u, v in zip(unary, y)) + sum(model.pair[forest.kind[k], y[forest.parent[k]], y[k]] for k in range(1, len(nodes))))
        total += p
        want += p * np.array(y)
    assert np.allclose(model.marginals(forest), want / total)


def test_text_of_pages(spark):
    body = "<article><h1>A &amp; B</h1><p><b>First\n  &quot;line&quot;<br><p>Second &lt;tag&gt;&nbsp;x</p><script>var t='</p>'</script></article>"
    rows = [(1, "u", f"<nav><ul><li><a href=/a>menu</a></li></ul></nav>{body}<footer>&copy; foot</footer>", "clash"), (2, None, None, None), (3, "", "", ""), (4, "u", "<div><p" + ">" * 3, ""), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, ""), (6, "u", "<!-- never closed <p>x", ""), (1, "u", "", "")]
    got = {(r.page_id, r.n_chars > 0): r for r in html.main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[1, True].text == 'A & B\nFirst "line"\nSecond <tag> x'
    assert got[2, False].text == got[3, False].text == got[6, False].text == "" and (1, False) in got
    assert html.main_text(spark.createDataFrame([], PAGE)).collect() == []


def test_no_text_is_lost_to_elements_left_open():
    article = "<article><h1>Title of it</h1><p>A sentence that stays.</p><p>Another, longer sentence that stays too.</p></article>"
    want = "Title of it\nA sentence that stays.\nAnother, longer sentence that stays too."
    for page in (
        f"<html><head><title>x</title><meta charset=utf-8>{article}",
        f"<head><title>x</title><body><nav><a href=/>menu</a></nav>{article}",
        f"<body><noscript>{article}",
        f"<body><div><noscript><img src=x></div>{article}<noscript>y</noscript>",
        f"<body><svg><g><svg><text>inner</text></svg><text>leak</text></g></svg>{article}",
        f"<body><svg><path>{article}<svg></svg>",
        f"<body><title>{article}",
        f"<body><svg><foreignObject><div>leak</div></foreignObject></svg>{article}",
        f"<body><select><option>one<option>two</select>{article}<template><p>leak</p></template>",
    ):
        got = html.default_model().extract([page])[0]
        assert want in got and "leak" not in got and "inner" not in got, page
    many = " ".join(f"c{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))
    assert len(html.features(html.tree(f'<div class="{many}">x</div>'))[1]) > 300


def test_a_very_long_page_is_taken_whole(spark):
    body = "".join(f"<p>Sentence number {i} of the long article, with some words.</p>" for i in range(20_000))
    page = f"<nav><a href=/>menu</a></nav><article><h1>Long one</h1>{body}</article>"
    got = html.main_text(spark.createDataFrame([(1, "u", page, "clash")] * 2, PAGE)).collect()
    assert len(got) == 2 and got[0].text.count("\n") == 20_000 and got[0].text.endswith("number 19999 of the long article, with some words.")


def test_archives(spark):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1"
    rows = [(1, "http://a/", "same", ""), (2, "http://b/\r\nX: y", "same", ""), (3, "http://c/", tricky, ""), (4, None, None, ""), (5, "http://e/", "", ""), (6, "é", "ü" * 200_000, ""), (7, "http://g/", tricky, ""), (7, "http://g/", tricky, "")]
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archived(spark.createDataFrame(rows, PAGE)).collect()), key=str)
    first, want = {}, []
    for page, _, text, _ in rows:
        data = (text or "").encode()
        origin = first.setdefault(data, page)
        want.append((page, "response" if origin == page else "revisit", None if origin == page else origin, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()))
    assert got == sorted(want, key=str)
    assert warc.archived(spark.createDataFrame([(1, "u", "x", "")], PAGE), least_bytes=2).first().record_type == "response"
    assert warc.archived(spark.createDataFrame([], PAGE)).collect() == []


def test_archives_are_packed_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", [(100, 10), (1000, 2), (1 << 62, 1)])
    rows = [(i, "u", "x" * (100 + i), "clash") for i in range(5)] + [(10 + i, "u", f"small {i}", "") for i in range(25)] + [(50, "u", "y" * 5000, ""), (51, "u", "z" * 5000, "")]
    warc.write(spark.createDataFrame(rows, PAGE).coalesce(1), str(tmp_path / "w"))
    files = {k: len(list((tmp_path / "w" / f"class-{k}").glob("*.gz"))) for k in range(3)}
    assert files == {0: 3, 1: 2, 2: 2}
    got = warc.captures(warc.read(spark, str(tmp_path / "w"))).collect()
    assert sorted((r.response.page_id, r.response.payload_bytes) for r in got) == sorted((i, len(t)) for i, _, t, _ in rows)
    assert all(r.response.intact and r.request.page_id == r.metadata.page_id == r.response.page_id for r in got)


def test_a_row_without_an_id_takes_no_response_from_others(spark):
    rows = [(None, "u", "same", ""), (5, "v", "same", ""), (7, "w", "same", ""), (None, "x", "alone", "")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, PAGE)).collect()), key=str)
    assert got == sorted([(None, "revisit", 5), (5, "response", None), (7, "revisit", 5), (None, "response", None)], key=str)


def test_broken_and_deep_pages_take_linear_time():
    model = html.default_model()
    for unit in ('<a "', "<div>", "</b>", "<p><span>", "<a '>", "<a \"'>x", "<li>", "<svg>", "<!x", "<template>", "<x y='", "<b></i>"):
        page = unit * (1_000_000 // len(unit))
        began = time.process_time()
        model.extract([page])
        assert time.process_time() - began < 15, unit  # a quadratic step takes minutes


def test_tags_end_outside_of_quotes():
    texts = lambda page: [n.text for n in html.tree(page) if n.text]
    assert texts('<p title="a > b">x</p>') == ["x"] and texts("<p title='\"'>x</p>") == ["x"]
    assert texts('<p title="a>x</p><p>y</p>') == ["x", "y"]  # a lone quote: the tag ends at its first mark
    assert texts("a <!-- <p>b") == ["a"] and texts("a <![CDATA[b <c>") == ["a b <c>"] and texts("1 < 2 <b>x") == ["1 < 2 x"]


def test_deep_pages_have_the_same_marginals(monkeypatch):
    page = "<div>" * 40 + "<article><p>Some text, and more of it.</p><ul><li><a href=x>y</a></ul></article>" + "</div>" * 20 + "<footer>z</footer>"
    forest, model = html.Forest([html.tree(page), html.tree("<p>w</p>")]), html.default_model()
    want = model.marginals(forest)
    monkeypatch.setattr(html, "DEEP", 0)
    assert abs(model.marginals(forest) - want).max() < 1e-9


def test_the_query_joins_request_and_metadata_by_concurrent_to(spark, tmp_path):
    from jobloom.llm.queries import op4_warc

    spark.createDataFrame([(1, "http://a/", "<p>x</p>", ""), (2, None, None, "")], PAGE).write.parquet(str(tmp_path / "pages.parquet"))
    found = op4_warc(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("concurrent_to") >= 2
    assert {r.page_id: (r.request_uri, r.metadata_bytes) for r in found.collect()} == {1: ("http://a/", 23), 2: (None, 23)}


def test_captures_join_by_identifier(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "http://a/", "<p>x</p>", ""), (2, "http://b/", "<p>x</p>", "")], PAGE), str(tmp_path / "w"))
    rows = {r.response.page_id: r for r in warc.captures(warc.read(spark, str(tmp_path / "w"), blocks=True)).collect()}
    assert rows[1].request.record_type == "request" and rows[1].metadata.record_type == "metadata" and rows[1].response.intact
    assert bytes(rows[1].response.block).endswith(b"<p>x</p>") and rows[2].response.refers_to == rows[1].record_id
    assert bytes(rows[2].response.block).endswith(b"\r\n\r\n")


def test_parser_reads_members_and_rejects_cut_archives():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    many = b"".join(gzip.compress(record) for _ in range(3))
    assert [b for _, b in warc.parse(many)] == [b"ab\r\n"] * 3 == [b for _, b in warc.parse(record * 3)]
    for bad in (record[:54], b"WARC/1.0\r\nContent-Le", many[:-5]):
        try:
            list(warc.parse(bad))
        except ValueError:
            continue
        raise AssertionError("a cut archive was read")


def slow_verdict(url):
    host, path = urls.split(url)
    fits = [(len(k), k, v) for v, k in urls.RULES if (host == k.partition("/")[0] or host.endswith("." + k.partition("/")[0])) and path.startswith("/" + k.partition("/")[2])]
    if fits:
        return max(fits)[1:]
    listed = any(host == b.rstrip("/") or host.endswith("." + b.rstrip("/")) for b in urls.BLOCKED)
    return None, "block" if listed else "allow"


def test_urls(spark):
    cases = ["http://WWW.Example.COM/en/1?x#y", "https://m.example.com/en/2", "http://example.com/de/", "http://x.net/es/1", "http://x.net/esx", "http://doubleclick.net", "http://ad.doubleclick.net/x", "http://x.doubleclick.net.org/", "http://notexample.com/en/", "http://com/", "http://com", "ftp://net/fr/", "no scheme", "", None, "http://", "://x.net/fr/", "http://x.org?u=http://y.net/es/", "http://É.net/fr/é", "http://x.net/fr/" + "a" * 100_000]
    df = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(cases)], PAGE)
    got = {r.page_id: r for r in urls.judged(df).collect()}
    for i, u in enumerate(cases):
        assert (got[i].rule, got[i].verdict) == slow_verdict(u), u
    assert (got[0].host, got[0].path) == ("www.example.com", "/en/1") and (got[12].host, got[14].path) == ("", "")
    assert urls.judged(df.limit(0)).collect() == []
    assert urls.judged(df.union(df)).count() == 2 * len(cases)


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda *_: 5)
    (tmp_path / "list").write_bytes(urls.packed([("block", "a.com/"), ("allow", "b.com/x/")]))
    array = urls.DigestArray(str(tmp_path / "list"))
    assert [array._string(k) for k in array.find([b"b.com/x/", b"a.com/"])] == [b"b.com/x/", b"a.com/"]
    assert array.find([b"c.com/"]) == [-1] and array.lengths == [1, 3]
    (tmp_path / "none").write_bytes(urls.packed([]))
    assert urls.DigestArray(str(tmp_path / "none")).find([b"x"]) == [-1]
