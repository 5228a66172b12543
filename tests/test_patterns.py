"""Patterns' quick forms against the plain ones, and the given plain text against every match."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.functions import extract, gate, patterns, places, titles

GATE = {n: getattr(gate, n) for n in ("VACANCY", "UNAVAILABLE", "APPLY", "SECTIONS", "RESUME_TITLE", "RESUME_WORD", "RESUME_TAG", "INTRO", "FIRST_PERSON", "SEEKING", "STRUCTURE", "SALARY", "ROLE", "PROMO", "RESUME_TEXT", "FAKE_PLACE")}
PIECES = sorted({x for p in GATE.values() for x in re.findall(r"[a-zа-яё]{2,}", p)} | set(" \n.,:#@-_1\xa0") | {"12 000", "10 usd", "a@b.io", "x", "я", "я ux designer", " ", "hi all", "job opening"})


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=40, max_size=60))
def test_quick_forms_match_the_plain_ones(spark, texts):
    df = spark.createDataFrame([(t.lower(),) for t in texts], "t string")
    columns = []
    for name, p in GATE.items():
        columns += [F.rlike("t", F.lit(patterns.java(p))).alias(f"{name}_plain"), patterns.has(F.col("t"), p).alias(f"{name}_has"), patterns.likely(F.col("t"), p, gate.SIGNS.get({"APPLY": "apply", "SALARY": "salary", "FIRST_PERSON": "person"}.get(name, ""))).alias(f"{name}_likely")]
    for row in df.select("t", *columns).collect():
        for name in GATE:
            assert row[f"{name}_plain"] == row[f"{name}_has"] == row[f"{name}_likely"], (name, row.t)


@pytest.mark.parametrize("pattern, want", [(r"\b(hiring|we\s+are\s+looking|канал(ы|ов)?)\b", ["hiring", "looking", "канал"]), (r"#\s*(cv|resume)", ["#"]), (r"(\d+|x)", None), (r"\b(bott?|x\s+yy)\b", ["bot", "yy"])])
def test_signs(pattern, want):
    assert patterns.signs(pattern) == want


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(patterns.likely(F.col("t"), gate.ROLE).alias("x")).first().x is None


RULES = {f"{kind}_{k}": p for kind, rules in (("employment", extract.EMPLOYMENT), ("benefits", extract.BENEFITS), ("shifts", extract.SHIFTS), ("languages", extract.LANGUAGES), ("role", titles.ROLES), ("level", titles.LEVELS), ("region", places.REGIONS)) for k, p in rules}
RULES |= {n: getattr(extract, n) for n in ("REMOTE", "HYBRID", "ONSITE", "NIGHT", "WEEKENDS", "FLEXIBLE", "TEST_TASK")} | {n: getattr(places, n) for n in ("RELOCATION", "VISA")} | {n: getattr(titles, n) for n in ("SECTION_WORD", "NO_TITLE", "FEED_LINE")}


def test_parts_match_the_plain_expressions(spark):
    """Each alternative of each rule by itself, in capitals, inside of other letters and behind other words."""
    written = sorted({re.sub(r"\(\?:|[()^$]|\[\^.*?\]|[|].*", "", re.sub(r"\\s[+*]", " ", re.sub(r"\\b", "", alt))).replace("?", "").replace("\\", "") for p in RULES.values() for alt in patterns._parts(p)} | {"ſtock", "reſt", "oᲃ", "eu only", "US  only", "united states only", "on call", "visa", "интернship", "interns"})
    texts = [f(x) for x in written for f in (str, str.upper, lambda x: f"a{x}я", lambda x: f"я {x.replace(' ', chr(160))}.")]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string").withColumn("low", patterns.lowered(F.col("t")))
    got = df.select("t", *(F.struct(F.rlike("t", F.lit(patterns.java(p))).alias("a"), patterns.met(F.col("low"), p).alias("b")).alias(n) for n, p in RULES.items())).collect()
    assert [(r.t, n) for r in got for n in RULES if r[n].a != r[n].b] == []
    assert sum(any(r[n].a for r in got) for n in RULES) > 0.9 * len(RULES)


def test_white_space_is_that_of_javascript(spark):
    listed = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    chars = spark.range(0x10000).where("id not between 55296 and 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    for p in (r"\A\s\z", r"\A[\s]\z", r"\A(?![^\s])(?:.|\s)\z"):
        found = chars.where(F.rlike("c", F.lit(patterns.java(p))))
        assert sorted(r.id for r in found.collect()) == sorted(listed), p
    assert [r.x for r in spark.createDataFrame([("\xa0a-b&c 　",)], "t string").select(F.regexp_replace("t", patterns.java(r"[\s&.-]"), "").alias("x")).collect()] == ["abc"]


@pytest.mark.parametrize("field", ["employment", "work_format", "experience", "benefits", "languages", "schedule"])
def test_hits_are_computed_once(spark, field):
    """Before, each use of a field's hits in its result searched the text again."""
    body = F.array(F.struct(F.lit("body").alias("name"), F.array("t").alias("lines")))
    plan = spark.createDataFrame([("x",)], "t string").select(getattr(extract, field)(body).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_join(") <= 10, plan.count("array_join(")
