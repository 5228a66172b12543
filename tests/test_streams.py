"""Streams over several runs and batches: states, rings with expiry, dated tables; windows counted in UTF-16."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from jobloom.functions import patterns
from jobloom.streaming import ingest as streams

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def source(spark, folder, batches, schema):
    """Files of one batch each, as a stream that takes one file at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_states_of_several_runs_keep_one_row_a_source(rocks, tmp_path):
    schema = "source string, at timestamp, found int, blocked boolean"
    runs = lambda days: [("a", DAY + dt.timedelta(d), 0, False) for d in days]
    stream = source(rocks, tmp_path / "in", [runs([1, 2])], schema)
    first = streams.finished(streams.source_states(stream), str(tmp_path / "out"), "update", ["source"]).collect()
    assert [(r.source, r.empty_runs, r.status) for r in first] == [("a", 2, "active")]
    stream = source(rocks, tmp_path / "in", [[], runs([3]) + [("b", DAY, 1, False)]], schema)
    again = streams.finished(streams.source_states(stream), str(tmp_path / "out"), "update", ["source"]).collect()
    assert {(r.source, r.empty_runs, r.status) for r in again} == {("a", 3, "warned"), ("b", 0, "active")}


def test_ring_is_an_exact_fold_and_goes_after_its_time(rocks, tmp_path):
    rng, schema = random.Random(6), "source string, h string, at timestamp"
    batches, when = [], DAY
    for _ in range(6):
        when += dt.timedelta(hours=6)
        batches.append([(rng.choice("ab"), f"h{rng.randrange(9)}", when + dt.timedelta(seconds=k)) for k in range(40)])
    late = when + dt.timedelta(days=30)
    batches += [[("a", "h1", late), ("z", "x", late)], [("z", "y", late + dt.timedelta(days=30))], [("b", h, late + dt.timedelta(days=31)) for h in ("h1", "h2")]]
    stream = source(rocks, tmp_path / "in", batches, schema)
    out = streams.finished(streams.ring_distinct(stream, "source", "h", size=4, at="at", keep="10 days"), str(tmp_path / "out"))
    got = sorted((r.source, r.h, r["at"]) for r in out.collect())
    want, rings, newest = [], {}, {}
    for rows in batches:
        for s, h, at in sorted(rows, key=lambda r: (r[2], r[1])):
            ring = rings.setdefault(s, [])
            if h not in ring:
                want.append((s, h, at))
                ring.append(h)
                del ring[:-4]
            newest[s] = at
        top = max(r[2] for r in rows)
        for s in list(rings):  # twenty days: ten that items may be late, ten that a source may be silent
            if newest[s] + dt.timedelta(days=10) <= top - dt.timedelta(days=10):
                del rings[s]
    assert got == sorted(want)
    assert sum(s == "b" and at > late for s, _, at in want) == 2  # its ring had gone


def test_dated_table(spark, tmp_path):
    schema = "k string, at timestamp, v int"
    rows = lambda *xs: spark.createDataFrame([(k, None if d is None else DAY + dt.timedelta(d), v) for k, d, v in xs], schema)
    table = streams.DatedTable(spark, str(tmp_path / "t"), ["k"], "at")
    shape = rows(("a", 0, 1)).schema
    assert table.last() == -1 and table.rows(shape).count() == 0 and table.cursor() is None
    table.append(rows(("a", 0, 1), ("a", 0, 1), ("b", 1, 2), ("n", None, 5)), 0, spark.createDataFrame([("message", 7)], "what string, at int"))
    table.append(rows(("z", 0, 9)), 0)  # the same batch again
    assert table.cursor().first()["at"] == 7
    new = table.new_rows(rows(("b", 1, 3), ("c", 1, 4)))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan) and "2024-01-02" in plan.replace("19724", "2024-01-02")
    assert re.search(r"ReadSchema: struct<k:string>", plan)
    table.append(rows(("b", 1, 3), ("c", 1, 4), ("n", None, 6)), 1)
    table.append(rows().limit(0), 2)
    assert sorted((r.k, r.v) for r in table.rows(shape).collect()) == [("a", 1), ("b", 2), ("c", 4), ("n", 5)] and table.last() == 2
    rows(("x", 0, 1)).withColumn("day", F.to_date("at")).write.partitionBy("day").parquet(str(tmp_path / "t/rows/batch=3"))  # a batch that failed before its cursor
    assert table.rows(shape).count() == 4
    table.append(rows(("y", 0, 1)), 3)
    assert sorted(r.k for r in table.rows(shape).collect()) == ["a", "b", "c", "n", "y"]


def test_windows_are_counted_in_utf16(spark):
    rng = random.Random(2)
    texts = ["", "cat", "😀cat😀", "a😀b cat c😀d", "😀" * 10 + "cat" + "😀" * 10] + ["".join(rng.choice("ab😀é ") for _ in range(rng.randint(0, 20))) + "cat" + "".join(rng.choice("ab😀é ") for _ in range(20)) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", patterns.around(F.col("t"), "cat", 5, 7).alias("w"))
    got = {r.k: r.w for r in df.collect()}
    for k, t in enumerate(texts):
        units = t.encode("utf-16-le")
        at = t.find("cat")
        if at < 0:
            assert got[k] is None
            continue
        place = len(t[:at].encode("utf-16-le"))
        cut = units[max(0, place - 10) : place + 6 + 14]
        assert got[k] == cut.decode("utf-16-le", "ignore"), t
