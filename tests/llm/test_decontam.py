"""Decontamination against a search of every window at every place."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from jobloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, owners in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= owners
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    pool = ["the", "of", "Ärger", "x1", "naïve", "cat", "DOG", "sun", "a", "b"]
    items = [(k, " ".join(rng.choices(pool, k=rng.choice([3, 9, 10, 11, 25])))) for k in range(12)] + [(20, ""), (21, None), (22, "!!"), (23, "the the the the the the the the the the the the")]
    docs = []
    for d in range(40):
        w = rng.choices(pool, k=rng.randrange(0, 60))
        if d % 3 == 0:
            w += (rng.choice(items)[1] or "").split() + rng.choices(pool, k=5)
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(50, None), (51, ""), (52, "the " * 30_000), (53, items[0][1].upper())]
    got = decontam.contamination(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, phrase string"), spark.createDataFrame(items, "item_id bigint, text string"), block=7).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == slow(docs, items)
    assert {r.doc_id: r.n_near for r in got} == slow_near(docs, items)
    assert all(r.n_near >= (1 if r.contaminated else 0) for r in got)


def slow_near(docs, items, slop=5):
    texts = {d: words(t) for d, t in docs}
    counts = Counter(x for w in texts.values() for x in w)
    windows = {tuple(w[i : i + 10]) for w in (words(t) for _, t in items) if w for i in range(max(1, len(w) - 9))}
    out = dict.fromkeys(texts, 0)
    for win in windows:
        n, at, rare = min((counts[x], k, x) for k, x in enumerate(win))
        for d, w in texts.items():
            for pos, x in enumerate(w):
                if x == rare and n:
                    start = pos - at
                    out[d] += set(win) <= set(w[max(0, start - slop) : max(0, start + len(win) + slop)])
    return out


def test_empty_tables_null_and_repeated_ids(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "d"), (1, "d e"), (1, "d e")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.contaminated) for r in decontam.contamination(docs, none).collect()) == [(0, 1, False), (0, 2, False), (1, 1, False), (1, 2, False), (1, 2, False)]
    assert decontam.contamination(docs.limit(0), none).collect() == []
    items = spark.createDataFrame([(1, "d e"), (None, "c")], "item_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontam.contamination(docs, items).collect()) == [(0, 1, 1), (0, 2, 0), (1, 1, 0), (1, 2, 2), (1, 2, 2)]
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("key", F.lit(2))
    kept = decontam.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == 2


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "red so green and blue"), (2, "red " + "x " * 30 + "green blue"), (3, "blue x x green x red")], "doc_id bigint, text string")
    assert {r.doc_id: (r.n_near, r.contaminated) for r in decontam.contamination(docs, items).collect()} == {1: (1, False), 2: (0, False), 3: (1, False)}


def test_main_path_has_no_python(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    plan = decontam.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
