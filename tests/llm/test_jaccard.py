"""Near-duplicates of the pipeline against brute force: every pair of shingle sets compared."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from jobloom.llm import jaccard, simhash

SCHEMA = "doc_id bigint, text string, sid string"


def slow_kept(rows):
    """Ids that stay: the least of each group of pairs at 5 words and 0.8."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group, changed = {i: i for i in sets}, True
    near = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    return {i for i in sets if group[i] == i}


def texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=60)
    out = []
    for _ in range(10):
        base = rng.choices(words, k=rng.randint(80, 250))
        out.append(base)
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(1, 8)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(w)
    out += [passage + rng.choices(words, k=rng.choice([5, 12, 14, 16, 100])) for _ in range(60)]
    out += [out[0], ["one"], ["ONE"], [], [], "a b c d e f g h i".split(), "a b c d e f g h i j".split()]
    return list(enumerate(map(" ".join, out)))


def test_stage_keeps_what_brute_force_keeps(spark):
    rows = texts()
    df = spark.createDataFrame([*((i, t, "x") for i, t in rows), (None, rows[0][1], "x"), (None, None, "x")], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    assert got.count(None) == 2 and {i for i in got if i is not None} == slow_kept(rows)


def test_one_similar_text_joins_texts_that_are_apart(spark):
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(40):  # 4 words changed: 0.82 with the base, 0.67 with each other
        rows.append((i + 1, " ".join(f"c{i}" if k in {8 + i, 58 + i, 108 + i, 158 + i - 10} else w for k, w in enumerate(base))))
    assert slow_kept(rows) == {0}
    assert {r.doc_id for r in jaccard.keep_one(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()} == {0}


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fingerprints_of_all_sets_meet_in_the_index_of_op1(spark, monkeypatch):
    found = {jaccard.set_id(s): s for _, t in texts() if len(s := jaccard.shingles(t))}
    prints = {i: simhash.of_digests(s) for i, s in found.items()}
    pairs = [tuple(r) for r in jaccard.by_fingerprint(spark.createDataFrame([(i, fp - (fp >> 63 << 64)) for i, fp in prints.items()], "sid bigint, fp bigint")).collect()]
    assert pairs and all(a < b and (prints[a] ^ prints[b]).bit_count() <= 4 for a, b in pairs)

    def grouped(pairs):
        group = {i: i for i in prints}
        for _ in prints:
            for a, b in pairs:
                group[a] = group[b] = min(group[a], group[b])
        return group

    assert grouped(pairs) == grouped([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert simhash.of_digests(jaccard.shingles("a b c d e f g")) == simhash.fingerprint("a b c d e f g", 5)

    met, index = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *a: met.append({r.fp % (1 << 64) for r in distinct.collect()}) or index(distinct, *a))
    corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([(i, t, "") for i, t in texts()], SCHEMA), "")
    assert len(met) == 1 and set(prints.values()) <= met[0]


def test_pairs_of_long_texts_that_share_many_shingles_meet_once(spark, monkeypatch):
    rows, last = [], []
    base = [f"b{k}" for k in range(3000)]
    for i in range(12):  # too long for the parity bits; under 0.8 of each other
        rows.append((i, " ".join(w if (k // 60 * 7 + i * i) % 5 else f"c{i}_{k}" for k, w in enumerate(base))))
    ordered = jaccard._ordered

    def told(pairs, a, b):
        if "bits" in pairs.select("p.*").columns:
            last.extend(pairs.select(F.least("p.sid", "q.sid"), F.greatest("p.sid", "q.sid")).collect())
        return ordered(pairs, a, b)

    monkeypatch.setattr(jaccard, "_ordered", told)
    kept = jaccard.keep_one(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id for r in kept} == slow_kept(rows)
    assert 0 < len(last) <= 4 * len(set(last))
