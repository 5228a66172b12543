"""SimHash groups against brute force: every pair of fingerprints compared."""

import random

import numpy as np
import xxhash

from jobloom.llm import components as components_module
from jobloom.llm import simhash
from jobloom.llm.components import components

SCHEMA = "doc_id bigint, text string, fp string, extra int"


def slow_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return group


def texts():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    out = list(base)
    for b in base[:6]:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out + [base[0].upper(), base[0], "", " \n\t", "one two", "ONE  two", "É é", None, "x " * 40_000]


def test_groups_match_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: slow_fingerprint(t) for i, t, *_ in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == slow_groups(prints)


def test_long_lists_are_refined_without_losing_links(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    for x in [centre, rng.getrandbits(64)]:
        for _ in range(60):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = simhash.links(spark.createDataFrame(signed, "fp bigint"), limit=3).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 4 for r in got)
    group = slow_groups({p: p % (1 << 64) for (p,) in signed})
    roots = {r.node: r.root for r in components(spark.createDataFrame(got, "a bigint, b bigint")).collect()}
    assert all(roots.get(p, p) == g for p, g in group.items())


def test_a_link_reached_through_many_lists_is_kept(spark):
    a, low = 0x123456789ABCDEF0, 0x55  # the pair's only list of the last level lies below 525 chains of lists
    prints = [a, a ^ low, *(a ^ 1 << b for b in range(8, 64))]
    got = simhash.links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint"), limit=3).collect()
    assert {a, a ^ low} in [{r.a % (1 << 64), r.b % (1 << 64)} for r in got]


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    df = spark.createDataFrame([(1, "a b c d e", "p", 1), (2, "a b c d e", "q", 2), (None, "z", "r", 3), (3, "other words here now", "s", 4)], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]


def test_a_pair_is_retained_in_one_of_the_lists_where_it_meets():
    rng = random.Random(5)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 4)))
        differ = np.array([a ^ b], np.uint64)
        meets = [m for m in simhash._masks(0) if a & m == b & m]
        kept = [m for m in meets if simhash._retained(differ, np.array([m], np.uint64), 0)[0]]
        assert len(kept) == 1 and len(meets) >= 1
        below = [m for m in simhash._masks(kept[0]) if a & m == b & m]
        assert sum(bool(simhash._retained(differ, np.array([m], np.uint64), 1)[0]) for m in below) == 1
    far = np.array([0x0101010101000000], np.uint64)  # five bytes differ: no list has a tally of four
    assert not any(simhash._retained(far, np.array([m], np.uint64), 0)[0] for m in simhash._masks(0))


def test_odd_column_names_and_null_ids(spark):
    rows = [(1, "a b c d e", "p", 1), (2, "a b c d e", "q", 2), (None, "a b c d e", "r", 3), (None, "lone text of null", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string, component_id int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r["a.b"] for r in kept.collect())) == ["p", "r", "s"]
    got = simhash.near_duplicates(spark.createDataFrame([(None, "one two"), (None, "ONE two"), (None, None)], "doc_id bigint, text string")).collect()
    assert [r.component_id for r in got] == [None] * 3


def test_repeated_ids_give_a_row_each(spark):
    df = spark.createDataFrame([(5, "one two three"), (5, "one two three"), (5, "quite another text here"), (7, "ONE two three")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(5, 5), (5, 5), (5, 5), (7, 5)]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_quick_tally_is_that_of_all_positions():
    rng = np.random.default_rng(5)
    masks = np.array([m for m in simhash._masks(0)], np.uint64)
    differ = rng.integers(0, 1 << 63, 20_000, np.uint64) & np.bitwise_or.reduce(np.where(rng.random((20_000, 8)) < 0.35, simhash._pieces(0), np.uint64(0)), axis=1)
    mask = rng.choice(masks, len(differ))
    own = differ & mask == 0  # pairs that meet in the list share its bytes
    differ, mask = differ[own], mask[own]
    want = []
    for d, m in zip(differ.tolist(), mask.tolist()):
        shared = [b for b in range(56, -8, -8) if not d >> b & 255][:4]
        want.append(sum(255 << b for b in shared) == m)
    assert simhash._retained(differ, mask, 0).tolist() == want and 0 < sum(want) < len(want)


def test_components_write_no_table_for_edges_that_are_stars(spark, monkeypatch):
    made, store = [], components_module.stored
    monkeypatch.setattr(components_module, "stored", lambda df, what: made.append(what) or store(df, what))

    def got(edges):
        made.clear()
        return {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}

    assert got([(9, 1), (1, 5), (7, 1), (20, 21)]) == {1: 1, 5: 1, 7: 1, 9: 1, 20: 20, 21: 20}
    assert made == ["edges", "least"]
    assert got([(1, 2), (1, 3), (3, 4), (2, 4)]) == {1: 1, 2: 1, 3: 1, 4: 1}  # none of them is a star
    assert len(made) <= 10
    rng = random.Random(8)
    for _ in range(3):
        edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
        group = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in group:
            for a, b in edges:
                if a != b:
                    group[a] = group[b] = min(group[a], group[b])
        assert got(edges) == group
