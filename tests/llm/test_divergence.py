"""Source divergence: against plain counting, with small bounds that make tasks spill, and edge rows."""

import random
import re
from collections import Counter, defaultdict

from jobloom.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, `a.b` string"


def slow(rows, documents=10, top=10):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), g or "", s or "") for _, t, g, s, *_ in rows]
    out = []
    for lang in {g for _, g, _ in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for words, g, s in docs:
            if g == lang:
                df.update(set(words))
                counts[s].update(words)
        kept = [t for t in df if df[t] >= documents]
        share = lambda c, kept=kept: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((sum(far(p[s][t], p[x][t]) for t in kept), x) for x in counts if x != s), key=lambda v: (-v[0], v[1]))
            marks = sorted(((far(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda v: (-v[0], v[1]))[:top]
            out += [(lang, s, part, x, v, k + 1) for part, found in (("pair", pairs), ("term", marks)) for k, (v, x) in enumerate(found)]
    return sorted(out)


def rows():
    rng = random.Random(5)
    words = [*"abcdefgh", "Zoë", "ZOË", "naïve", "日本", "x1y", "a_b"]
    out = [(i, " ".join(rng.choices(words[: 4 + i % 9], k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None, "hot", "hot", "hot"]), "x", "y") for i in range(260)]
    out += [out[7]] * 5 + [(None, None, "fr", "alone", None, None), (1, "", "fr", "other", None, None), (2, "no kept terms", "it", "one", None, None), (3, "word " * 60_000 + "é" * 70_000, "en", "s1", None, None)]
    return out


def got(found):
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_plain_counting(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    want = slow(rows())
    assert got(divergence.audit(docs)) == want
    # tasks that spill after a few cells, tiny matrices, sums that are not kept in the task
    assert got(divergence.audit(docs, held=7, parts=3, cells=8, dense=1)) == want
    assert got(divergence.audit(docs, documents=200, top=2)) == slow(rows(), 200, 2)


def test_empty_and_without_terms(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(1, "a", "en", "x", "", ""), (2, None, "en", "y", "", ""), (3, "b", "de", "x", "", "")]
    assert got(divergence.audit(spark.createDataFrame(few, SCHEMA))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact():
    import numpy as np

    c, n, v = [0, 1, 5, 10**15, 3 * 10**15], [10, 7, 10**9, 3 * 10**15, 4 * 10**15], 1
    assert divergence.shares(np.array(c), np.array(n), v).tolist() == [1 + 10**9 * (x + 2) // (y + 2 * v) for x, y in zip(c, n)]
