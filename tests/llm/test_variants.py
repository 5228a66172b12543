"""Spelling variants: words, near words, forms and roots against brute force; pivots against all choices."""

import itertools
import random
import re
import zlib
from collections import Counter

from jobloom.llm import variants

SCHEMA = "doc_id bigint, text string, lang string, word string, n bigint, `a.b` string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow(rows, damage=97):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % damage == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    n = {w: c for w, c in counts.items() if c >= 3}
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in others.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(others[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def rows():
    rng = random.Random(9)
    base = ["banana", "aaaaa", "aaaaaa", "Étage", "niño\u00e9s", "straße", "ababab", "colour"] + ["".join(rng.choices("abcé", k=rng.randint(5, 8))) for _ in range(60)]
    out = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(1, 40)):
            w = rng.choice(base)
            k = rng.randrange(len(w))
            kind = rng.randrange(6)
            words.append(w[:k] + w[k + 1 :] if kind == 0 else w[:k] + rng.choice("abx\u00ff") + w[k:] if kind == 1 else w[:k] + rng.choice("abX") + w[k + 1 :] if kind == 2 else w)
        out.append((i, rng.choice([" ", ", ", "1", "\u0101", "\n"]).join(words), "xx", None, None, "."))
    return out + [out[3]] * 3 + [(None, "banana banana", "x", None, None, None), (400, None, None, None, None, None), (401, "", None, None, None, None), (402, "z" * 3000 + " " + ("z" * 2999 + " ") * 3 + ("z" * 3000 + " ") * 7, None, None, None, None), (403, "banana " * 200_000, None, None, None, None), (404, "mmmmm " * 40 + "mmmmn " * 12 + "mmmnn " * 4, None, None, None, None)]


def got(found):
    return sorted((tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    want = slow(rows())
    assert sum(w[1] is not None for w in want) > 100 and any(w[1] and w[2] != w[1] for w in want)
    assert got(variants.grouped(docs)) == want
    assert got(variants.grouped(docs, damage=3)) == slow(rows(), 3)


def test_counts_that_are_let_go_of_are_summed(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    each = lambda **k: sorted(map(tuple, variants.words(docs, **k).collect()))
    assert each(held=3) == each()


def test_empty(spark):
    assert variants.grouped(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.grouped(spark.createDataFrame([(1, "apple apple apple", None, None, None, None)], SCHEMA)).collect()[0].root == "apple"


def test_pivots_are_the_cheapest_disjoint_ones():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        grams = [(p, rng.randint(1, 9)) for p in places]
        if places[-1] - places[0] < 2:
            continue
        best = min(grams[i][1] + grams[j][1] for i, j in itertools.combinations(range(len(grams)), 2) if grams[j][0] - grams[i][0] >= 2)
        i, j = variants.pivots(grams)
        assert grams[j][0] - grams[i][0] >= 2 and grams[i][1] + grams[j][1] == best
