"""Language identification, quality, rules and licenses: held-out accuracy, brute force and defined edge cases."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import langid, licenses, quality, rules

EDGE = [(900, None), (901, ""), (902, " \n "), (903, "123 $$$ ---"), (904, "word " * 30_000), (904, "word " * 30_000)]
SYLLABLES = {"xx": ["ba", "lo", "mi", "ku"], "yy": ["sch", "tz", "ent", "ung"], "zz": ["éa", "ou", "ette", "que"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(prose(rng, lang, rng.randint(4, 30)) for _ in range(rng.randint(1, 6)))
        if i % 5 == 0:
            text = re.sub(r" ", rng.choice(["%%% ", " | ", "!! ", "### "]), text)
        rows.append((i, text, lang, i % 5 != 0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, score string").repartition(3)


def test_languages(spark, docs):
    rows = [(i, t, g) for i, t, g, _ in docs]
    df = frame(spark, [*rows, *((i, t, None) for i, t in EDGE)])
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.identified(df, model, runs=True).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == dict((a, c) for a, _, c in rows)[i] for i in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902, 903)] == [("und", 0.0)] * 4
    assert got[904].n_letter_words == 30_000 and got[904].lang_pred in SYLLABLES and 0 <= got[904].score <= 1
    kept = langid.accepted(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, *_ in rows} and not {900, 901, 902, 903} & {r.doc_id for r in kept.collect()}


def test_words_of_a_switched_text(spark, docs):
    model = langid.train(frame(spark, [(i, t, g) for i, t, g, _ in docs]))
    rng = random.Random(8)
    a, b = prose(rng, "xx", 12), prose(rng, "yy", 12)
    runs = langid.identified(spark.createDataFrame([(1, f"{a} {b}")], "doc_id bigint, text string"), model, runs=True).first().runs
    assert [r.lang for r in runs] == ["xx", "yy"] and abs(runs[0].to - 12) <= 1


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    emit, move, start = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, pairs = langid.marginals(emit, np.array([4, 1]), move, start, pairs=True)
    total, want = 0.0, np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(start[path[0]] + sum(emit[t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, y in enumerate(path):
            want[t, y] += p
    assert np.allclose(got[:4], want / total)
    assert np.isclose(pairs.sum(), 3)


def test_messages_cross_the_blocks_of_a_long_chain():
    rng = np.random.default_rng(2)
    emit, move, start = 3 * rng.normal(size=(700, 4)), 2 * rng.normal(size=(4, 4)), rng.normal(size=4)
    sizes = np.array([300, 1, 7, 392])
    whole, pairs = langid.marginals(emit, sizes, move, start, pairs=True, block=1000)
    for block in (1, 7, 64, 300):
        got, turns = langid.marginals(emit, sizes, move, start, pairs=True, block=block)
        assert np.allclose(got, whole) and np.allclose(turns, pairs)


def test_every_letter_of_a_word_counts():
    for n in (1, 3, 30, 300):
        words = ["a" * n + c + "z" * n for c in "bcd"]
        rows, counts = langid.features([*words, "x"], {"x": 5})
        parts = np.split(rows, np.cumsum(counts)[:-1])
        assert len({tuple(p) for p in parts[:3]}) == 3 and parts[3][-1] == langid.HASHED + 5
        for word, part in zip(words, parts):
            assert np.array_equal(langid.features([word], {})[0], part) and len(part) == 2 * len(word) + 6


def test_words_are_split_where_a_character_is_no_letter():
    assert langid.lines_of_words("x² H₂O CO₂\n½\nétage1er") == [["x", "h", "o", "co"], ["étage", "er"]]


def test_a_text_in_no_learned_language_is_rejected(spark, docs):
    rng = random.Random(14)
    other = [(2000 + i, " ".join("".join(rng.choices("абвгдежзийклмн", k=6)) for _ in range(40)), None) for i in range(5)]
    df = frame(spark, [*((i, t, g) for i, t, g, _ in docs), *other]).withColumn("a.b", F.lit(1))
    kept = langid.accepted(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in docs}


def test_no_languages_known(spark):
    df = frame(spark, [(1, "abc", None)])
    assert langid.identified(df, langid.train(df)).first().lang_pred == "und"
    assert langid.identified(df.limit(0), langid.train(df.limit(0))).collect() == []


def test_quality(spark, docs):
    df = frame(spark, [*((i, t, g) for i, t, g, _ in docs), *((i, t, None) for i, t in EDGE)])
    labels = spark.createDataFrame([*((i, int(q)) for i, _, _, q in docs), (None, 1), (5, None), (10_000, 0)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.scored(df, labels).collect()}
    held = [(i, q) for i, _, _, q in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].predicted == int(q) for i, q in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_word_vectors_match_brute_force(spark, docs):
    texts = [t for _, t, *_ in docs[:40]] + [None, "", "a", "a a a b", "x " * 200]
    terms = quality.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    index = np.zeros((quality.TERMS, quality.DIMS))
    for row, places in enumerate(quality._index()):
        for k in places:
            index[row, k % quality.DIMS] += 1 if k < quality.DIMS else -1
    want, rows = np.zeros_like(index), {r.doc_id: r.rows for r in terms.collect()}
    for own in rows.values():
        for i, row in enumerate(own):
            for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                want[row] += index[own[j]]
    size = np.linalg.norm(want, axis=1, keepdims=True)
    want /= np.where(size > 0, size, 1)
    got = quality.word_vectors(terms)
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose(quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string")), got, atol=1e-6)
    pooled = quality.pooled(got, [np.array(rows[k], np.int32) for k in range(len(texts))])
    assert np.allclose(pooled, [np.mean([want[r] for r in rows[k]], axis=0) if rows[k] else np.zeros(quality.DIMS) for k in range(len(texts))], atol=1e-6)
    a, b = quality._rows(quality._Rows(), "wonderful plain words"), quality._rows(quality._Rows(), "wonderous plain words")
    assert a[0] != b[0] and a[1:].tolist() == b[1:].tolist()


def test_counts_of_long_texts_cross_their_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 3, 70, 5, 33, 200)]
    want = quality._counts(iter(texts))
    for chunk in (1, 2, 7, 32):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        assert np.array_equal(quality._counts(iter(texts)), want)


def test_names_with_dots(spark, docs):
    df = frame(spark, [(i, t, g) for i, t, g, _ in docs]).withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(i, int(q)) for i, _, _, q in docs], "doc_id bigint, quality int")
    assert quality.accepted(df, labels).columns == df.columns and quality.accepted(df.limit(0), labels).collect() == []


def test_quality_without_labels(spark):
    df = frame(spark, [(1, "abc", None), (2, None, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.scored(df, none).collect()} == {0.5}
    assert quality.scored(df.limit(0), none).collect() == []


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {x for v in places.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)]


def test_rule_counts_match_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "c\n", "a b c d e f g h ", "é x ", "#", "\x0b", "\x1c"]) for _ in range(rng.randrange(60)))
        assert rules.measure(text)[0] == slow_measure(text), repr(text)
    assert rules.measure(None)[0] == [0] * 5


def test_path_lengths_match_brute_force():
    rng = np.random.default_rng(3)
    rows = rng.exponential(size=(500, len(rules.STATS)))
    forest = rules.Forest(rows, np.arange(500) < 400, trees=9, tree_rows=64)
    low, high = rows[:400].min(axis=0), rows[:400].max(axis=0)
    low, high = low - rules.MARGIN * (high - low), high + rules.MARGIN * (high - low)
    for row, score in zip(rows[::7], forest.score(rows[::7])):
        x = [v - h if v > h else v - w if v < w else 0.0 for v, w, h in zip(row, low, high)]
        total = 0.0
        for feature, cut, left, right, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[feature[at]] <= cut[at] else right[at]
            total += path[at]
        assert np.isclose(score, 2 ** (-total / 9 / forest.norm))
    assert rules.Forest(rows, np.zeros(500, bool), trees=2).score(rows).max() <= 1


def test_rules_judge(spark, docs):
    long = [(i, (t + " ") * 3 if i % 2 else " ".join([t] * 2), g) for i, t, g, _ in docs]
    rng = random.Random(10)
    fresh = [(i, re.sub(" ", "%%% ", prose(rng, "xx", 60)) if i % 7 == 0 else prose(rng, "xx", 60), "xx") for i in range(1000, 1200)]
    df = frame(spark, [*long, *fresh, *((i, t, None) for i, t in EDGE)])
    labels = spark.createDataFrame([(i, int(i % 7 != 0)) for i, *_ in fresh], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in rules.judged(df, labels).collect()}
    assert all(got[i].kept == (i % 7 != 0) for i, *_ in fresh)
    assert not any(got[i].kept for i, _ in EDGE) and all(got[i].base_failed for i in (900, 901, 902, 903, 904))
    assert all(got[i].n_words == slow_measure(t)[0] for i, t, _ in long)
    assert rules.judged(df.limit(0), labels).collect() == []
    assert {r.kept for r in rules.judged(frame(spark, fresh), labels.limit(0)).collect()} == {True}


def test_licenses(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"Ä text. {notice}"), (2, notice * 3), (3, "Licensed under the new Apache License Version 2.0"), (4, "the License version under"), (5, "İ Released under the MIT License. All rights reserved."), (6, "x\n" * 20_000 + notice), *EDGE]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].licenses for i in (1, 2, 3, 4, 5, 6)] == ["Apache-2.0", "Apache-2.0", "Apache-2.0", "", "MIT,proprietary", "Apache-2.0"]
    assert dict(rows)[1][got[1].from_char : got[1].to_char] == notice.rstrip(".")
    assert got[3].coverage == 1.0 and got[900].license is None and got[901].n_licenses == 0
    assert licenses.scanned(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_no_match_is_lost_to_changed_or_added_words(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for k, notice in enumerate(licenses.NOTICES):
        words = re.findall(r"\w+", notice.text.lower())
        if notice.tight:
            rows.append((10 * k, "before " + notice.text.replace(" ", ",  ") + " behind", "clash"))
            want[10 * k] = notice.name
            continue
        free = sorted((i for i, w in enumerate(words) if w not in notice.must), key=lambda i: -len(words[i]))
        less = int(len(words) * (1 - licenses.COVERAGE) + 1e-9)
        less = max(0, less - (len(words) - len(set(words))))  # a word that a notice repeats may go unaligned where much is changed
        for turn in range(6):
            gone = free[:less] if turn == 0 else rng.sample(free, min(less, len(free)))
            own = [f"zq{i}" if i in gone else w for i, w in enumerate(words)]
            for _ in range(rng.choice([0, len(words) // 2])):  # added words
                own.insert(rng.randrange(1, len(own)), f"add{rng.randrange(10**6)}")
            rows.append((10 * k + turn, " ".join([f"before{i}" for i in range(turn)] + own + ["behind"] * 3), "clash"))
            want[10 * k + turn] = notice.name
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string, license string")).collect()}
    assert all(want[i] in got[i].licenses.split(",") for i in want)


def test_versions_and_variants_are_told_apart(spark):
    gpl = licenses.NOTICES[5].text
    rows = [(1, gpl), (2, gpl.replace("version 3", "version 2")), (3, gpl.replace("General", "Lesser General")), (4, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), (5, "Released under the Apache License."), (6, "This work is licensed under a Creative Commons Attribution 4.0 International License.")]
    got = {r.doc_id: r.licenses for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "GPL-3.0", 2: "GPL-2.0", 3: "LGPL-3.0", 4: "CC-BY-SA-4.0", 5: "", 6: "CC-BY-4.0"}


def test_short_forms_and_families(spark):
    want = {
        "SPDX-License-Identifier: MIT": "MIT", "Apache License 2.0": "Apache-2.0", "see apache license, version 2.0": "Apache-2.0", "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "cc-by-nc-nd-4.0": "CC-BY-NC-ND-4.0",
        "Mozilla Public License 2.0": "MPL-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "the ISC License": "ISC", "CC0 1.0 Universal": "CC0-1.0", "GNU Affero General Public License v3.0": "AGPL-3.0",
        "All rights reserved.": "proprietary", "All rights are reserved by nobody": "", "Apache 2 helicopters": "", "mit freundlichen Grüßen": "", "GPL": "", "BSD": "", "the public license 4.0": "", "CC by 40": "",
    }
    bsd2 = next(n.text for n in licenses.NOTICES if n.name == "BSD-2-Clause" and not n.tight)
    bsd3 = next(n.text for n in licenses.NOTICES if n.name == "BSD-3-Clause" and not n.tight)
    isc, postgres = (next(n.text for n in licenses.NOTICES if n.name == x and not n.tight) for x in ("ISC", "PostgreSQL"))
    want |= {bsd2: "BSD-2-Clause", f"{bsd2}: one, two, three. {bsd3}": "BSD-3-Clause", isc: "ISC", postgres: "PostgreSQL"}
    rows = list(enumerate(want))
    got = {r.doc_id: r.licenses for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {t: got[k] for k, t in rows} == want


def test_scans_find_what_looking_at_every_place_finds():
    rng = random.Random(4)
    notices = [n for n in licenses.NOTICES if len(n.text) < 120][::3] + [n for n in licenses.NOTICES if not n.tight][:6]
    for notice in notices:
        t = licenses.Template(notice, licenses.COVERAGE)
        n = len(t.words)
        for _ in range(6):
            own = [w if rng.random() < 0.9 else rng.choice(t.words + ["zq"]) for w in t.words]
            text = rng.choices(t.words + ["other", "words"], k=rng.randint(0, 12)) + own + rng.choices(t.words + ["more"], k=rng.randint(0, 12))
            where = {}
            for i, w in enumerate(text):
                where.setdefault(w, []).append(i)
            best = 0.0
            for start in range(-n, len(text)):
                if notice.tight:
                    best = max(best, float(start >= 0 and text[start : start + n] == t.words))
                    continue
                for room in (n, 0):
                    low = max(0, start - room)
                    pairs = licenses.align(t.words, text[low : max(0, start + n + room)])
                    if pairs and {t.words[i] for i, _ in pairs}.issuperset(notice.must) and not set(notice.never) & set(text[low + pairs[0][1] : low + pairs[-1][1] + 1]):
                        best = max(best, len(pairs) / n)
            got = t.best(text, where)[0]
            assert (got >= licenses.COVERAGE) == (best >= licenses.COVERAGE), (notice.text, text)


def test_alignment_of_once_only_words_is_the_longest():
    rng = random.Random(13)
    for _ in range(300):
        a, b = (rng.sample(range(20), rng.randrange(1, 16)) for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
        assert len(licenses.align(list(map(str, a)), list(map(str, b)))) == best[-1][-1]


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(15))] for _ in "ab")
        pairs = licenses.align(a, b)
        assert all(a[i] == b[k] for i, k in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(licenses.align(list("abcde"), list("xabcdey"))) == 5
    assert [[3, 1, 2][i] for i in licenses.increasing([3, 1, 2])] == [1, 2]
