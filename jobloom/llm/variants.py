"""Spelling variants of a corpus' words, by pivotal grams: an exact join of words that one edit makes of each other.

Words are counted in the tasks that read the documents (a table of words, let go of when it gets large) and summed by
Spark.  The bigrams of all words have one order, rare ones first.  A word's head are its bigrams up to the third in
that order, every place of the third included; two of the head that share no letter, and are the rarest together by
dynamic programming, are its pivots.  One edit leaves at least one of two such pivots as it was.  So of two near words
the one whose head ends earlier in the order has a pivot that stands in the other's head, at a place that the edit
allows: the same one if the edit is behind it, and moved by the difference of the lengths if it is before it.

Heads are posted under (bigram, place, length) and pivots are looked up there, under the five (place, length) that one
edit can give.  What meets is verified in the join: letters' parities first, then the edit distance.  No list is cut,
and no pair that fails leaves the join.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fold_batches, map_batches, pieces, rows_in_slices, stored

#: Of every ``DAMAGE`` pairs of a document and a word, one loses a letter (the contract's stand-in for misspellings).
DAMAGE = 97
#: Least code points and occurrences of a word, and how many times more frequent its form must be.
LENGTH, OCCURRENCES, RATIO = 5, 3, 2
#: Words that a task gathers before it lets go of their counts (some 60 MB).
HELD = 400_000
#: Latin-1 bytes of words as they count: A-Z lower-cased, a-z and U+00C0 to U+00FF as they are, spaces for all else.
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def runs(text: str | None) -> Counter:
    """The letter runs of a text, as Latin-1 bytes, with their counts."""
    found: Counter = Counter()
    for piece in pieces((text or "").encode("latin-1", "replace").translate(_LETTERS)):
        found.update(piece.split())
    return found


def damaged(start: int, run: bytes, damage: int = DAMAGE) -> bytes:
    """The run as the contract has it: without one letter where the checksum says so.  ``start``: that of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    k = h % len(run)
    return run if h % damage else run[:k] + run[k + 1 :]


def words(docs: DataFrame, damage: int = DAMAGE, length: int = LENGTH, occurrences: int = OCCURRENCES, held: int = HELD) -> DataFrame:
    """(word, n): the distinct words of all texts with their occurrences, stored."""

    def make():
        counts: dict[bytes, int] = {}

        def let_go():
            rows = [(w.decode("latin-1"), n) for w, n in counts.items()]
            counts.clear()
            return rows_in_slices(rows)

        def fold(cols):
            if cols is None:
                yield from let_go()
                return
            for doc_id, text in zip(*cols):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs(text).items():
                    if len(run) >= length:
                        word = damaged(start, run, damage)
                        if len(word) >= length:
                            counts[word] = counts.get(word, 0) + n
                if len(counts) >= held:
                    yield from let_go()

        return fold

    each = fold_batches(docs, ["doc_id", "text"], make, "word string, n bigint")
    return stored(each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences), "words")


def gram_counts(known: DataFrame) -> dict[str, int]:
    """Words that have each bigram.  90 letters make 8,100 bigrams at most, so this is small for any corpus."""

    def make():
        counts: Counter = Counter()

        def fold(cols):
            if cols is None:
                yield from rows_in_slices(list(counts.items()))
                return
            for word in cols[0]:
                counts.update({word[i : i + 2] for i in range(len(word) - 1)})

        return fold

    rows = fold_batches(known, ["word"], make, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: r.n for r in rows}


def pivots(grams: list[tuple[int, int]], picks: int = 2, size: int = 2) -> tuple[int, ...]:
    """Places in ``grams`` ((position, cost), by position) of ``picks`` that share no letter and cost least together."""
    none = (float("inf"), ())
    best = [[(0, ())] * (len(grams) + 1)] + [[none] * (len(grams) + 1) for _ in range(picks)]
    free = 0  # grams that end before the i-th begins
    for i, (at, cost) in enumerate(grams):
        while grams[free][0] + size <= at:
            free += 1
        for k in range(1, picks + 1):
            before, chosen = best[k - 1][free]
            best[k][i + 1] = min(best[k][i], (before + cost, (*chosen, i)))
    return best[picks][-1][1]


def _key(rank: int, at: int, length: int) -> int:
    return rank << 48 | (at & 0xFFFFFF) << 24 | length & 0xFFFFFF  # what is longer shares keys: more is compared, nothing lost


def posted(known: DataFrame) -> DataFrame:
    """(word, n, parity, last, heads, probes) of each word: keys to post it under and keys to look up, stored."""
    counts = gram_counts(known)
    ranks = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    shared = known.sparkSession.sparkContext.broadcast((ranks, counts))

    def make():
        ranks, counts = shared.value

        def one(word: str):
            grams = [(ranks[word[i : i + 2]], i) for i in range(len(word) - 1)]
            last, length = sorted(grams)[2][0], len(word)
            head = [(rank, i) for rank, i in grams if rank <= last]
            chosen = [head[k] for k in pivots([(i, counts[word[i : i + 2]]) for _, i in head])]
            shifts = ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1))
            bits = 0
            for c in word:
                bits ^= 1 << (ord(c) & 63)
            return bits - (1 << 64 if bits >> 63 else 0), last, [_key(r, i, length) for r, i in head], [_key(r, i + at, length + more) for r, i in chosen for at, more in shifts if i + at >= 0]

        def run(names, ns):
            found = list(map(one, names))
            return names, ns, *(map(list, zip(*found)) if found else ([],) * 4)

        return run

    return stored(map_batches(known, ["word", "n"], make, "word string, n bigint, parity bigint, last int, heads array<bigint>, probes array<bigint>"), "posted")


def links(posts: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: every two words that one inserted, deleted or replaced code point makes of each other."""
    side = lambda keys, x: posts.select(F.explode(keys).alias("key"), *(F.col(c).alias(f"{x}_{c}") for c in ("word", "n", "parity", "last")))
    fits = (F.col("p_last") <= F.col("h_last")) & (F.bit_count(F.col("p_parity").bitwiseXOR(F.col("h_parity"))) <= 2) & (F.col("p_word") != F.col("h_word"))
    met = side("probes", "p").join(side("heads", "h"), "key").where(fits & (F.levenshtein("p_word", "h_word", 1) == 1))
    low = F.col("p_word") < F.col("h_word")
    pick = lambda this, that, c: F.when(low, F.col(f"{this}_{c}")).otherwise(F.col(f"{that}_{c}"))
    return met.select(pick("p", "h", "word").alias("a"), pick("p", "h", "n").alias("a_n"), pick("h", "p", "word").alias("b"), pick("h", "p", "n").alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) -> (word, root), stored: where the chain of forms ends.  Chains halve in each round."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_stored(now)
        now = moved
        if now.where("moved").isEmpty():
            return now


def grouped(docs: DataFrame, damage: int = DAMAGE, length: int = LENGTH, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with its more frequent near word and the end of that chain.

    ``form`` is the near word of largest n (ties: the smallest by code points) if it is ``ratio`` times as frequent at
    least, else null; then form_n is null too and the root is the word itself.  Null and wordless texts have no words;
    a null doc_id counts as an empty one; repeated rows count each; very long texts and words are taken whole; an empty
    table gives no rows; other columns are ignored.  ``length`` must be 4 at least (a head has three bigrams).
    """
    if length < 4:
        raise ValueError("words need 4 code points at least")
    known = words(docs, damage, length, occurrences)
    posts = posted(known)
    both = stored(links(posts), "links")
    drop_stored(posts)
    near = both.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("w")).alias("other")).unionByName(both.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("w")).alias("other")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("other"))
    joined = known.join(best, "word", "left").withColumn("fits", -F.col("other.n") >= ratio * F.col("n"))
    out = stored(joined.select("word", F.when(F.col("fits"), F.col("other.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), -F.col("other.n")).alias("form_n")), "forms")
    drop_stored(both, known)
    ends = roots(out.where("form is not null")).select("word", "root")
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
