"""Quality rules: base counts per document and an isolation forest over rule statistics.

The statistics are plain ratios.  What labelled good rows show of each, from the least to the most of them and a little
more, is its allowance; the forest looks at how far a row goes beyond, so rows within all allowances meet in one place and any excess sets a row
apart.  Allowances and forest are fitted on a bounded sample of labelled rows: each tree splits ``TREE_ROWS`` of them at
random, and a short mean path means an anomaly.  The threshold is calibrated on the scores of all labelled rows, counted
by score bin in Spark.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

TREES, TREE_ROWS, SEED = 128, 256, 7
#: Labelled rows, those with the least hash of their id, that the forest is fitted on.
SAMPLE = 8192
#: By how much of the good rows' range an allowance is wider on either side.
MARGIN = 0.1
#: How many missed bad rows a rejected good row counts for, in the calibration.
GOOD_WEIGHT = 10
BINS = 4096

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Per word: characters of n_symbols, bars, exclamation and question marks, words in repeated windows, words like the one
#: before, characters of words; the share of upper-case characters and of repeated lines.
STATS = ["symbols", "bars", "marks", "repeated", "again", "word_chars", "upper", "dup_lines"]
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def _runs(words: list[bytes], window: int) -> tuple[int, int]:
    """Words in windows that occur twice or more, and words equal to the one before."""
    n = len(words)
    if n < 2:
        return 0, 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    again = int((ids[1:] == ids[:-1]).sum())
    if n <= window or len(known) == n:
        return 0, again
    # exact window numbers by doubling: pairs of numbers are numbered anew
    length, code = 1, ids
    while length < window:
        step = min(length, window - length)
        both = code[: len(code) - step] * (int(code.max()) + 1) + code[step:]
        code, length = np.unique(both, return_inverse=True)[1], length + step
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), again


def measure(text: str | None, window: int = 8) -> tuple[list[int], list[float]]:
    """The base counts and the statistics of one text; a null text has no words."""
    text = text or ""
    words = text.encode().split()  # bytes are split at the six ASCII white space characters only
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    repeat, again = _runs(words, window)
    counts = [symbols, text.count("|"), text.count("!") + text.count("?"), repeat, again, chars]
    stats = [x / max(n, 1) for x in counts] + [len(_UPPER.findall(text)) / max(chars, 1), dup / max(len(lines), 1)]
    return [n, chars, symbols, dup, repeat], stats


class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), threshold, children, path length at a leaf.

    ``good``: which rows set the allowances; all of them if none is good.
    """

    def __init__(self, rows: np.ndarray, good: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        known = rows[good] if good.any() else rows
        more = MARGIN * (known.max(axis=0) - known.min(axis=0))
        self.low, self.high = known.min(axis=0) - more, known.max(axis=0) + more
        rows = self.beyond(rows)
        self.norm = self._mean_path(min(tree_rows, len(rows)))
        self.trees = [self._grow(rows[rng.permutation(len(rows))[:tree_rows]], rng) for _ in range(trees)]

    def beyond(self, x: np.ndarray) -> np.ndarray:
        """How far each statistic is above or, negative, below its allowance."""
        return np.maximum(x - self.high, 0) - np.maximum(self.low - x, 0)

    @staticmethod
    def _mean_path(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, child, path = [], [], [], []
        top = int(np.ceil(np.log2(max(len(rows), 2))))
        todo = [(rows, 0, -1)]
        while todo:
            own, depth, parent = todo.pop()
            here = len(feature)
            if parent >= 0:
                child[parent].append(here)
            span = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if depth < top and len(own) > 1 else []
            feature.append(-1), cut.append(0.0), child.append([]), path.append(depth + self._mean_path(len(own)))
            if len(span):
                k = int(rng.choice(span))
                at = rng.uniform(own[:, k].min(), own[:, k].max())
                feature[here], cut[here] = k, at
                todo += [(own[own[:, k] > at], depth + 1, here), (own[own[:, k] <= at], depth + 1, here)]
        left = np.array([c[0] if c else -1 for c in child])
        right = np.array([c[1] if c else -1 for c in child])
        return np.array(feature), np.array(cut), left, right, np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores of rows of statistics, 0 to 1: near 1 for the shortest paths."""
        x, total = self.beyond(x), np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (open_ := feature[at] >= 0).any():
                k = at[open_]
                at[open_] = np.where(x[open_, feature[k]] <= cut[k], left[k], right[k])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.norm, 1e-9))


def measured(docs: DataFrame, window: int = 8) -> DataFrame:
    """(doc_id, the base counts, the statistics): one row per row of ``docs``."""

    def make():
        def run(ids, texts):
            base, stats = zip(*(measure(t, window) for t in texts)) if texts else ([], [])
            return [ids, *(list(c) for c in zip(*base)), list(stats)]

        return run

    return map_batches(docs, ["doc_id", "text"], make, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", stats array<double>")


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """From (bin, quality, rows) the score above which a row is rejected: the middle of the best cuts; 1 if nothing is labelled bad."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, quality, n in bins:
        (good if quality else bad)[b] += n
    if not bad.sum():
        return 1.0
    wrong = GOOD_WEIGHT * (good.sum() - np.cumsum(good)) + np.cumsum(bad)  # if bins up to here are kept
    best = np.flatnonzero(wrong == wrong.min())
    return (best[0] + best[-1] + 2) / 2 / BINS


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, base counts, base_failed, anomaly, kept): ``anomaly`` is the forest's score, ``kept`` false for what fails a base rule or scores above the threshold.

    Null and empty texts have no words and fail the base rule of 20 words.  Labels with a null doc_id or quality, or for
    documents that aren't there, are ignored; with no labelled rows only the base rules decide.  Whole texts of any
    length are counted; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
    """
    rows = stored(measured(docs), "measured")
    known = rows.join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", "stats")
    fit = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).select("stats", "quality").collect()
    schema = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in BASE), "anomaly double"])
    if not fit:
        return _verdict(rows.withColumn("anomaly", F.lit(0.0)), 1.0)
    forest = rows.sparkSession.sparkContext.broadcast(Forest(np.array([r.stats for r in fit]), np.array([r.quality == 1 for r in fit])))  # of a fixed size

    def scores(stats):
        return forest.value.score(np.array(stats).reshape(-1, len(STATS))).tolist()

    binned = map_batches(known, ["quality", "stats"], lambda: lambda q, stats: [q, [int(s * BINS) for s in scores(stats)]], "quality int, bin int")
    cut = threshold([(r.bin, r.quality, r.n) for r in binned.groupBy("bin", "quality").agg(F.count("*").alias("n")).collect()])
    scored = map_batches(rows, ["doc_id", *BASE, "stats"], lambda: lambda *c: [*c[:-1], scores(c[-1])], schema)
    return _verdict(scored, cut)


def _verdict(scored: DataFrame, cut: float) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), "anomaly", (~failed & (F.col("anomaly") <= cut)).alias("kept"))
