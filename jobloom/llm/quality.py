"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

A term is a word or a run of punctuation, as it is written.  Each has a fixed sparse ternary index vector, and its word
vector is the sum of the index vectors of the terms around all its occurrences in all documents (its own included).  The
vectors stand in ``TERMS`` rows by a hash of the whole term: memory is the same for any number of words, and rare terms
whose hashes meet share a row.  A document is the mean of its terms' vectors.  The network learns on a bounded sample of
labelled rows outside the held-out fold and its probabilities are calibrated by a temperature fitted on rows that it
didn't learn from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_batches, stored

TERMS, DIMS, ONES, REACH = 1 << 15, 32, 4, 2
#: Labelled rows, those with the least hash of their id, that the network learns from (a fifth of them sets the temperature).
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 60, 128, 0.01, 5
#: Tokens counted at a time, so a very long text needs no more memory.
CHUNK = 1 << 16
AGAIN = 0  # the row of tokens equal to one of the two before
_TOKEN = re.compile(r"\w+|[^\w\s]+").findall


class _Rows(dict):
    """term -> its row; terms of up to 64 characters are remembered, up to a bound."""

    def __missing__(self, term: str) -> int:
        row = 1 + zlib.crc32(term.encode("utf-8", "surrogatepass")) % (TERMS - 1)
        if len(term) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[term] = row
        return row


def _rows(known: _Rows, text: str | None) -> np.ndarray:
    """The rows of a text's terms; ``AGAIN`` for one that is equal to one of the two before."""
    terms = _TOKEN(text or "")
    rows = np.fromiter(map(known.__getitem__, terms), np.int32, len(terms))
    again = np.zeros(len(terms), bool)
    for back in (1, 2):
        again[back:] |= rows[back:] == rows[: max(0, len(rows) - back)]
    rows[again] = AGAIN
    return rows


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, rows): the terms of each text as rows of the word vectors, stored."""

    def make():
        known = _Rows()
        return lambda ids, texts: [ids, [_rows(known, t) for t in texts]]

    return stored(map_batches(docs, ["doc_id", "text"], make, "doc_id bigint, rows array<int>"), "terms")


def _index() -> np.ndarray:
    """For each term ``ONES`` places of 2 * DIMS: below DIMS a +1 in that dimension, above a -1."""
    return np.random.default_rng(SEED).integers(0, 2 * DIMS, (TERMS, ONES))


def _counts(docs_rows: Iterator[np.ndarray]) -> np.ndarray:
    """(TERMS, DIMS): the sums of the index vectors around each row's occurrences, its own included."""
    index, total = np.zeros((TERMS + 1, DIMS), np.int8), np.zeros((TERMS + 1, DIMS), np.int32)  # the last row stands between texts
    for places in _index().T:
        np.add.at(index, (np.arange(TERMS), places % DIMS), np.where(places < DIMS, 1, -1))
    gap, held, size = np.full(REACH, TERMS, np.int32), [], 0

    def add(own: np.ndarray, left: np.ndarray = gap, right: np.ndarray = gap) -> None:
        """``own`` with what is around it, at most REACH terms on either side."""
        around = np.concatenate([gap, [TERMS], left, own, right, gap])
        skip = REACH + 1 + len(left)
        up_to = np.cumsum(index[around[skip - REACH - 1 : skip + len(own) + REACH]], axis=0, dtype=np.int32)
        near = up_to[2 * REACH + 1 :] - up_to[: -2 * REACH - 1]
        order = np.argsort(own)
        mine = own[order]
        starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        total[mine[starts]] += np.add.reduceat(near[order], starts, axis=0)

    for rows in docs_rows:
        if len(rows) > CHUNK:
            for at in range(0, len(rows), CHUNK):
                add(rows[at : at + CHUNK], rows[max(0, at - REACH) : at], rows[at + CHUNK : at + CHUNK + REACH])
        elif len(rows):
            held += [rows, gap]
            size += len(rows) + REACH
            if size > CHUNK:
                add(np.concatenate(held))
                held, size = [], 0
    if held:
        add(np.concatenate(held))
    return total[:TERMS]


def word_vectors(terms: DataFrame) -> np.ndarray:
    """(TERMS, DIMS), each of length 1: counted over all rows of ``terms`` (text, or rows of ``counted``).

    Each task adds up what it reads, Spark adds up the tasks, and TERMS rows reach the driver.
    """
    is_text = "rows" not in terms.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Rows()

        def each():
            for batch in batches:
                for x in batch.column(0):
                    yield _rows(known, x.as_py()) if is_text else np.empty(0, np.int32) if x.values is None else x.values.to_numpy(zero_copy_only=False)

        net = _counts(each())
        some = np.flatnonzero(net.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(net[some, d]) for d in range(DIMS))], names=["term", *(f"d{d}" for d in range(DIMS))])

    parts = terms.select("text" if is_text else "rows").mapInArrow(count, "term bigint, " + ", ".join(f"d{d} int" for d in range(DIMS)))
    summed = parts.groupBy("term").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS))).toPandas().to_numpy()
    out = np.zeros((TERMS, DIMS))
    out[summed[:, 0].astype(int)] = summed[:, 1:]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


class Network:
    """tanh layer, then a logistic unit; inputs are standardised by the training rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
        n = x.shape[1]
        w = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t, self.w, self.heat = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, w, 1.0
        for _ in range(EPOCHS):
            shuffled = rng.permutation(used)
            for at in range(0, len(shuffled), BATCH):
                k = shuffled[at : at + BATCH]
                z = self._standard(x[k])
                h = np.tanh(z @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[k]) / len(k)
                back = d[:, None] * w[2] * (1 - h * h)
                t += 1
                for i, g in enumerate((z.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    w[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(held):
            logit, truth = self.logit(x[held]), y[held]
            loss = lambda heat: np.logaddexp(0, np.where(truth > 0.5, -logit, logit) / heat).mean()
            self.heat = min(np.geomspace(0.5, 8, 61), key=loss)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._standard(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.heat, -30, 30)))


def pooled(vectors: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """The mean word vector of each text, given as rows; zeros for a text without terms."""
    out = np.zeros((len(texts), DIMS))
    for k, rows in enumerate(texts):
        for at in range(0, len(rows), CHUNK):
            out[k] += vectors[rows[at : at + CHUNK]].sum(axis=0, dtype=np.float64)
        out[k] /= max(1, len(rows))
    return out


class Scorer:
    """What ``fit`` gives: word vectors and a network, both of a fixed size; without a network every score is 0.5."""

    def __init__(self, vectors: np.ndarray, network: Network | None):
        self.vectors, self.network = vectors, network

    def score(self, texts: list[np.ndarray]) -> list[float]:
        """The probability of each text, given as rows."""
        return self.network.score(pooled(self.vectors, texts)).tolist() if self.network else [0.5] * len(texts)


def held_out(folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> Scorer:
    """A scorer from all of ``docs`` (doc_id and text, or rows of ``counted``) and the labels of at most ``sample`` rows outside the held-out fold."""
    own = "rows" if "rows" in docs.columns else "text"
    vectors = word_vectors(docs.select(own))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where("quality in (0, 1)").select("doc_id", "quality").where(~held_out(folds, fold)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def make():
        known = _Rows()
        return lambda quality, texts: [quality, list(pooled(shared.value, [_rows(known, t) for t in texts] if own == "text" else [np.array(t, np.int32) for t in texts]).astype(np.float32))]

    labelled = docs.select("doc_id", own).join(F.broadcast(known), "doc_id")  # at most ``sample`` rows are broadcast
    rows = sorted((r.quality, r.v) for r in map_batches(labelled, ["quality", own], make, "quality int, v array<float>").collect())
    if len({q for q, _ in rows}) < 2:
        return Scorer(vectors, None)
    return Scorer(vectors, Network(np.array([v for _, v in rows], np.float64), np.array([q for q, _ in rows], np.float64)))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): the probability that a text's quality label is 1.

    Labels are learnt only from rows whose crc32(doc_id as text) mod ``folds`` isn't ``fold``; rows without a doc_id
    count as held out.  Null and empty texts have the zero vector and a score like any other; labels with a null
    doc_id or quality, or of documents that aren't there, are ignored; without labels of both kinds every score is 0.5.
    Terms are counted over whole texts of any length, once; repeated rows give a row each; an empty table gives no rows;
    other columns are ignored.
    """
    terms = counted(docs)
    scorer = docs.sparkSession.sparkContext.broadcast(fit(terms, labels, folds, fold, sample))

    def make():
        return lambda ids, rows: [ids, scorer.value.score([np.array(r, np.int32) for r in rows])]

    out = map_batches(terms, ["doc_id", "rows"], make, "doc_id bigint, score double")
    return out.select("doc_id", held_out(folds, fold).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``docs``, with all columns whatever their names, without those predicted to be of low quality.

    Without labels of both kinds every row stays; null and empty texts have a score like any other; repeated rows stay
    or go together; an empty table gives no rows.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels, **parameters))

    def make():
        known = _Rows()
        return lambda texts: [s >= 0.5 for s in scorer.value.score([_rows(known, t) for t in texts])]

    return keep_rows(docs, ["text"], make)
