"""Language identification of words by a linear-chain conditional random field, summed up per document.

Each word of letters has affix, n-gram and lexicon features with learned weights per language; learned transitions join
neighbouring words.  Forward-backward gives each word's marginals, a document's language is that of the largest sum.
Weights and transitions are learned on code-switched chains that are joined from runs of words of a bounded sample of
documents of known language, so a switch within a line is something the model has seen.

A chain is a line, however long.  Messages cross a long line in blocks: each block's effect on a message is one matrix,
these are applied from block to block, and then all blocks are worked on at once with the messages that enter them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_batches

#: Documents of each language, chosen by the hash of their id, that the model learns from, the runs of words taken from
#: each, and the words of a run; words of over ``SAMPLE_WORD`` letters end a run (only in the sample).
SAMPLE, RUNS, RUN, SAMPLE_WORD = 300, 24, 16, 100
HASHED, LEXICON = 1 << 15, 4096
CHAINS, EPOCHS, BATCH, RATE, SEED = 6000, 3, 128, 0.15, 3
#: Words of a block of a long chain.
BLOCK = 256
_WORDS = re.compile(r"[^\W\d_]+").findall


def held_out(folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(True))


def lines_of_words(text: str | None) -> list[list[str]]:
    """The lower-cased words of letters of each line that has some, split where a character is none; a text without letters has none."""
    out = []
    for line in (text or "").lower().split("\n"):
        words = _WORDS(line)
        if not "".join(words).isalpha():
            words = [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]
        if words:
            out.append(words)
    return out


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weights, those of all words one after the other, and how many each word has: all its n-grams, its ends and its lexicon entry."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 2)
    starts = ends - size - 2
    codes = np.zeros(int(ends[-1]) + 4 if len(ends) else 4, np.int64)  # 1 word 2, the next one behind it
    inside = np.ones(len(codes) - 4, bool)
    inside[starts] = inside[ends - 1] = False
    codes[: len(inside)][inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    codes[starts], codes[ends - 1] = 1, 2

    def row(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(parts[0].shape, kind * 0x9E3779B1)
        for p in parts:
            h = (h ^ p) * 0x01000193 & 0xFFFFFFFFFF
        return 1 + (h ^ h >> 17) % (HASHED - 1)

    n = len(inside)
    two, three = row(1, codes[:n], codes[1 : n + 1]), row(2, codes[:n], codes[1 : n + 1], codes[2 : n + 2])
    front = [np.where(k <= size + 1, codes[starts + k], 0) for k in range(1, 5)]
    back = [np.where(k <= size + 1, codes[ends - 1 - np.minimum(k, size + 1)], 1) for k in range(1, 5)]
    known = np.fromiter((HASHED + lexicon[w] if w in lexicon else 0 for w in words), np.int64, len(words))
    each = [row(3, *front), row(4, *back[:2]), row(5, *back[:3]), row(6, *back), known]
    # of a word of s letters: s + 1 pairs, s triples, the ends and the lexicon
    counts = 2 * size + 1 + len(each)
    out, at = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
    place = np.arange(n) - np.repeat(starts, size + 2)
    long = np.repeat(size, size + 2)
    base = np.repeat(at, size + 2)
    pair, triple = place < long + 1, place < long
    out[(base + place)[pair]] = two[pair]
    out[(base + long + 1 + place)[triple]] = three[triple]
    for k, rows in enumerate(each):
        out[at + 2 * size + 1 + k] = rows
    return out, counts


def _joined(rows: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the words ``ids``, one after the other, and their counts."""
    own = counts[ids]
    starts = np.cumsum(counts) - counts
    return rows[np.repeat(starts[ids] - (np.cumsum(own) - own), own) + np.arange(own.sum())], own


def _summed(weights: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[rows], np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, weights.shape[1]), weights.dtype)


def _entering(p: np.ndarray, at: np.ndarray, size: np.ndarray, chain: np.ndarray, turn: np.ndarray, first: np.ndarray):
    """The messages that enter each block from before and from behind; blocks of a chain follow one another."""
    n = p.shape[1]
    ahead, behind = np.tile(first, (len(at), 1)), np.ones((len(at), n))
    many = np.flatnonzero(np.append(chain[1:] == chain[:-1], False) | np.append(False, chain[1:] == chain[:-1]))
    if not len(many):
        return ahead, behind
    effect = np.zeros((len(many), n, n))
    effect[:, np.arange(n), np.arange(n)] = p[at[many]]
    for t in range(1, int(size[many].max())):
        on = size[many] > t
        e = (effect[on] @ turn) * p[at[many][on] + t][:, None, :]
        effect[on] = e / e.max(axis=(1, 2), keepdims=True)
    place = dict(zip(many.tolist(), range(len(many))))
    for k in many.tolist():
        if k and chain[k - 1] == chain[k]:
            a = ahead[k - 1] @ effect[place[k - 1]]
            ahead[k] = a / a.sum() @ turn
    for k in many[::-1].tolist():
        if k + 1 < len(chain) and chain[k + 1] == chain[k]:
            b = turn @ (effect[place[k + 1]] @ behind[k + 1])
            behind[k] = b / b.sum()
    return ahead, behind


def marginals(emit: np.ndarray, sizes: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = False, block: int = BLOCK):
    """Forward-backward over many chains at once: emit (words, labels) and the chains' sizes, none empty -> each word's label probabilities.

    ``pairs``: also the expected number of each transition.
    """
    p = np.exp(emit - emit.max(axis=1, keepdims=True))
    turn, first = np.exp(move - move.max()), np.exp(start - start.max())
    parts = -(-sizes // block)
    chain = np.repeat(np.arange(len(sizes)), parts)
    inner = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    heads = np.cumsum(sizes) - sizes
    at, size = heads[chain] + inner * block, np.minimum(sizes[chain] - inner * block, block)
    before, after = _entering(p, at, size, chain, turn, first)
    order = np.argsort(-size, kind="stable")
    at, long, before, after = at[order], size[order], before[order].astype(p.dtype), after[order].astype(p.dtype)
    live = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")  # blocks longer than t
    ahead, behind = np.empty_like(p), np.empty_like(p)
    for t, n in enumerate(live):
        k = at[:n] + t
        a = p[k] * (before if t == 0 else ahead[k - 1] @ turn)
        ahead[k] = a / a.sum(axis=1, keepdims=True)
    behind[at + long - 1] = after
    for t in range(len(live) - 2, -1, -1):
        k = at[: live[t + 1]] + t
        b = (behind[k + 1] * p[k + 1]) @ turn.T
        behind[k] = b / b.sum(axis=1, keepdims=True)
    out = ahead * behind
    out /= out.sum(axis=1, keepdims=True)
    if not pairs:
        return out
    later = np.setdiff1d(np.arange(len(p)), heads)
    both = ahead[later - 1][:, :, None] * turn * (p * behind)[later][:, None, :]
    return out, (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


class Model:
    """Weights of a field with the given labels, learned from documents' runs of words."""

    def __init__(self, docs: list[list[list[str]]], langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = sorted(set(langs))
        n = len(self.labels)
        by = [[run for d, g in zip(docs, langs) if g == lang for run in d] for lang in self.labels]
        seen = Counter(w for d in docs for w in {w for run in d for w in run})
        self.lexicon = {w: k for k, (w, c) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if c > 2}
        self.weights, self.move, self.start, self.least_share = np.zeros((HASHED + LEXICON, n)), np.zeros((n, n)), np.zeros(n), 0.0
        steps = [np.full_like(x, 1e-3) for x in (self.weights, self.move, self.start)]
        if n < 2 or not all(by):
            return
        chains = []
        for _ in range(CHAINS):
            words, gold, lang = [], [], int(rng.integers(n))
            for _ in range(int(rng.integers(1, 5))):
                own = by[lang][int(rng.integers(len(by[lang])))][: int(rng.integers(2, RUN))]
                words += own
                gold += [lang] * len(own)
                lang = int(rng.integers(n))
            chains.append((words, gold))
        unique: dict[str, int] = {}
        ids = [np.array([unique.setdefault(w, len(unique)) for w in words]) for words, _ in chains]
        rows, counts = features(list(unique), self.lexicon)
        for _ in range(EPOCHS):
            order = rng.permutation(len(chains))
            for b in range(0, len(order), BATCH):
                part = order[b : b + BATCH]
                sizes = np.array([len(ids[k]) for k in part])
                f, own = _joined(rows, counts, np.concatenate([ids[k] for k in part]))
                gold = np.concatenate([chains[k][1] for k in part])
                likely, turns = marginals(_summed(self.weights, f, own), sizes, self.move, self.start, pairs=True)
                error = -likely
                error[np.arange(len(gold)), gold] += 1
                heads = np.cumsum(sizes) - sizes
                inner = np.setdiff1d(np.arange(len(gold)), heads)
                g = np.column_stack([np.bincount(f, np.repeat(error[:, k], own), len(self.weights)) for k in range(n)])
                g[0] = 0
                np.add.at(turns := -turns, (gold[inner - 1], gold[inner]), 1)
                for x, seen_, slope in zip((self.weights, self.move, self.start), steps, (g, turns, error[heads].sum(axis=0))):
                    seen_ += (slope / BATCH) ** 2
                    x += RATE * slope / BATCH / np.sqrt(seen_)
        self.weights = self.weights.astype(np.float32)
        #: Half the least share of learned features that a document of the sample has.
        shares = [self.share(*features([w for run in d for w in run], self.lexicon)) for d in docs if d]
        self.least_share = 0.5 * min(shares)

    def share(self, rows: np.ndarray, counts: np.ndarray) -> float:
        """How many of the features, those of the lexicon aside, have a learned weight."""
        grams = rows[(rows > 0) & (rows < HASHED)]
        return float((self.weights[grams] != 0).any(axis=1).mean()) if len(grams) else 0.0


class Labeller:
    """A model at work in a task: emissions of known words are remembered, up to a bound."""

    def __init__(self, model: Model, cache: int = 60_000):
        self.m, self.cache, self.known, self.emit = model, cache, {}, np.zeros((0, len(model.labels)), np.float32)
        self.learned = np.zeros((0, 2), np.int64)  # of each known word: features with a learned weight, and all
        self.has = (model.weights != 0).any(axis=1)

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        """For each text the marginals of its words, and the share of its features that have a learned weight."""
        chains = [lines_of_words(t) for t in texts]
        new = sorted({w for doc in chains for line in doc for w in line if w not in self.known})
        if len(self.known) + len(new) > self.cache:
            self.known, self.emit, self.learned = {}, self.emit[:0], self.learned[:0]
            new = sorted({w for doc in chains for line in doc for w in line})
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
            rows, counts = features(part, self.m.lexicon)
            self.emit = np.concatenate([self.emit, _summed(self.m.weights, rows, counts)])
            grams = (rows > 0) & (rows < HASHED)
            self.learned = np.concatenate([self.learned, _summed(np.column_stack([grams & self.has[rows], grams]).astype(np.int64), np.arange(len(rows)), counts)])
        sizes = np.array([len(line) for doc in chains for line in doc], np.int64)
        ids = np.fromiter((self.known[w] for doc in chains for line in doc for w in line), np.int64, sizes.sum())
        probable = marginals(self.emit[ids], sizes, self.m.move.astype(np.float32), self.m.start.astype(np.float32)) if len(ids) and self.m.labels else np.zeros((len(ids), len(self.m.labels)))
        cuts = np.cumsum([sum(map(len, doc)) for doc in chains])
        if not texts:
            return []
        share = [float(x[:, 0].sum() / max(1, x[:, 1].sum())) for x in np.split(self.learned[ids], cuts[:-1])]
        return list(zip(np.split(probable, cuts[:-1]), share))


def _runs(key: str, text: str) -> list[list[str]]:
    """Up to ``RUNS`` runs of up to ``RUN`` neighbouring words of a text, at places chosen by ``key``."""
    words = [w if len(w) <= SAMPLE_WORD else "" for line in lines_of_words(text) for w in line]
    starts = range(0, len(words), RUN)
    if len(starts) > RUNS:
        starts = np.sort(np.random.default_rng(zlib.crc32(key.encode())).choice(len(words) - RUN, RUNS, replace=False)).tolist()
    cut = [words[at : at + RUN] for at in starts]
    return [run for run in (r[: r.index("")] if "" in r else r for r in cut) if run]


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = 4, fold: int = 2) -> Model:
    """A model from the rows of ``docs`` with a language, outside the held-out fold: about ``sample`` documents of each language.

    Executors cut the runs of words that are learned from, so at most ``2 * sample * RUNS * RUN`` words of at most
    ``SAMPLE_WORD`` letters a language reach the driver, whatever the documents' length.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(folds, fold)).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000))
    chosen = None
    for r in counts:
        rate = F.when(F.col("lang") == r.lang, place < int(min(1.0, sample / r.n) * 1e9))
        chosen = rate if chosen is None else F.coalesce(chosen, rate)
    if chosen is None:
        return Model([], [])

    def make():
        return lambda ids, langs, texts: [ids, langs, [_runs(str(i), t) for i, t in zip(ids, texts)]]

    cut = map_batches(known.where(chosen), ["doc_id", "lang", "text"], make, "doc_id bigint, lang string, runs array<array<string>>")
    rows = sorted(cut.orderBy(place, "doc_id", "lang").limit(2 * sample * len(counts)).collect())
    return Model([r.runs for r in rows], [r.lang for r in rows])


def identified(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, n_letter_words[, runs]): each text's language and the mean probability of its words for it.

    ``und`` and score 0 if the text is null or has no letter, or if nothing could be learned.  ``runs``: the words'
    own languages as [from, to) word numbers.  Words and lines of any length are taken whole.  Repeated rows give a row
    each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language

    def make():
        labeller = Labeller(shared.value)
        labels = shared.value.labels

        def run(ids, texts):
            langs, scores, sizes, spans = [], [], [], []
            for p, _ in labeller.label(texts):
                n = len(p) if labels else 0
                mean = p.mean(axis=0) if n else np.zeros(1)
                langs.append(labels[int(mean.argmax())] if n else "und")
                scores.append(float(min(1.0, mean.max())))
                sizes.append(n)
                if runs:
                    best = p.argmax(axis=1) if n else np.empty(0, np.int64)
                    cut = np.flatnonzero(np.append(True, best[1:] != best[:-1])) if n else best
                    spans.append([{"from": int(a), "to": int(b), "lang": labels[best[a]]} for a, b in zip(cut, np.append(cut[1:], n))])
            return [ids, langs, scores, sizes] + [spans] * runs

        return run

    return map_batches(docs, ["doc_id", "text"], make, "doc_id bigint, lang_pred string, score double, n_letter_words bigint" + ", runs array<struct<from: bigint, to: bigint, lang: string>>" * runs)


def accepted(docs: DataFrame, least: float = 0.35, **parameters) -> DataFrame:
    """``docs``, with all columns whatever their names, without those of no identified language.

    Rejected are texts that are null or have no letter, those whose words agree on no language (score under ``least``),
    and those in none of the learned languages: with a smaller share of learned features than half of the least that a
    document of the sample has.  Without anything learned no row is accepted; repeated rows stay or go together; very
    long texts are taken whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, **parameters))

    def make():
        labeller = Labeller(shared.value)
        return lambda texts: [p.size > 0 and bool(p.mean(axis=0).max() >= least) and share >= shared.value.least_share for p, share in labeller.label(texts)]

    return keep_rows(docs, ["text"], make)
