"""Source divergence audit by in-mapper stripes: how far the sources of a language differ in their words.

A task folds whole documents into stripes, a hash table by language and term of (document frequency, counts by source),
and lets go of them when they get large.  Spark sorts what the tasks let go of by language and term, and stripes of one
key are merged as they pass.  Merged stripes of kept terms are stored; they alone give the totals, and then they emit
the divergences: a task gathers stripes of a language into a small matrix (terms by sources) and adds each term's share
of every pair of sources, as numbers that Spark sums.

A term that neither source of a pair has gives the same share for each such term, so only terms that one of them has
are computed, against that base.  Stripes of a language are dealt over ``PARTS`` parts; each part gets the language's
totals as rows ahead of its stripes, so nothing is collected and nothing but one language's sources is held.

All numbers are whole: probabilities are divided in three steps of a thousand, so that they are exact up to counts of
9 * 10^15.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import drop_stored, fold_batches, pieces, stored

#: Documents of a language that must have a term, and ranks of part ``term``.
DOCUMENTS, TOP = 10, 10
#: Counts (one of a term and a source) and terms that a task gathers before it lets go of its stripes: some 250 MB.
HELD = 1_500_000
#: Parts that the stripes of a language are dealt over, cells of a matrix of stripes, and sources up to which a task keeps its sums of all pairs.
PARTS, CELLS, DENSE = 64, 1_000_000, 512
#: UTF-8 bytes of terms as they count: A-Z lower-cased, a-z and all beyond ASCII as they are, spaces for all else.
_TERMS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
STRIPE = "lang string, term string, n_docs bigint, sources array<string>, counts array<bigint>"


def terms(text: str | None) -> Counter:
    """The terms of a text, as UTF-8 bytes, with their counts."""
    found: Counter = Counter()
    for piece in pieces((text or "").encode().translate(_TERMS)):
        found.update(piece.split())
    return found


def folded(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Stripes as the tasks let go of them.  The empty term's stripe has a language's documents and all its sources."""

    def make():
        stripes: dict[str, dict[bytes, list]] = {}
        cells = 0

        def let_go():
            for lang, own in stripes.items():
                every = list(own.items())
                own.clear()
                for at in range(0, len(every), 20_000):
                    some = every[at : at + 20_000]
                    ends = np.cumsum([0, *(len(by) for _, (_, by) in some)], dtype=np.int32)
                    sources, counts = [x for _, (_, by) in some for x in by], [x for _, (_, by) in some for x in by.values()]
                    yield [lang] * len(some), [t.decode() for t, _ in some], [n for _, (n, _) in some], _lists(ends, pa.array(sources, pa.string())), _lists(ends, pa.array(counts, pa.int64()))
            stripes.clear()

        def fold(cols):
            nonlocal cells
            if cols is None:
                yield from let_go()
                return
            for lang, source, text in zip(*cols):
                lang, source = lang or "", source or ""
                found = terms(text)
                found[b""] = 0
                own = stripes.setdefault(lang, {})
                for term, n in found.items():
                    stripe = own.get(term)
                    if stripe is None:
                        own[term] = [1, {source: n}]
                        cells += 2
                    else:
                        stripe[0] += 1
                        by = stripe[1]
                        if source in by:
                            by[source] += n
                        else:
                            by[source] = n
                            cells += 1
                if cells >= held:
                    yield from let_go()
                    cells = 0

        return fold

    return fold_batches(docs, ["lang", "source", "text"], make, STRIPE)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _one_a_key(rows: pa.Table) -> pa.Table:
    """Stripes in the order of their keys -> one stripe of each key."""
    same = np.ones(len(rows), bool)
    same[0] = False
    for name in ("lang", "term"):
        column = rows[name].combine_chunks()
        same[1:] &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(~same)
    if len(first) == len(rows):
        return rows
    lists = rows["sources"].combine_chunks()
    names = lists.flatten().dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    cell = np.repeat(np.cumsum(~same) - 1, sizes) * len(names.dictionary) + names.indices.to_numpy(zero_copy_only=False)
    cells, at = np.unique(cell, return_inverse=True)
    counts = np.zeros(len(cells), np.int64)
    np.add.at(counts, at, rows["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
    ends = np.searchsorted(cells, np.arange(len(first) + 1) * len(names.dictionary)).astype(np.int32)
    sources = names.dictionary.take(pa.array(cells % len(names.dictionary)))
    n_docs = np.add.reduceat(rows["n_docs"].combine_chunks().to_numpy(zero_copy_only=False), first)
    keys = rows.select(["lang", "term"]).take(pa.array(first))
    return pa.table([*keys.columns, pa.array(n_docs), _lists(ends, sources), _lists(ends, pa.array(counts))], schema=rows.schema)


def merged(stripes: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """One stripe of each language and term that ``documents`` of its documents have, and the empty term's, stored."""
    out = T._parse_datatype_string(STRIPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, open_ = to_arrow_schema(out), None
        kept = lambda rows: rows.filter(pc.or_(pc.greater_equal(rows["n_docs"], documents), pc.equal(rows["term"], ""))).to_batches()
        for part in batches:
            if not part.num_rows:
                continue
            rows = pa.Table.from_batches([part]).cast(arrow)
            rows = _one_a_key(rows if open_ is None else pa.concat_tables([open_, rows]))
            open_ = rows.slice(len(rows) - 1)  # its key may go on
            yield from kept(rows.slice(0, len(rows) - 1))
        if open_ is not None:
            yield from kept(open_)

    return stored(stripes.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, out), "stripes")


def totals(stripes: DataFrame) -> DataFrame:
    """(lang, n_terms, sources, counts): kept terms, and the sources in order with their occurrences of kept terms."""
    each = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    by_source = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("x"))
    kept = stripes.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("n_terms"))
    return by_source.join(kept, "lang").select("lang", "n_terms", F.col("x.source").alias("sources"), F.col("x.n").alias("counts"))


def shares(counts: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 V)), exact."""
    over = totals + 2 * n_terms
    left, out = counts + 2, 0
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // over, left % over
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Language:
    """What a task gathers of one language: rows (lang, source, part, item, value) of what its stripes give."""

    def __init__(self, lang: str, n_terms: int, sources: list[str], counts: list[int], first: bool, top: int, cells: int, dense: int):
        self.lang, self.v, self.names, self.top = lang, n_terms, sources, top
        self.at = {s: k for k, s in enumerate(sources)}
        self.n = np.array(counts, np.int64)
        self.most = max(1, cells // len(sources))
        self.terms: list[str] = []
        self.rows: list[tuple[list, list]] = []
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]
        self.sums = np.zeros((len(sources),) * 2, np.int64) if len(sources) <= dense else None
        self.base = shares(np.zeros(len(sources), np.int64), self.n, self.v) if self.v else self.n * 0
        self.first = first

    def rest(self, i: int) -> np.ndarray:
        """The shares of a term that neither source i nor the other has."""
        return distances(self.base[i], self.base) if self.v else self.n * 0

    def add(self, term: str, sources: list[str], counts: list[int]) -> Iterator[tuple]:
        self.terms.append(term)
        self.rows.append((sources, counts))
        if len(self.terms) >= self.most:
            yield from self.gathered()

    def pairs(self, i: int, sums: np.ndarray, both: bool = False) -> Iterator[tuple]:
        for j, x in enumerate(sums.tolist()):
            if i != j:
                yield self.lang, self.names[i], "pair", self.names[j], x
                if both:
                    yield self.lang, self.names[j], "pair", self.names[i], x

    def gathered(self) -> Iterator[tuple]:
        if not self.terms:
            return
        counts = np.zeros((len(self.terms), len(self.names)), np.int64)
        for row, (sources, ns) in zip(counts, self.rows):
            row[[self.at[s] for s in sources]] = ns
        p, names = shares(counts, self.n, self.v), self.terms
        q = shares(counts.sum(axis=1), self.n.sum(), self.v)
        self.terms, self.rows = [], []
        places = np.arange(len(self.names))
        for i in range(len(self.names)):
            have = np.flatnonzero(counts[:, i])
            if not len(have):
                continue
            # of terms that both have, the source that stands first counts the pair
            sums = np.zeros(len(self.names), np.int64)
            for some in np.array_split(have, len(have) * len(self.names) // 500_000 + 1):
                more = distances(p[some, i][:, None], p[some]) - self.rest(i)
                sums += np.where((counts[some] == 0) | (places > i), more, 0).sum(axis=0)
            if self.sums is None:
                yield from self.pairs(i, sums, both=True)
            else:
                self.sums[i] += sums
            above = have[p[have, i] > q[have]]
            values = distances(p[above, i], q[above])
            if len(values) > self.top:
                least = np.partition(values, -self.top)[-self.top]
                above, values = above[values >= least], values[values >= least]
            self.best[i] = heapq.nsmallest(self.top, self.best[i] + [(-v, names[k]) for k, v in zip(above.tolist(), values.tolist())])

    def end(self) -> Iterator[tuple]:
        yield from self.gathered()
        for i, name in enumerate(self.names):
            sums = self.n * 0 if self.sums is None else self.sums[i] + self.sums[:, i]
            if self.first:  # the share of all terms as if no source had them
                sums += self.rest(i) * self.v
            if self.first or self.sums is not None:
                yield from self.pairs(i, sums)
            yield from ((self.lang, name, "term", term, -v) for v, term in self.best[i])


def emitted(stripes: DataFrame, parts: int = PARTS, top: int = TOP, cells: int = CELLS, dense: int = DENSE) -> DataFrame:
    """(lang, source, part, item, value): what each part's stripes add to the pairs, and its best terms of each source."""
    head = totals(stripes).select("lang", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit("").alias("term"), "n_terms", "sources", "counts")
    body = stripes.where("term <> ''").select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "term", F.lit(None).cast("bigint").alias("n_terms"), "sources", "counts")
    dealt = head.unionByName(body).repartition("lang", "part").sortWithinPartitions("lang", "part", "term")
    out = T._parse_datatype_string("lang string, source string, part string, item string, value bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, rows, now = to_arrow_schema(out), [], None

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
            rows.clear()
            return made

        def collected(more):
            for row in more:
                rows.append(row)
                if len(rows) >= 20_000:
                    yield batch()

        for got in batches:
            for lang, part, term, n_terms, sources, counts in zip(*(c.to_pylist() for c in got.columns)):
                if not term:
                    if now is not None:
                        yield from collected(now.end())
                    now = _Language(lang, n_terms, sources, counts, part == 0, top, cells, dense)
                else:
                    yield from collected(now.add(term, sources, counts))
        if now is not None:
            yield from collected(now.end())
        if rows:
            yield batch()

    return dealt.mapInArrow(run, out)


def audit(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP, held: int = HELD, parts: int = PARTS, cells: int = CELLS, dense: int = DENSE) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources from each other and the terms that mark a source.

    Part ``pair``: every other source of the language; part ``term``: the ``top`` kept terms that the source has more of
    than its language.  Null languages, sources and texts count as ''; a source without terms still has its pairs; a
    language without kept terms has pairs of value 0; a language of one source has no pairs; repeated rows count each;
    very long texts are taken whole; an empty table gives no rows; other columns are ignored.
    """
    stripes = merged(folded(docs, held), documents)
    every = stored(emitted(stripes, parts, top, cells, dense).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "emitted")
    drop_stored(stripes)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return every.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, t.source AS item, sum((s.p - t.p) * (s.p - t.p) // (s.p + t.p)) AS value FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
marks AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM marks)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
