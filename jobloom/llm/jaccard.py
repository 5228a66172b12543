"""Near-duplicates by SimHash with an exact check: every two texts whose sets of five-word shingles reach a Jaccard similarity of 0.8.

The sets' SimHash fingerprints meet first, in op1's byte-position index with its count filter (``simhash.links``), and
what links there is checked by whole sets.  A fingerprint can't promise that similarity: at 0.8 some 10 of 64 bits
differ, so most pairs near it share no four bytes.  The exact way for the rest is an index over shingles, in which only
pairs that aren't joined yet are compared.

The shingles of all texts have one order, and a text is posted under the first ``n - ceil(0.8 n) + 1`` of its n.
Two sets that reach 0.8 share one of these (prefix filter), so an inverted index over them meets every such pair.
Any order does; this one puts shingles that are frequent in a bounded sample last, so a passage that many texts
share makes no long lists.

A candidate must also pass two exact bounds: the overlap that is left behind its place in both prefixes, and the
parity bits, 512 of a set, each the parity of the shingles that fall there (where two sets' bits differ, so do the
sets, so the number of different bits is at most the number of different shingles).  What passes is compared by whole
sets.  Only groups are wanted, so a list's members are first compared with two of them, and after that only pairs that
aren't joined yet are compared, all of them; a pair that shares many posted shingles is then taken
where it shares none of the few open ones before.  Shingles and sets stand as 64-bit digests.

Postings are shuffled once: they are sorted by shingle, and what no other set has is dropped as they pass.  What passes
is compared twice, first by as many parity bits as the set has shingles, which leaves little but true pairs, then by
whole sets.  Both are made from the texts again where they are compared and stored nowhere: of each pair one set is the
centre, that of more pairs, and the others go to where it is, at most ``FAN`` to one copy of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .common import drop_stored, map_batches, small, stored, values, without
from .components import components, grouped

WORDS, SIMILARITY, SEED, BITS = 5, 0.8, 42, 512
#: Documents whose shingles are counted for the order, and the most shingles that are put last.
SAMPLE, FREQUENT = 10_000, 200_000
#: Rows of ids (16 bytes each), and of sets' sizes and bits (some 100 bytes each), up to which joins broadcast them; more are
#: shuffled.  A broadcast takes more than that, and the driver builds it in its heap.
IDS, NODES = 1_000_000, 100_000
#: Postings before a set's place in a list, by which pairs are known that have met in an earlier list.
BEFORE = 4
#: Sets that are compared with one copy of a centre.
FAN = 256


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct digests of a text's word shingles; a text of fewer words is one shingle, a wordless one has none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: max(1, len(tokens) - words + 1)].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[x:y], SEED) for x, y in zip(first, last)), np.uint64, len(first)).view(np.int64))


def set_id(found: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def parity(found: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Signed 64-bit numbers: the parity of how many shingles fall on each of ``bits`` (a power of two) bits."""
    u, out = found.view(np.uint64), np.zeros(bits >> 6, np.uint64)
    place = u & np.uint64(bits - 1)
    np.bitwise_xor.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def frequent(docs: DataFrame, words: int = WORDS, sample: int = SAMPLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than three sampled documents, sorted, and how many have each."""
    part = max(1, docs.count() // max(1, sample))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)
    each = map_batches(some, ["text"], lambda: lambda texts: [[shingles(t, words) for t in texts]], "s array<bigint>").select(F.explode("s").alias("s"))
    rows = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "s").limit(most).collect()
    rows.sort()
    return np.array([r.s for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def head(found: np.ndarray, often: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles that a set is posted under, in their order."""
    rank = np.zeros(len(found), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], found), len(often[0]) - 1)
        rank = np.where(often[0][at] == found, often[1][at], 0)
    return found[np.lexsort((found, rank))][: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]


def _reaches(similarity: float, overlap, n, m):
    return overlap >= similarity * (n + m - overlap) - 1e-9


def _possible(similarity: float, a: str, b: str):
    """Two postings whose sets can reach the similarity if the shared shingle is their first one."""
    size, pos = lambda x: F.shiftright(F.col(f"{x}.at"), 32), lambda x: F.col(f"{x}.at").bitwiseAND(F.lit(0xFFFFFFFF))
    n, m = size(a), size(b)
    return (F.col(f"{a}.sid") != F.col(f"{b}.sid")) & _reaches(similarity, F.least(n - pos(a), m - pos(b)), n, m)


def _alike(similarity: float, a: str, b: str):
    """Two structs of a set's size and bits that leave room for the similarity."""
    differ = sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(BITS >> 6)), F.lit(0))
    return differ <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * ((1 - similarity) / (1 + similarity)) + 1e-9


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(f"{a}.sid", f"{b}.sid").alias("a"), F.greatest(f"{a}.sid", f"{b}.sid").alias("b")).distinct()


def shared(postings: DataFrame) -> DataFrame:
    """Those of ``postings`` (shingle, sid, at) whose shingle another one has too; neighbours are looked at as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # the last row, and whether it is kept anyway
        for part in batches:
            if not part.num_rows:
                continue
            s = part.column(0).to_numpy(zero_copy_only=False)
            same = s[1:] == s[:-1]
            kept = np.append(same, False) | np.append(False, same)
            if open_ is not None:
                row, known = open_
                goes_on = row.column(0)[0].as_py() == s[0]
                kept[0] |= goes_on
                if known or goes_on:
                    yield row
            last = len(s) - 1
            yield part.slice(0, last).filter(pa.array(kept[:last]))
            open_ = pa.RecordBatch.from_arrays([c.take(pa.array([last])) for c in part.columns], schema=part.schema), bool(kept[last])
        if open_ is not None and open_[1]:
            yield open_[0]

    return postings.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, postings.schema)


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of ``sets`` (sid, fp; a row each) whose fingerprints link in op1's index, and each set with the first of its own fingerprint."""
    hubs = stored(sets.groupBy("fp").agg(F.min("sid").alias("sid")), "prints")
    few = small(hubs, IDS)
    across = simhash.links(hubs.select("fp")).join(few.toDF("a", "x"), "a").join(few.toDF("b", "y"), "b").select(F.struct(F.col("x").alias("sid")).alias("p"), F.struct(F.col("y").alias("sid")).alias("q"))
    within = sets.select("fp", F.struct("sid").alias("p")).join(few.select("fp", F.struct("sid").alias("q")), "fp").where("p.sid <> q.sid").select("p", "q")
    return _ordered(across.unionByName(within), "p", "q")


def _met(docs: DataFrame, distinct: DataFrame, sizes: DataFrame, pairs: DataFrame, words: int, shown: Callable, holds: Callable) -> DataFrame:
    """Those of ``pairs`` (a, b) for which ``holds`` of what is ``shown`` of both sets, stored.

    ``shown(set, n)``: the numbers that a set goes by beside a centre of n shingles; ``holds(x, y, n, m)``.
    """
    degree = stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("k")).join(sizes, "sid"), "degrees")
    few = small(degree, IDS)
    told = pairs.join(few.toDF("a", "k_a", "n_a"), "a").join(few.toDF("b", "k_b", "n_b"), "b")
    first = (F.col("k_a") > F.col("k_b")) | ((F.col("k_a") == F.col("k_b")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    told = told.select(pick("a", "b").alias("centre"), pick("b", "a").alias("sid"), pick("n_a", "n_b").alias("n"), F.greatest("k_a", "k_b").alias("k"))
    told = stored(told.select("centre", F.pmod(F.xxhash64("sid"), F.ceil(F.col("k") / FAN)).cast("int").alias("copy"), "n", "sid"), "told")
    visits = told.select("sid", "centre", "copy", "n", F.lit(1).alias("role")).unionByName(told.select(F.col("centre").alias("sid"), "centre", "copy", "n", F.lit(0).alias("role")).distinct())
    jobs = stored(visits.groupBy("sid").agg(F.collect_list(F.struct("centre", "copy", "n", "role")).alias("jobs")).join(distinct, "sid").select(F.col("first_id").alias("doc_id"), "sid", "jobs"), "jobs")
    wanted = F.broadcast(jobs) if told.count() <= IDS else jobs

    def make():
        def run(ids, texts, sids, jobs):
            out = []
            for text, sid, own in zip(texts, sids, jobs):
                found = shingles(text, words)
                if set_id(found) == sid:  # another row may have the same doc_id
                    out += [(j["centre"], j["copy"], j["role"], sid, len(found), shown(found, j["n"])) for j in own]
            return tuple(map(list, zip(*out))) or ([],) * 6

        return run

    sets = map_batches(docs.join(wanted, "doc_id"), ["doc_id", "text", "sid", "jobs"], make, "centre bigint, copy int, role int, sid bigint, n int, s array<bigint>")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, size = None, 0
        for part in batches:
            a, b = [], []
            for c, role, sid, n, s in zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4)), values(part.column(5))):
                if not role:
                    centre, size = np.array(s), n
                elif holds(centre, s, size, n):
                    a.append(min(c, sid))
                    b.append(max(c, sid))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = sets.repartition("centre", "copy").sortWithinPartitions("centre", "copy", "role").mapInArrow(compare, "a bigint, b bigint")
    found = stored(met.distinct(), "met")
    drop_stored(degree, told, jobs)
    return found


def _similar(docs: DataFrame, distinct: DataFrame, sizes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets reach the similarity, stored."""
    most = (1 - similarity) / (1 + similarity)

    def sketch(found, n):
        return parity(found, 1 << max(9, (n - 1).bit_length()))

    def may(x, y, n, m):
        return int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum()) <= (n + m) * most + 1e-9

    def reach(x, y, n, m):
        return _reaches(similarity, len(np.intersect1d(x, y, assume_unique=True)), n, m)

    likely = _met(docs, distinct, sizes, pairs, words, sketch, may)
    found = _met(docs, distinct, sizes, likely, words, lambda found, _: found, reach)
    drop_stored(likely)
    return found


def links(docs: DataFrame, prints: DataFrame, distinct: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): edges between set ids that connect just the sets which pairs of at least that similarity connect."""
    first = prints.join(small(distinct.withColumnRenamed("first_id", "doc_id"), IDS), ["sid", "doc_id"], "left_semi")
    posted = first.select("sid", "n", F.posexplode("head").alias("pos", "shingle"))
    lists = stored(shared(posted.select("shingle", "sid", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("pos").cast("bigint")).alias("at"))), "lists")
    nodes = stored(lists.select("sid").distinct(), "nodes")
    bits = stored(first.join(small(nodes, IDS), "sid", "left_semi").select("sid", F.struct("n", "bits").alias("v")).dropDuplicates(["sid"]), "bits")
    drop_stored(nodes)
    few = small(bits, NODES)

    def alike(pairs):  # a set that shares no posted shingle has no bits here, and no partner
        return pairs.join(few.toDF("a", "x"), "a").join(few.toDF("b", "y"), "b").where(_alike(similarity, "x", "y")).select("a", "b")

    tried = stored(alike(by_fingerprint(stored(first.select("sid", "fp").dropDuplicates(["sid"]), "fingerprints"))), "pairs")
    found = _similar(docs, distinct, bits.select("sid", "v.n"), tried, words, similarity)
    parts = [found]
    for last in (False, True):
        roots = stored(components(found).withColumnRenamed("node", "sid"), "roots")
        drop_stored(*parts)
        here = lists.join(small(roots, IDS), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        member = here.select("shingle", F.struct("sid", "at", "root").alias("p"))
        if not last:
            first_by = lambda seed: F.min(F.struct(F.xxhash64("p.sid", F.lit(seed)).alias("rank"), "p")).p
            hubs = member.groupBy("shingle").agg(*(first_by(seed).alias(f"h{seed}") for seed in range(2)), F.min("p.root").alias("low"), F.max("p.root").alias("high"))
            open_ = stored(hubs.where("low <> high").select("shingle", F.explode(F.array_distinct(F.array("h0", "h1"))).alias("q")), "hubs")
            met = member.join(open_, "shingle")
        else:  # whoever isn't of a list's greatest group, with all the others
            sizes = member.groupBy("shingle", "p.root").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "root")).root.alias("main"), F.count("*").alias("groups")).where("groups > 1")
            open_ = stored(sizes.select("shingle", "main"), "hubs")
            before = F.collect_list("shingle").over(Window.partitionBy("sid").orderBy("at").rowsBetween(-BEFORE, -1))
            left = member.join(open_, "shingle").select("shingle", "main", "p.*").withColumn("before", before).join(few, "sid")
            left = stored(left.select("shingle", "main", F.struct("sid", "at", "v.n", "root", "v.bits", "before").alias("p")), "left")
            met = left.where("p.root <> main").select("shingle", "p").join(left.select("shingle", F.col("p").alias("q")), "shingle")
            met = met.where(_alike(similarity, "p", "q") & ~F.arrays_overlap("p.before", "q.before"))  # else they have met, at lower places
        pairs = _ordered(met.where((F.col("p.root") != F.col("q.root")) & _possible(similarity, "p", "q")), "p", "q")
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs if last else alike(pairs), "pairs")
        drop_stored(open_, *([left] if last else []))
        now = _similar(docs, distinct, bits.select("sid", "v.n"), pairs, words, similarity)
        stars = roots.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))  # they connect what all links so far do
        found, tried, parts = stars.unionByName(now), tried.unionByName(pairs), [roots, now]
    drop_stored(lists, bits)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): the groups that pairs of at least ``similarity`` make, by their smallest doc_id.

    Texts of one set of shingles count once in the index.  Wordless and null texts are one group.  Rows without a
    doc_id take no part; whole texts of any length are compared; an empty table gives no rows; a repeated doc_id gives a
    row each time; other columns are ignored.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))

    def make():
        def run(ids, texts):
            sets = [shingles(t, words) for t in texts]
            prints = np.array(list(map(simhash.of_digests, sets)), np.uint64).view(np.int64)
            return ids, [set_id(s) for s in sets], [len(s) for s in sets], [head(s, often.value, similarity) if len(s) else s for s in sets], list(map(parity, sets)), prints

        return run

    prints = stored(map_batches(docs, ["doc_id", "text"], make, "doc_id bigint, sid bigint, n int, head array<bigint>, bits array<bigint>, fp bigint"), "heads")
    ids = stored(prints.select("doc_id", "sid"), "ids")
    distinct = stored(ids.groupBy("sid").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = links(docs, prints, distinct, words, similarity)
    drop_stored(prints)
    return ids.join(grouped(distinct, "sid", found), "sid").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that another of their group stands for: one of each group stays.

    A row without a doc_id stays; rows that repeat a doc_id stay or go together; columns may have any names.
    """
    return without(docs, "doc_id", near_duplicates(docs, **parameters).where("doc_id <> component_id").select("doc_id"))
