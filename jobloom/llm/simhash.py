"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes.  Two fingerprints that differ in at most 4 bits differ in at most 4
bytes, so they share at least 4 positional bytes: that is the guaranteed minimum of matches.  The index posts
every distinct fingerprint under each choice of 4 positions.  In a list the positional bytes that a pair shares are
tallied from the first position on; a pair is retained where the tally reaches the minimum just at the list's last
position, which is one list of all those in which it meets.  Retained pairs are verified by their differing bits.  Only
a spanning forest of the list's links leaves the task.

Lists longer than ``LIST`` are not paired: their members go to the next level, which indexes the 32 bits that
are still free by nibbles (of 8 nibbles at least 4 are equal), then by bit pairs, with the same tally.  One list is
reached through many lists above it, so postings are made distinct.  At the third level 8 bits are free and a list
holds at most 256 fingerprints, so every list is short and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_batches, stored, without
from .components import grouped

WORDS, BITS, SEED = 4, 4, 42
#: Longest list whose pairs are compared in one task.
LIST = 1024
#: Shingles hashed and counted at a time, so a very long text needs no more memory.
CHUNK = 1 << 15
CHOICES = list(combinations(range(8), 4))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` have each of 64 bits set, most significant first."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), 8), axis=1)
    whole = len(h) - len(h) % 255  # 255 ones fit a byte
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        out += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 if it is null or has no word."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: max(1, len(tokens) - words + 1)].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        counts += _bit_counts(np.array([digest(joined[x:y], SEED) for x, y in zip(first[at : at + CHUNK], last[at : at + CHUNK])], np.uint64))
    return _majority(counts, len(first))


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def of_digests(digests: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of shingles whose digests (64 bits each) are at hand already; 0 if there are none."""
    return _majority(sum((_bit_counts(digests[at : at + CHUNK].view(np.uint64)) for at in range(0, len(digests), CHUNK)), np.zeros(64, np.int64)), len(digests))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed bigint.  A null or wordless text has fp 0."""

    def make():
        def run(ids, texts):
            return ids, np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)

        return run

    return map_batches(docs, ["doc_id", "text"], make, "doc_id bigint, fp bigint")


def _masks(fixed: int) -> list[int]:
    """The next level's lists below one that fixes the bits ``fixed``: 4 of the 8 equal pieces of the free bits each."""
    pieces = _pieces(fixed).tolist()
    return [fixed | sum(pieces[p] for p in choice) for choice in CHOICES]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(pairs: list[tuple[int, int]]) -> np.ndarray:
    """Those of ``pairs`` that join what wasn't joined before, as (n, 2)."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[y] = x
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def _starts(mask: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))


def _pieces(fixed: int) -> np.ndarray:
    """The 8 equal pieces, as masks, of the bits that ``fixed`` leaves free."""
    free = [b for b in range(63, -1, -1) if not fixed >> b & 1]
    width = len(free) // 8
    return np.array([sum(1 << b for b in free[p * width : (p + 1) * width]) for p in range(8)], np.uint64)


_HIGH, _LOW = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)


def _shared_bytes(differ: np.ndarray) -> np.ndarray:
    """The tally of a pair's shared bytes, as the high bit of each byte of ``differ`` that is zero."""
    return ~((differ & _LOW) + _LOW | differ | _LOW)


def _up_to_last(mask: np.ndarray) -> np.ndarray:
    """The high bits of the bytes down to a list's last position."""
    own = mask & _HIGH
    last = own & (~own + np.uint64(1))
    return _HIGH & ~(last - np.uint64(1))


def _retained(differ: np.ndarray, mask: np.ndarray, level: int) -> np.ndarray:
    """Count filtering: which pairs have their first four shared pieces, at each level, just where the list's ``mask`` has its own."""
    if not level:
        return _shared_bytes(differ) & _up_to_last(mask) == mask & _HIGH
    fixed, out = np.zeros(len(differ), np.uint64), np.ones(len(differ), bool)
    for _ in range(level + 1):
        above = fixed.copy()
        for known in np.unique(above):
            on = np.flatnonzero(above == known)
            pieces = _pieces(int(known))
            shared = differ[on, None] & pieces == 0
            tally = np.cumsum(shared, axis=1)
            out[on] &= tally[:, -1] >= 4
            fixed[on] |= np.bitwise_or.reduce(np.where(shared & (tally <= 4), pieces, np.uint64(0)), axis=1)
    return out & (fixed == mask)


def _paired(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, bits: int, level: int) -> np.ndarray:
    """A spanning forest of the links in each list, as pairs of row numbers; rows are sorted by list."""
    n, starts = len(fp), _starts(mask, key)
    sizes = np.diff(np.append(starts, n))
    ends, i, u, m = np.repeat(starts + sizes, sizes), np.arange(n), fp.view(np.uint64), mask.view(np.uint64)
    found: list[tuple[int, int]] = []
    lag = 1
    while len(i := i[i + lag < ends[i]]):
        differ = u[i] ^ u[i + lag]
        tallied = np.flatnonzero(_retained(differ, m[i], level))
        kept = i[tallied[np.bitwise_count(differ[tallied]) <= bits]]
        found += zip(kept.tolist(), (kept + lag).tolist())
        if len(found) > 2 * n + 100_000:
            found = list(map(tuple, _forest(found).tolist()))
        lag += 1
    return _forest(found)


def _lists(batches: Iterator[pa.RecordBatch], limit: int, bits: int, level: int = 0) -> Iterator[pa.RecordBatch]:
    """Postings (mask, key, fp) sorted by list -> links (0, a, b) of short lists and members (mask, fp, fp) of long ones.

    A list may span batches; at most ``limit`` rows of one are held back.
    """

    def out(mask, a, b):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (mask, a, b)], names=["mask", "a", "b"])

    def short(mask, key, fp):
        at = _paired(mask, key, fp, bits, level)
        return out(np.zeros(len(at), np.int64), fp[at[:, 0]], fp[at[:, 1]])

    held = [np.empty(0, np.int64)] * 3
    passing = None  # the long list whose rows go straight on
    for batch in batches:
        mask, key, fp = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, batch.columns))
        n, held = len(fp), [np.empty(0, np.int64)] * 3
        if not n:
            continue
        sizes = np.diff(np.append(_starts(mask, key), n))
        long = sizes > limit
        if passing == (mask[0], key[0]):
            long[0] = True
        passing = (mask[-1], key[-1]) if long[-1] else None
        wait = np.zeros(len(sizes), bool)
        wait[-1] = not long[-1]
        long, wait = np.repeat(long, sizes), np.repeat(wait, sizes)
        if long.any():
            yield out(mask[long], fp[long], fp[long])
        if (now := ~long & ~wait).any():
            yield short(mask[now], key[now], fp[now])
        held = [mask[wait], key[wait], fp[wait]]
    if len(held[2]):
        yield short(*held)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (mask, fp) of long lists -> their postings one level deeper."""
    for batch in batches:
        mask, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for above in np.unique(mask):
            below, own = np.array([_signed(m) for m in _masks(int(above) % (1 << 64))], np.int64), fp[mask == above]
            for at in range(0, len(own), 4096):
                part = np.repeat(own[at : at + 4096], len(below))
                m = np.tile(below, len(part) // len(below))
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(m & part), pa.array(part)], names=["mask", "key", "fp"])


def links(distinct: DataFrame, bits: int = BITS, limit: int = LIST) -> DataFrame:
    """(a, b): edges between distinct fingerprints (fp bigint) that connect just those within ``bits`` (at most 4) differing bits."""
    if not 0 <= bits <= 4:
        raise ValueError("the guaranteed minimum of four shared bytes needs at most 4 differing bits")
    fp, found = F.col("fp"), None
    todo = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("bigint") for m in _masks(0)))).alias("mask")).select("mask", F.col("mask").bitwiseAND(fp).alias("key"), "fp")
    for level in range(3):
        cap = limit if level < 2 else 256  # two levels deeper 8 bits are free
        lists = todo.repartition("mask", "key")
        lists = (lists.distinct() if level else lists).sortWithinPartitions("mask", "key")
        here = stored(lists.mapInArrow(lambda batches, cap=cap, level=level: _lists(batches, cap, bits, level), "mask bigint, a bigint, b bigint"), "links")
        mine = here.where("mask = 0").select("a", "b")
        found = mine if found is None else found.unionByName(mine)
        long = here.where("mask <> 0").select("mask", F.col("a").alias("fp"))
        if long.isEmpty():
            break
        if level == 2:
            raise RuntimeError("a list of the last level is too long: its links would be lost")
        todo = long.mapInArrow(_refine, "mask bigint, key bigint, fp bigint")
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, limit: int = LIST) -> DataFrame:
    """(doc_id, fp, component_id): the documents' SimHash groups.

    ``component_id`` is the smallest doc_id that links of at most ``bits`` differing bits reach.  Equal texts
    share a fingerprint and count once in the index, so a text with very many copies adds one posting set.
    Null, empty and wordless texts have fp 0 and are linked like any other; a very long text is hashed ``CHUNK``
    shingles at a time; an empty table gives no rows; further columns of ``docs`` are ignored; a repeated doc_id gives a
    row each time; a row without a doc_id has the component of its text, null if nothing in it has a doc_id.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    members = grouped(distinct, "fp", links(distinct, bits, limit))
    drop_stored(distinct)
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that another of their group stands for: one of each group stays.

    A row without a doc_id stays; rows that repeat a doc_id stay or go together; columns may have any names.
    """
    return without(docs, "doc_id", near_duplicates(docs, **parameters).where("doc_id <> component_id").select("doc_id"))


def hex_fingerprint(fp: Column) -> Column:
    """A signed bigint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
