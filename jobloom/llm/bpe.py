"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoding as a byte-to-text state machine.

``sufficient_lookahead`` computes from the merge list how many bytes to the right of a boundary can still change it.
The ``Transducer`` takes the bytes of a pretoken piece by piece, merges a window of them and emits the tokens that end
at least that far before the window's end; a boundary splits the rest of the run off, so the window starts again there
and memory is constant, however long the run is.  The split into pretokens is a state machine over slices of the text:
it holds back its last two pretokens, as later text may change them, and once a pretoken is longer than ``LONG`` it only
looks for the end of the run of that kind of character and hands on what it has read.

A pretoken of up to ``SHORT`` characters is no longer than one window, so all of it is merged at once, together with
others, and remembered; only longer ones need the transducer.  Both give the same ids.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: How the tokenizer file's pre-tokenizer splits a text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split, for texts of ASCII and Latin letters only, where the quicker standard module can state the classes.
LATIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*")
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters split and encoded at a time.
SLICE = 1 << 16
#: Pretokens remembered by a task, some 200 bytes each, and the longest that is remembered.
CACHE, SHORT = 300_000, 64
#: Characters after which a pretoken is handed on in parts.
LONG = 4096
#: What goes on with a run, by the kind of its last character.
KINDS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]
#: Characters of a batch whose new pretokens are learned together; a longer text streams alone.
BULK = 8_000_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The rank of a pair that doesn't merge.
NEVER = 1 << 30


class Vocabulary:
    """What a tokenizer file of kind byte-level BPE states: token bytes, merges and special tokens."""

    def __init__(self, source: str):
        j = json.loads(source)
        if j["model"]["type"] != "BPE" or (j.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or j.get("normalizer") or j["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        ids = j["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.first_ids = np.array(self.first)
        self.slots = 1 << (4 * len(self.merges)).bit_length()
        self.slot_key, self.slot_rank, self.slot_new = np.full(self.slots, -1), np.full(self.slots, NEVER), np.zeros(self.slots, np.int64)
        for (a, b), (rank, new) in self.merges.items():
            at = self._slot(a << 32 | b)
            while self.slot_key[at] >= 0:
                at = (at + 1) % self.slots
            self.slot_key[at], self.slot_rank[at], self.slot_new[at] = a << 32 | b, rank, new

    def _slot(self, key):
        return ((key >> 32) * 0x9E3779B1 + (key & 0xFFFFFFFF) * 0x85EBCA6B >> 9) & self.slots - 1

    def find_pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and ids of the merges of many pairs at once; rank NEVER where there is none."""
        key = np.where((a < 0) | (b < 0), (1 << 31) - 1 << 32, a << 32 | b).ravel()
        at = self._slot(key)
        while len(on := np.flatnonzero((self.slot_key[at] != key) & (self.slot_key[at] >= 0))):
            at[on] = (at[on] + 1) % self.slots
        return self.slot_rank[at].reshape(a.shape), self.slot_new[at].reshape(a.shape)

    def merged_rows(self, ids: np.ndarray) -> list[bytes]:
        """Each row's ids merged in order of rank, from left to right within a rank; -1 fills rows up and ends each."""
        out: list[bytes] = [b""] * len(ids)
        row, (rank, new) = np.arange(len(ids)), self.find_pairs(ids[:, :-1], ids[:, 1:])
        while len(ids):
            k = rank.argmin(axis=1)
            every = np.arange(len(ids))
            if (done := rank[every, k] == NEVER).any():
                small = ids[done].astype("<u4")
                for r, x, n in zip(row[done].tolist(), small, (ids[done] >= 0).sum(axis=1).tolist()):
                    out[r] = x[:n].tobytes()
                ids, rank, new, row, k = (x[~done] for x in (ids, rank, new, row, k))
                every = np.arange(len(ids))
                if not len(ids):
                    break
            width = ids.shape[1] - 1
            ids[every, k] = new[every, k]
            after = np.arange(width) > k[:, None]  # one id fewer from here on
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            if width == 1:
                rank = np.full((len(ids), 1), NEVER)
                ids = np.column_stack([ids, np.full(len(ids), -1)])
                new = rank
                continue
            rank, new = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1]), np.where(after[:, :-1], new[:, 1:], new[:, :-1])
            for side in (k - 1, k):
                ok = (side >= 0) & (side < width - 1)
                at = side[ok]
                rank[every[ok], at], new[every[ok], at] = self.find_pairs(ids[every[ok], at], ids[every[ok], at + 1])
        return out


def sufficient_lookahead(v: Vocabulary) -> int:
    """Bytes after a boundary that decide whether a merge crosses it.

    A merge (left, right) of rank r across a boundary depends on: how ``right`` comes about; merges of lower rank across
    the same boundary between ends of ``left`` and beginnings of ``right``; and merges of lower rank that join a beginning
    of ``right`` to what follows.  Ranks fall along each chain, so one pass in rank order gives the longest reach.
    """
    size, made = {i: len(b) for i, b in v.bytes_of.items()}, {}
    reach: dict[tuple[int, int], int] = {}  # of a merge, from the start of its right part
    grow: dict[int, int] = {}  # the longest reach of merges so far by their left part
    form: dict[int, int] = {}  # what decides that a token comes about, from its start

    def spine(token: int, side: int) -> list[int]:
        out = [token]
        while out[-1] in made:
            out.append(made[out[-1]][side])
        return out

    for (left, right), (_, new) in v.merges.items():
        far = form.get(right, size[right])
        ends = spine(left, 1)
        for x in spine(right, 0):
            far = max([far, size[x] + grow.get(x, 0), *(reach.get((y, x), 0) for y in ends)])
        reach[left, right] = far
        grow[left] = max(grow.get(left, 0), far)
        if new not in made:
            made[new] = (left, right)
            form[new] = max(form.get(left, size[left]), size[left] + far)
    return max(reach.values(), default=1)


class Encoder(dict):
    """pretoken -> its ids as little-endian 32-bit integers; computed when missing, forgotten when full."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int, cache: int = CACHE):
        self.v, self.lookahead, self.cache = vocabulary, lookahead, cache
        self.window = 8 * lookahead + max(map(len, vocabulary.bytes_of.values()))
        self.any_split, self.latin_split = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        specials = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None

    def split(self, text: str) -> list[str]:
        return self.latin_split(text) if LATIN.fullmatch(text) else self.any_split(text)

    def __missing__(self, pretoken: str) -> bytes:
        out = Transducer(self).feed(pretoken.encode(), True)
        if len(pretoken) <= SHORT and len(self) < self.cache:
            self[pretoken] = out
        return out

    def learn(self, pretokens: set[str]) -> None:
        """Encode the short ones among ``pretokens`` that aren't known yet, all together."""
        if len(self) + len(pretokens) > self.cache:
            self.clear()
        new = sorted((w for w in pretokens if w not in self and len(w) <= SHORT), key=len)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            data = [w.encode() for w in part]
            size = np.fromiter(map(len, data), np.int64, len(data))
            ids = np.full((len(data), size.max() + 1), -1, np.int64)
            ids[np.arange(ids.shape[1]) < size[:, None]] = self.v.first_ids[np.frombuffer(b"".join(data), np.uint8)]
            for w, row in zip(part, self.v.merged_rows(ids)):
                self[w] = row

    def merged(self, ids: list[int]) -> list[int]:
        """Merge pairs in order of rank, from left to right within a rank."""
        find, n = self.v.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(m[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := find((ids[k], ids[k + 1])))]
        heapify(todo)
        while todo:
            _, k, left, right = heappop(todo)
            if ids[k] != left or (m := after[k]) >= n or ids[m] != right:
                continue  # one of the two has merged meanwhile
            ids[k], ids[m] = find((left, right))[1], -1
            after[k] = far = after[m]
            if far < n:
                before[far] = k
                if more := find((ids[k], ids[far])):
                    heappush(todo, (more[0], k, ids[k], ids[far]))
            if (back := before[k]) >= 0 and (more := find((ids[back], ids[k]))):
                heappush(todo, (more[0], back, ids[back], ids[k]))
        return [i for i in ids if i >= 0]

    def plain(self, text: str, start: int, end: int) -> Iterator[list[str] | bytes]:
        """Pretokens of the part of a text from ``start`` to ``end``, which has no special tokens, a slice at a time; of a long run its ids."""
        held, at = "", start
        while at < end or held:
            held, at = held + text[at : min(end, at + SLICE)], min(end, at + SLICE)
            tokens = self.split(held)
            if at == end:
                yield tokens
                return
            if len(tokens[-1]) > LONG:
                yield tokens[:-1]
                held, at = yield from self._long(text, tokens[-1], at, end)
            else:
                held = "".join(tokens[-2:])
                yield tokens[:-2]

    def _long(self, text: str, begun: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of the pretoken that begins with ``begun`` and goes on at ``at``; returns what is held of later pretokens, and the place after it."""
        kind = next(k for k in KINDS if k.match(begun[-1]))
        of, space, held = Transducer(self), kind is KINDS[2], begun
        while True:
            # the last character of white space before a word isn't of its run
            yield of.feed((held[:-1] if space else held).encode())
            held = held[-1] if space else ""
            piece = text[at : min(end, at + SLICE)]
            m = kind.match(piece)
            n = m.end() if m else 0
            held, at = held + piece[:n], at + n
            if n < len(piece) or at == end:
                whole = not space or at == end
                yield of.feed((held if whole else held[:-1]).encode(), True)
                return ("" if whole else held[-1]), at

    def units(self, text: str) -> Iterator[list[str] | bytes]:
        """Lists of pretokens, and ids: of long runs, and of special tokens whose strings stand in the text (as the tokenizers library does by default)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self.plain(text, at, m.start())
            yield self.v.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self.plain(text, at, len(text))

    def ids(self, unit: list[str] | bytes) -> bytes:
        return unit if isinstance(unit, bytes) else b"".join(map(self.__getitem__, unit))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit integers, slice by slice."""
        return map(self.ids, self.units(text))


class Transducer:
    """The bytes of one pretoken, in pieces -> its ids, each emitted as soon as no later byte can change it."""

    def __init__(self, encoder: Encoder):
        self.e, self.held = encoder, b""

    def feed(self, data: bytes, final: bool = False) -> bytes:
        """The ids, as little-endian 32-bit integers, that ``data`` makes certain; ``final``: nothing follows."""
        e, sizes, at = self.e, self.e.v.bytes_of, 0
        data, out = self.held + data, []
        while len(data) - at > e.window or final and at < len(data):
            end = min(len(data), at + e.window)
            ids = e.merged([e.v.first[b] for b in data[at:end]])
            if final and end == len(data):
                out += ids
                at = end
                break
            start = at
            for i in ids:
                if at + len(sizes[i]) > end - e.lookahead:
                    break
                out.append(i)
                at += len(sizes[i])
            if at == start:
                raise AssertionError("the window holds a longest token and its lookahead")
        self.held = data[at:]
        return np.array(out, "<u4").tobytes()


class Decoder:
    """ids -> text: bytes of an unfinished character wait for the next ids; invalid bytes become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of, self.state = vocabulary.bytes_of.__getitem__, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, memoryview(ids).cast("I"))), final)


_READY: dict[str, tuple[Vocabulary, int]] = {}


def _ready(source: str, lookahead: int) -> Vocabulary:
    """A worker parses a tokenizer file once, whatever number of tasks it runs."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = (Vocabulary(source), lookahead)
    return _READY[key][0]


def round_trip(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, intact[, ids]): each text encoded with the tokenizer file, then decoded.

    The driver reads the file and broadcasts it (a few MB, a fixed size).  Null texts are empty: no tokens.  ``intact``
    says that the decoded text is the text.  A very long text is encoded slice by slice in time in proportion to its
    length; only with ``ids`` are all its ids held.  Repeated rows give a row each; an empty table gives no rows; other
    columns are ignored.
    """
    with open(path, encoding="utf-8") as f:
        source = f.read()
    lookahead = sufficient_lookahead(Vocabulary(source))
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def make():
        vocabulary = _ready(shared.value, lookahead)
        encoder = Encoder(vocabulary, lookahead)

        def one(text, units):
            decoder = Decoder(vocabulary)
            of_ids, of_text, n, kept, same, at = hashlib.sha256(), hashlib.sha256(), 0, [], True, 0
            for part in (*map(encoder.ids, units), b""):
                of_ids.update(part)
                n += len(part) // 4
                back = decoder.feed(part, not part)
                of_text.update(back.encode())
                same, at = same and text.startswith(back, at), at + len(back)
                if ids:
                    kept += memoryview(part).cast("I") if part else ()
            return n, of_ids.hexdigest(), of_text.hexdigest(), same and at == len(text), kept

        def run(doc_ids, texts):
            texts = [t or "" for t in texts]
            units: Iterable = map(encoder.units, texts)
            if sum(map(len, texts)) < BULK:
                units = [list(u) for u in units]
                encoder.learn({w for u in units for part in u if not isinstance(part, bytes) for w in part})
            n, of_ids, of_text, same, kept = zip(*map(one, texts, units)) if texts else ([],) * 5
            return [doc_ids, n, of_ids, of_text, same] + [kept] * ids

        return run

    return map_batches(docs, ["doc_id", "text"], make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, intact boolean" + ", ids array<int>" * ids)
