"""The transducer against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def parts():
    v = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    return v, bpe.sufficient_lookahead(v), Tokenizer.from_file(PATH)


def samples():
    rng = random.Random(3)
    letters = "aabcdeeinorst  \n\t'ABéñ漢字🙂0123!?.-_  ᰀ\x1c\x85́²٣<|>"
    out = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "x" * 9000, "ab" * 3000, " " * 700 + "z", "'s'll 're"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)]
    return out + ["".join(rng.choice(["a", "th", "in", "er", "tion"]) for _ in range(rng.randrange(300, 900))) for _ in range(60)]


def test_ids_and_text_are_the_librarys(parts):
    v, lookahead, reference = parts
    encoder = bpe.Encoder(v, lookahead)
    for k, s in enumerate(samples()):
        if k % 2:
            encoder.learn({w for u in encoder.units(s) if not isinstance(u, bytes) for w in u})
        ids = b"".join(encoder.encode(s))
        want = reference.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(s[:80])
        assert bpe.Decoder(v).feed(ids, True) == reference.decode(want, skip_special_tokens=False)


def test_decoder_waits_for_unfinished_characters(parts):
    v, lookahead, _ = parts
    ids = b"".join(bpe.Encoder(v, lookahead).encode("漢🙂ᰀ"))
    decoder = bpe.Decoder(v)
    assert "".join(decoder.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)) + decoder.feed(b"", True) == "漢🙂ᰀ"
    assert bpe.Decoder(v).feed(ids[:4], True) == "�"


def test_slices_of_a_text_change_nothing(parts, monkeypatch):
    v, lookahead, reference = parts
    monkeypatch.setattr(bpe, "SLICE", 7)
    monkeypatch.setattr(bpe, "LONG", 5)
    encoder = bpe.Encoder(v, lookahead)
    for s in samples()[:800]:
        assert np.frombuffer(b"".join(encoder.encode(s)), "<u4").tolist() == reference.encode(s, add_special_tokens=False).ids


def test_table(spark, parts):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (2, "", "z"), (3, "naïve " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.intact) for r in bpe.round_trip(df, PATH).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = parts[2].encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), PATH, ids=True).collect() == []


@pytest.mark.parametrize("unit", ["a", "ab", "7", "!?", " ", "\n ", "é", "漢", " 🙂"])
def test_long_runs_are_streamed(parts, monkeypatch, unit):
    v, lookahead, reference = parts
    monkeypatch.setattr(bpe, "SLICE", 500)
    monkeypatch.setattr(bpe, "LONG", 300)
    for tail in ("", "x", " x", "'s", "\n\nx", "1"):
        text = "it's " + unit * 3000 + tail + " " + unit * 1200
        units = list(bpe.Encoder(v, lookahead).units(text))
        assert np.frombuffer(b"".join(bpe.Encoder(v, lookahead).encode(text)), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
        assert len(unit) > 1 and unit[0] == " " or any(isinstance(u, bytes) for u in units)


def test_time_of_an_unbroken_run_is_linear(parts):
    v, lookahead, _ = parts
    took = []
    for n in (1, 4):
        began = time.perf_counter()
        held = [len(u) for u in bpe.Encoder(v, lookahead).units("abcdefgh" * (n << 17)) if isinstance(u, bytes)]
        took.append(time.perf_counter() - began)
        assert max(held) <= 4 * 2 * bpe.SLICE
    assert took[1] < 8 * took[0]
