import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import corpus, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(spark, reference):
    rows = corpus() + [(1000, "naïve café — 東京 😀 <|endoftext|> 1234567\r\n\t x"), (1001, "a" * 3000), (1002, "\x00\x01 \x00"), (1003, "ab" * 190)]
    got = sorted(map(tuple, bpe.round_trip(documents(spark, rows)).collect()), key=str)
    expected = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)


def test_encode_then_decode(spark):
    rows = corpus(30)
    encoded = bpe.encode(documents(spark, rows))
    assert sorted((r["doc_id"], bytes(r["bytes"])) for r in bpe.decode(encoded.where("doc_id is not null")).collect()) == sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    assert bpe.encode(documents(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    codec = bpe.codec(PATH, public_tokenizers.PATTERN)
    enc = _encoding()
    ids = codec.encode(texts)
    assert ids == [enc.encode_ordinary(t) for t in texts] and codec.decode(ids) == [t.encode() for t in texts]


def _encoding(held=[]):
    if not held:
        ranks = bpe.codec(PATH, public_tokenizers.PATTERN).ranks
        held.append(tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return held[0]


def test_long_words_agree_with_the_query():
    codec = bpe.codec(PATH, public_tokenizers.PATTERN)
    words = [w.encode() for w in ("a" * 399, "abcd" * 99, "é" * 190, "zq" * 150, "thethethe" * 30)]
    order, lens, ids = codec._by_query(words)
    found = dict(zip(order.tolist(), (tuple(x.tolist()) for x in np.split(ids, np.cumsum(lens)[:-1]))))
    assert [found[i] for i in range(len(words))] == [codec._by_heap(w) for w in words]


def test_what_is_forgotten_is_learnt_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5_000)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 50)
    codec, enc = bpe.Codec(PATH, public_tokenizers.PATTERN), _encoding()
    texts = [f"word{i}x qqzz{i * 7} the {'zq' * 300} émile{i}" for i in range(40)] + [""]
    for k in range(0, 41, 5):
        ids = codec.encode(texts[k : k + 5])
        assert ids == [enc.encode_ordinary(t) for t in texts[k : k + 5]] and codec.decode(ids) == [t.encode() for t in texts[k : k + 5]]


def test_many_words_just_under_the_bound():
    codec, enc = bpe.Codec(PATH, public_tokenizers.PATTERN), _encoding()
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=390)) for _ in range(100)) for _ in range(8)]
    assert codec.encode(texts) == [enc.encode_ordinary(t) for t in texts]


def test_unknown_ids_raise(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")).collect()
