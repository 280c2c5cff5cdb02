"""Ids of shingles against their definition."""

import random

from sievework.functions import shingles as sh


def test_ids_are_those_of_the_shingles_and_each_is_hashed_once(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "abcd", "abcde", "\U0001f600b\U0001f600cd ef", "aaaaaaaaaaaa"]
    texts += ["".join(rng.choice("abcde é中\U0001f600") for _ in range(rng.randrange(400))) for _ in range(40)]
    texts += ["".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]  # more code points than have numbers
    calls, real = [], sh.u32
    monkeypatch.setattr(sh, "u32", lambda data: calls.append(data) or real(data))
    for size in (1, 3, 5, 8, 9):
        ids = sh.Ids(size)
        for t in texts:
            assert sorted(ids.of(t).tolist()) == sorted(real(g.encode()) for g in sh.shingles(t, size)), (size, t[:20])
    calls.clear()
    ids = sh.Ids(5)
    for _ in range(20):
        ids.of(texts[10])
    assert len(calls) == len(sh.shingles(texts[10], 5))
