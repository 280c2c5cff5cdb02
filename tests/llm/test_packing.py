import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
from helpers import corpus, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievework.llm import common, packing
from sievework.session import bound_batches


def check_places(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pieces_and_places(spark):
    rows = corpus() + [(2000, "special <|endoftext|> token"), (2001, " " * 5000)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(documents(spark, rows), size=64).collect()
    expected = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            expected.append((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), ids[s : s + n].tolist()))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got), key=str) == sorted(expected, key=str)
    used, total = check_places(got, 64), sum(r["length"] for r in got)
    assert used <= -(-total // 64) * 1.05 + 1
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(1025, 1024) == [(0, 1), (1, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(0, 40))
def test_fullest_is_the_best_subset(lengths, room):
    left = {x: lengths.count(x) for x in lengths}
    use = packing.fullest(left, room)
    best = max((sum(c) for n in range(len(lengths) + 1) for c in combinations(lengths, n) if sum(c) <= room), default=0)
    assert sum(x * k for x, k in use.items()) == best and all(k <= left[x] for x, k in use.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_patterns_use_every_piece_once(histogram):
    used = {}
    for times, items in packing.patterns(histogram, 32):
        assert sum(x * k for x, k in items) <= 32
        for x, k in items:
            used[x] = used.get(x, 0) + times * k
    assert used == histogram


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), min_size=1, max_size=9), max_size=6), st.integers(0, 2))
def test_folded_ids_come_back(lists, skip):
    column = pa.array([packing.compact(np.array(x, dtype="<u4")) for x in lists], pa.binary()).slice(skip)
    assert packing.unfolded(column, np.array([len(x) for x in lists[skip:]], dtype=np.int64)).to_pylist() == lists[skip:]


def test_ids_are_exchanged_in_two_bytes(spark):
    got = packing.pack_documents(documents(spark, corpus()), size=64)
    assert dict(got.dtypes)["ids"] == "array<int>" and got.columns[-2:] == ["sequence_id", "offset"]
    plan = got._jdf.queryExecution().optimizedPlan()
    below = plan.children().apply(0)  # what the placing of pieces reads
    kinds = {a.name(): a.dataType().simpleString() for i in range(below.output().size()) for a in [below.output().apply(i)]}
    assert kinds["ids"] == "binary"


def test_a_worker_remembers_one_thing_at_a_time():
    first = common.remembered("a", lambda: [1])
    assert common.remembered("a", lambda: [2]) is first
    assert common.remembered("b", lambda: [3]) == [3] and list(common._REMEMBERED) == ["b"]
    common.forget()
    assert not common._REMEMBERED


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound_batches(spark)
    assert int(spark.conf.get(name)) <= 8 << 20


def test_exchange_is_even(spark):
    """Half of all pieces are of one length; no bucket of wide rows has many of them."""
    parts = packing.stash(packing.pieces(documents(spark, [(i, "a b c d e f") for i in range(3000)]), size=8, folded=True), "even")
    plan = packing.pack(parts, 8, folded="ids")._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(doc_id" in plan and ", 3)" in plan
