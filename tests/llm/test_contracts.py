"""The columns that each query promises, over one small set of tables, against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import corpus, documents
from test_simhash import classes, fingerprint
from test_toxicity import made
from tokenizers import Tokenizer

from sievework.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    toxic, labels = made(200)
    rows = corpus(40) + [(1000 + i, t) for i, t in toxic] + [(2000, "x " * 3000), (2001, "naïve — 東京 😀 <|endoftext|>")]
    documents(spark, rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 6)).astype(np.float32))] + [(300, None), (320, [float("nan")] * 6)]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    pages = [(i, f"http://x/{i}", f"<p>{'same ' * 40 if i % 3 else i}</p>" if i % 7 else None) for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path), rows, vectors, pages


def run(spark, tables, name):
    df = QUERIES[name](spark, tables[0])
    return df.dtypes, [r.asDict() for r in df.collect()]


def test_op3(spark, tables):
    kinds, got = run(spark, tables, "op3_top_k")
    assert kinds[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    v = np.floor(64 * np.array([x for _, x in tables[2][:300]], dtype=np.float64)).astype(np.int64)
    expected = [(i, r, int(j), int(v[i] @ v[j])) for i in range(0, 300, 20) for r, j in enumerate([j for j in np.lexsort((np.arange(300), -(v @ v[i]))) if j != i][:20], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(expected)


def test_op4(spark, tables):
    kinds, got = run(spark, tables, "op4_bpe")
    assert kinds[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    ids = [(i, enc.encode_ordinary(t or ""), t or "") for i, t in tables[1]]
    expected = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids]
    assert sorted((tuple(r.values())[:4] for r in got), key=str) == sorted(expected, key=str)


def test_op5(spark, tables):
    kinds, got = run(spark, tables, "op5_learned_partitions")
    assert kinds[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    v = np.array([x for _, x in tables[2][:300]], dtype=np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 300, 50)) and all([r["rank"] for r in x] == [1, 2, 3, 4, 5] and len({r["vec_id"] for r in x} | {i}) == 6 for i, x in by.items())
    assert all(abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-12 for r in got)
    hits = sum(r["vec_id"] in np.argsort(-(unit @ unit[r["query_id"]]))[1:6] for r in got)
    assert hits >= 27


def test_op6(spark, tables):
    kinds, got = run(spark, tables, "op6_sharding")
    assert kinds[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    expected = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in tables[1]]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(expected, key=str)
    slots = {}
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert set(slots) == set(range(40)) and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op7(spark, tables):
    kinds, got = run(spark, tables, "op7_best_fit_packing")
    assert kinds[:7] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = False
    expected = []
    for i, t in tables[1]:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        first, at = (len(ids) - 1) % 1024 + 1, 0
        for k in range(-(-len(ids) // 1024)):
            n = first if k == 0 else 1024
            expected.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(expected, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 1024


def test_op8(spark, tables):
    kinds, got = run(spark, tables, "op8_warc")
    assert kinds[:5] == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    first, expected = {}, []
    for i, _, html in tables[3]:
        b = (html or "").encode()
        least = first.setdefault(b, i) if len(b) >= 100 else i
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if least == i else "revisit", None if least == i else least))
    assert sorted(tuple(r.values())[:5] for r in got) == sorted(expected)


def test_op9(spark, tables):
    kinds, got = run(spark, tables, "op9_toxicity")
    assert kinds[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(i) for i, _ in tables[1])
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_op10(spark, tables):
    kinds, got = run(spark, tables, "op10_simhash")
    assert kinds[:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    fps = [fingerprint(t) for _, t in tables[1]]
    roots, least = classes(fps), {}
    for (i, _), root in zip(tables[1], roots):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    expected = [(i, f"{fp:016x}", least.get(root)) for (i, _), fp, root in zip(tables[1], fps, roots)]
    assert sorted((tuple(r.values())[:3] for r in got), key=str) == sorted(expected, key=str)
