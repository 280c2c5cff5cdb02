from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievework.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, uid int, norm string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "n", 2) for i, v in rows], SCHEMA)


def vectors(n, dim=8, seed=0, skew=False):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)) * (rng.pareto(1.5, (n, 1)) + 0.1 if skew else 1.0)
    v[: n // 3] = v[0]  # a third are copies
    return v.astype(np.float32)


ODD = [(9000, None), (9020, [1.0] * 7 + [None]), (9040, [float("nan")] * 8), (9060, [float("inf")] + [0.0] * 7), (9080, [0.0] * 8), (9100, [1.0, 2.0]), (9120, [2.0, 1.0]), (9101, [3.0, 3.0])]


def usable(rows, zero_ok=True):
    """The vectors that take part."""
    ok = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero_ok or any(v)):
            ok.append((i, np.array(v, dtype=np.float32).astype(np.float64)))
    return ok


def brute_top(rows, k, every):
    """(query's place, its id) and its answers, each row for itself."""
    q = [(i, [int(c) for c in np.floor(64 * x)]) for i, x in usable(rows)]
    out = []
    for n, (i, x) in enumerate(q):
        if i is not None and i % every == 0:
            last = 2**63
            scores = sorted((-sum(a * b for a, b in zip(x, y)), last if j is None else j) for m, (j, y) in enumerate(q) if m != n and len(y) == len(x))[:k]
            out.append((i, [(r, None if j == last else j, -s) for r, (s, j) in enumerate(scores, 1)]))
    return out


@pytest.mark.parametrize("skew", [False, True])
@pytest.mark.parametrize("block", [64, 16384])
def test_top_k_against_brute_force(spark, skew, block):
    v = vectors(400, seed=3, skew=skew)
    rows = [(i, x) for i, x in enumerate(v.tolist())] + ODD + [(40, v[40].tolist()), (None, v[7].tolist()), (None, (3 * v[200]).tolist())]
    got = [(r["query_id"], (r["rank"], r["vec_id"], r["score"])) for r in topk.top_k(table(spark, rows), k=5, block=block, query_block=8, bucket=16).collect()]
    expected = [(i, a) for i, answers in brute_top(rows, 5, 20) for a in answers]
    assert sorted(got, key=str) == sorted(expected, key=str)  # the repeated query 40 asks twice
    assert {i for i, _ in got} == {i for i, x in usable(rows) if i is not None and i % 20 == 0}


def test_pruning_is_by_buckets_at_any_size():
    rng = np.random.default_rng(2)
    told = {}
    alike = rng.standard_normal((10, 8))[rng.integers(0, 10, 2000)] + 0.1 * rng.standard_normal((2000, 8))
    for name, v in (("alike", alike / np.linalg.norm(alike, axis=1, keepdims=True)), ("lengths", rng.standard_normal((2000, 8)) * (rng.pareto(1.5, (2000, 1)) + 0.1))):
        c = np.floor(64 * v)
        norm = np.linalg.norm(c, axis=1)
        block = pa.table({"uid": np.arange(2000), "vec_id": np.arange(2000), "norm": norm, "vec": [x.tobytes() for x in c]})
        asking = pa.table({"key": [str(i) for i in range(0, 2000, 20)], "norm": norm[::20], "vec": [x.tobytes() for x in c[::20]]})
        told[name] = Counter()
        topk.search_block(asking, block, 21, 128, told[name])
    assert told["alike"]["by coordinates"] > 0 and told["lengths"]["skipped"] > 0
    assert told["lengths"]["products"] < 100 * 2000 / 2


def test_coordinate_bounds_lose_nothing():
    rng = np.random.default_rng(5)
    c = rng.standard_normal((4000, 6))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for _ in range(50):
        q = rng.standard_normal(6)
        q /= np.linalg.norm(q)
        for t in (0.6, 0.8, 0.95):
            assert set(np.flatnonzero(c @ q >= t)) <= set(topk._coordinates(c, q, t).tolist())


def test_large_components_stay_exact(spark):
    rows = [(20, [2.0**40, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 3.015625])]
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(table(spark, rows)).orderBy("rank").collect()]
    assert got == [(2, 2**46 * 2**16 + 64 * 193), (1, 2**46 * 2**16 + 64 * 192)]
    rows = [(20, [3e38, 1.0]), (1, [3e38, 3.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])]
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(table(spark, rows)).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 4096), (2, -(2**63))]


def test_empty(spark):
    assert topk.top_k(table(spark, [])).count() == 0 and ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(50, [1.0, 0.0])])).count() == 0
    assert ann.nearest(table(spark, [(50, [1.0, 0.0]), (None, [1.0, 1.0])])).collect()[0][:3] == (50, 1, None)


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 8)) * 3
    v = (centres[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 8))).astype(np.float32)
    v[1000:1600] = v[1000]
    rows = [(i, x) for i, x in enumerate(v.tolist())] + ODD
    found = ann.nearest(table(spark, rows), block=512, query_block=16).collect()
    good = usable(rows, zero_ok=False)
    ids = np.array([i for i, x in good if len(x) == 8])
    m = np.stack([x for _, x in good if len(x) == 8])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    at = {i: k for k, i in enumerate(ids.tolist())}
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        if r["query_id"] in at:
            assert abs(r["score"] - unit[at[r["query_id"]]] @ unit[at[r["vec_id"]]]) < 1e-12
    hits = total = 0
    for i in ids[ids % 50 == 0].tolist():
        s = unit @ unit[at[i]]
        s[at[i]] = -2
        least = np.sort(s)[-5]
        hits += sum(s[at[j]] >= least - 1e-12 for j, _ in got[i])
        total += 5
        assert got[i] == sorted(got[i], key=lambda x: (-x[1], x[0])) and len(got[i]) == 5
    assert hits / total >= 0.9
    assert [j for j, _ in got[9100]] == [9101, 9120]  # two numbers each, so these three are searched by themselves


@pytest.mark.parametrize("rows_a_part, levels", [(150, 1), (20, 2)])
def test_recall_where_parts_are_pruned(spark, tmp_path, rows_a_part, levels):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((400, 16))
    v = (centres[rng.integers(0, 400, 50_000)] + 0.4 * rng.standard_normal((50_000, 16))).astype(np.float32)
    v[:16_000] = v[0]  # a third are copies
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 16).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    rows = ann.stash(ann.packed(df, "vec_id", "embedding"), "rows")
    points = rows.groupBy("key").agg(F.first("vec").alias("vec"))
    placed, routes, told = ann.index(points, ann.asked(rows, 50), 34_001, rows_a_part=rows_a_part)
    assert len(told) == levels and placed.count() == 34_001 and told[0][1] < told[0][0] / 3, told
    got = ann.nearest(df, rows_a_part=rows_a_part).toPandas()
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for i, mine in got.groupby("query_id"):
        s = unit @ unit[i]
        s[i] = -2
        assert len(mine) == 5 and i not in set(mine["vec_id"])
        hits += (s[mine["vec_id"].to_numpy()] >= np.partition(s, -5)[-5] - 1e-12).sum()
        if i < 16_000:
            assert sorted(mine["vec_id"]) == [j for j in range(6) if j != i][:5]
    assert got["query_id"].nunique() == 1000 and hits / 5000 >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = ann._unit(rng.standard_normal((2000, 16)))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 16)
    size = np.bincount(part, minlength=16)
    assert size.max() <= np.ceil(2000 / 16 * 1.15) and size.min() > 0
