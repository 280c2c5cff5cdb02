import re

import numpy as np
import pytest
import xxhash
from helpers import corpus, documents
from pyspark.sql import functions as F

from sievework.llm import simhash
from sievework.llm.components import components


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Least member of each one's class, by all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4):
            x, y = find(i), find(i + 1 + int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_against_all_pairs(spark):
    rows = corpus()
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [fingerprint(t) for _, t in rows]
    least = {}
    for (i, _), root in zip(rows, classes(fps)):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    expected = sorted((i if i is not None else -1, fp, least.get(root, -1)) for (i, _), fp, root in zip(rows, fps, classes(fps)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % 2**64, r["component_id"] if r["component_id"] is not None else -1) for r in got) == expected


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.deduplicate(documents(spark, [])).columns == documents(spark, []).columns


@pytest.mark.parametrize("levels, block", [(1, 8192), (2, 16), (2, 8192), (3, 16)])
def test_links_connect_what_brute_force_connects(spark, levels, block):
    rng = np.random.default_rng(levels)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    points = {0, 2**64 - 1}
    for c in centres.tolist():
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 9), replace=False).tolist()
            points.add(c ^ sum(1 << b for b in flips))
    points = sorted(points)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "fp long")
    found = {r["node"] % 2**64: r["root"] for r in components(simhash.links(df, levels, block)).collect()}
    expected = classes(points)
    groups = {}
    for p, root in zip(points, expected):
        groups.setdefault(root, set()).add(p)
    for group in groups.values():
        roots = {found.get(p) for p in group}
        assert len(roots) == 1 and (len(group) == 1) == (roots == {None})
    assert len({found[p] for p in points if p in found}) == sum(len(g) > 1 for g in groups.values())


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    counts = [np.stack([np.bitwise_count((x >> np.uint64(2 * s)) & np.uint64(3)) for s in range(32)], axis=1).astype(int) for x in (a, b)]
    manhattan = np.abs(counts[0] - counts[1]).sum(axis=1)
    assert (np.bitwise_count(simhash._unary(a) ^ simhash._unary(b)) == manhattan).all() and (manhattan <= np.bitwise_count(a ^ b)).all()


def test_embedding_column_equals_numpy(spark):
    values = [0, -1, 1, 2**62, -(2**63), 0x1234567890ABCDEF]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "fp long").select(simhash.embedding()).collect()]
    assert got == simhash._unary(np.array(values, dtype=np.int64).view(np.uint64)).view(np.int64).tolist()


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = corpus()
    docs = documents(spark, rows)
    kept = simhash.deduplicate(docs).collect()
    roots = classes([fingerprint(t) for _, t in rows])
    assert len(kept) == len(set(roots))
    best = {}
    for (i, t), root in zip(rows, roots):
        best[root] = min(best.get(root, (True, 0)), (i is None, i or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(best.values())
    assert docs.where(F.col("doc_id") == 5).count() == 3 and sum(r["doc_id"] == 5 for r in kept) == 1


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 500)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(500)}}
