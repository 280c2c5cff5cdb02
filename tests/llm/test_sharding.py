import zlib

import numpy as np
from helpers import corpus, documents

from sievework.llm import sharding


def test_shards_are_exact_and_gapless(spark):
    rows = corpus(400)
    docs = documents(spark, rows).repartition(7)
    got = sharding.shuffle_into_shards(docs, 11).collect()
    assert len(got) == len(rows) and sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(11)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffle_into_shards(documents(spark, []), 4).count() == 0
    few = sharding.shuffle_into_shards(documents(spark, rows[:3]), 40).collect()
    assert len({r["shard"] for r in few}) == 3


def test_matrix_sums_and_law():
    sources, targets = [100, 0, 37, 263], sharding.shard_sizes(400, 7)
    m = sharding.communication_matrix(sources, targets)
    assert m.sum(axis=1).tolist() == sources and m.sum(axis=0).tolist() == targets and (m >= 0).all()
    first = [sharding.communication_matrix([30, 70], [50, 50], seed)[0, 0] for seed in range(4000)]
    variance = 30 * 0.5 * 0.5 * 70 / 99
    assert abs(np.mean(first) - 15) < 4 * (variance / 4000) ** 0.5 and abs(np.var(first) / variance - 1) < 0.15


def test_large_populations_by_inversion():
    rng = np.random.default_rng(2)
    draws = [sharding._hypergeometric(rng, 10**9, 3 * 10**9, 10_000) for _ in range(2000)]
    variance = 10_000 * 0.25 * 0.75
    assert abs(np.mean(draws) - 2500) < 4 * (variance / 2000) ** 0.5 and abs(np.var(draws) / variance - 1) < 0.2


def test_rows_spread_evenly_over_shards_and_slots(spark):
    rows = spark.range(4000).repartition(5)
    got = sharding.shuffle_into_shards(rows, 4).collect()
    place = np.array([[r["id"], r["shard"], r["slot"]] for r in got])
    assert abs(np.corrcoef(place[:, 0], place[:, 1])[0, 1]) < 0.07 and abs(np.corrcoef(place[:, 0], place[:, 2])[0, 1]) < 0.07


def test_query_columns(spark, tmp_path):
    rows = corpus(20)
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op6_sharding(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_names_of_columns_do_not_matter(spark):
    names = ["shard", "slot", "_part", "_at", "_rank", "_cuts", "_bucket", "a.b", "slot_"]
    df = spark.createDataFrame([tuple(i * 10 + k for k in range(9)) for i in range(50)], ", ".join(f"`{n}` long" for n in names))
    got = sharding.shuffle_into_shards(df, 3)
    assert got.columns == [*names, "shard_", "slot__"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[:9] for r in rows) == [tuple(i * 10 + k for k in range(9)) for i in range(50)]
    assert sorted(r[9:] for r in rows) == [(s, k) for s in range(3) for k in range(sharding.shard_sizes(50, 3)[s])]
