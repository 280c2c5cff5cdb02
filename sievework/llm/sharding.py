"""Uniform shuffling into shards of exact sizes through a hypergeometric communication matrix.

How many rows each partition sends to each shard is drawn exactly, as it would come about in a uniform shuffle: a
multivariate hypergeometric draw for one partition after another. Rows are permuted within their partition, cut by the
matrix's row, exchanged, and permuted again within their shard. All orders come from hashes of a row's place in the
written key table, so a lost executor's work is redone with the same result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rank, buckets_for, plain, stash

SHARDS = 40
SEED = 20240607
_NUMPY_LIMIT = 10**9


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw, also beyond the populations that numpy takes: inversion over all values within 40 deviations of the mode."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    wide = 40 * (1 + math.isqrt(n * good // total * bad // total + 1))
    k = np.arange(max(low, mode - wide), min(high, mode + wide) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[1:]) * (bad - n + k[1:]))
    p = np.concatenate(([0.0], np.cumsum(steps)))
    p = np.cumsum(np.exp(p - p.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1], "right").clip(0, len(k) - 1)])


def communication_matrix(sources: list[int], targets: list[int], seed: int = SEED) -> np.ndarray:
    """Rows sent from each source to each target; the sums are exact both ways."""
    rng, left = np.random.default_rng(seed), list(targets)
    matrix = np.zeros((len(sources), len(targets)), dtype=np.int64)
    for i, n in enumerate(sources):
        rest = sum(left)
        if rest < _NUMPY_LIMIT:
            matrix[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
            left = (np.array(left) - matrix[i]).tolist()
            continue
        for j, room in enumerate(left):
            rest -= room
            take = n if not rest else _hypergeometric(rng, room, rest, n) if n and room else 0
            matrix[i, j], n = take, n - take
        left = [a - int(b) for a, b in zip(left, matrix[i])]
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard (sizes at most one apart) and slot (gapless from 0 in each shard) to all rows of ``df``.

    Every row counts as itself: repeated rows, null ids and null texts are shuffled like any other, and no rows give no
    rows. Columns of ``df`` may have any names; where it has a shard or slot already, the new ones get a trailing
    underscore. The driver holds one row of counts per partition, never rows of data; no task holds a whole shard.
    """
    given = plain(df)
    placed = stash(given.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "shard-rows")
    counts = placed.groupBy("_part").count().orderBy("_part").collect()
    total = sum(r["count"] for r in counts)
    matrix = communication_matrix([r["count"] for r in counts], shard_sizes(total, shards), seed)
    cuts = df.sparkSession.createDataFrame([(r["_part"], row) for r, row in zip(counts, np.cumsum(matrix, axis=1).tolist())], "_part int, _cuts array<long>")
    permuted = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_at"), "_at")
    sent = (
        placed.withColumn("_rank", F.row_number().over(permuted) - 1)
        .join(cuts, "_part")
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))))
        .drop("_rank", "_cuts", "_part")
    )
    sent = stash(sent, "sent")
    again = F.xxhash64(F.lit(seed + 1), "_at")
    out = bounded_rank(sent, ["shard"], [F.xxhash64(F.lit(seed + 2), "_at"), F.col("_at")], again, buckets_for(-(-total // shards)), "slot")
    new = ["shard", "slot"]
    for i, n in enumerate(new):
        while new[i] in df.columns:
            new[i] += "_"
    return out.select(*given.columns, "shard", "slot").toDF(*df.columns, *new)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Each shard a folder of files in the order of their slots."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(keys).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
