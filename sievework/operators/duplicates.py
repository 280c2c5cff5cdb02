"""Exact duplicates and fingerprints over record digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import record_digest

PREFIX = "sieve:"
#: The prefix of ``tree_fingerprint``, and what reports call it.
TREE_PREFIX = "sievetree:"
TREE = "normalized_record_multiset_sha256_tree"


def with_digest(df: DataFrame, columns: list[str] | None = None, strip: bool = True, name: str = "digest") -> DataFrame:
    return df.withColumn(name, record_digest(df, strip, columns))


def duplicate_groups(digests: DataFrame) -> DataFrame:
    """(digest, n): how often each record occurs."""
    return digests.groupBy("digest").agg(F.count("*").alias("n"))


def duplicate_counts(digests: DataFrame) -> DataFrame:
    """One row: total, unique and duplicate records. Each distinct digest is shuffled once, after map-side counting."""
    counted = duplicate_groups(digests).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_records"), F.count("*").alias("unique_records"))
    return counted.withColumn("duplicate_records", F.col("total_records") - F.col("unique_records"))


def exact_duplicates(digests: DataFrame) -> dict:
    r = duplicate_counts(digests).first()
    rate = r["duplicate_records"] / r["total_records"] if r["total_records"] else 0.0
    return {"total_records": r["total_records"], "unique_records": r["unique_records"], "duplicate_records": r["duplicate_records"], "duplicate_rate": round(rate, 6)}


def fingerprint(digests: DataFrame, prefix: str = PREFIX) -> str:
    """SHA-256 over the sorted digests, a line each; independent of row order, 16 hex digits.

    The sort is distributed. The digest of digests is one stream by its definition: equal digests arrive as a count, and
    the driver hashes partition after partition without holding them. ``tree_fingerprint`` has no such stream.
    """
    counted, h, empty = duplicate_groups(digests).orderBy("digest"), hashlib.sha256(), True
    for r in counted.toLocalIterator(prefetchPartitions=True):
        empty = False
        line = r["digest"].encode() + b"\n"
        for _ in range(r["n"] // 4096):
            h.update(line * 4096)
        h.update(line * (r["n"] % 4096))
    return prefix + (hashlib.sha256(b"empty") if empty else h).hexdigest()[:16]


def tree_fingerprint(digests: DataFrame, prefix: str = TREE_PREFIX, digits: int = 4) -> str:
    """Another order-independent fingerprint, for tables too large for one stream: two levels of hashing.

    Digests are counted; those that share their first ``digits`` are hashed together in order, then these hashes are.
    Choose digits so that a group (rows / 16^digits) fits a task.
    """
    lines = duplicate_groups(digests).select(F.substring("digest", 1, digits).alias("g"), F.concat("digest", F.lit(":"), F.col("n").cast("string")).alias("line"))
    groups = lines.groupBy("g").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("h")).orderBy("g")
    h = hashlib.sha256()
    for r in groups.toLocalIterator(prefetchPartitions=True):
        h.update(f"{r['g']}:{r['h']}\n".encode())
    return prefix + h.hexdigest()[:16]
