"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, discard, shared_dir, stash

__all__ = ["bounded_rank", "buckets_for", "discard", "forget", "id_text", "lean", "plain", "remembered", "shared_dir", "skewed_lookup", "stash"]

#: Keys holding more than 1/HOT_SHARE of all rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 512
T = TypeVar("T")
_REMEMBERED: dict[Hashable, object] = {}


def remembered(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, once for the tasks that follow one another in a worker process; a worker remembers one thing at a time.

    Workers outlive an operator, so without this each stage of a pipeline would hold what those before it remembered.
    """
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """Let go of what an operator before this one remembered; for operators that remember nothing from task to task."""
    _REMEMBERED.clear()
    pa.default_memory_pool().release_unused()


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow keeps of those before for further use is given back at each."""
    for b in batches:
        pa.default_memory_pool().release_unused()
        yield b


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text (null: empty), under fixed names, whatever other columns there are."""
    bound_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def plain(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names with dots, and names that meet ours, are put back at the end by ``toDF``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def skewed_lookup(left: DataFrame, right: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` (one row per key, ``n_col`` the rows of ``left`` with it).

    Keys with more than ``total / HOT_SHARE`` rows number fewer than HOT_SHARE, so that side is broadcast whatever the
    size of the table; all other keys meet in a shuffle join, in which no key is hot.
    """
    limit = max(1, total // HOT_SHARE)
    right = right.select(key, *[c for c in right.columns if c != key])
    hot = F.broadcast(right.where(F.col(n_col) > limit))
    cold = right.where(F.col(n_col) <= limit)
    with_hot = left.join(hot, key)
    with_cold = left.join(F.broadcast(right.where(F.col(n_col) > limit).select(key)), key, "left_anti").join(cold, key)
    return with_hot.unionByName(with_cold).drop(n_col)


def buckets_for(rows: int, per_bucket: int = 100_000) -> int:
    return max(1, -(-rows // per_bucket))


def bounded_rank(df: DataFrame, group: list[str], order: list[Column], spread: Column, buckets: int, name: str) -> DataFrame:
    """Number the rows of each group from 0, without one task per group.

    Rows are spread over ``buckets`` by ``spread`` (an integer expression). Counts per (group, bucket) give each bucket
    its offset; a window then ranks within (group, bucket). ``df`` must be cheap to read twice and deterministic.
    """
    from pyspark.sql import Window

    df = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*group, "_bucket").count().select(*group, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, [*group, "_bucket"]).withColumn(name, (F.col("_offset") + F.col("_rank")).cast("long")).drop("_bucket", "_offset", "_rank")
