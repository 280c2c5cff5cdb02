"""What the vector operators share: valid rows in a compact form, one point for copies, blocks of bounded size, and ranking.

Searches run between distinct vectors. Of rows with equal vectors only the k + 1 with the least ids can be among the k
best of any query, and rows with equal vectors have the same answers but for themselves; so a vector that a third of all
rows hold is searched once, and found at most k + 1 times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import skewed_lookup, stash


def _component_ok(x: Column) -> Column:
    y = F.abs(x.cast("double"))
    return F.coalesce(y < F.lit(float("inf")), F.lit(False))


def _length(v: np.ndarray) -> float:
    most = np.abs(v).max() if len(v) else 0.0
    return float(most * np.sqrt(np.square(v / most).sum())) if most > 0 else 0.0


def packed(df: DataFrame, id_col: str, vec_col: str, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(uid, vec_id, dim, norm, vec, key): vec holds doubles, norm is their length, equal vectors have equal keys.

    Null vectors and those with null, NaN or infinite components are left out. uid tells repeated rows apart; write the
    result before it is used twice.
    """
    valid = F.coalesce(F.forall(df[vec_col], _component_ok), F.lit(False))
    rows = df.where(valid).select(F.monotonically_increasing_id().alias("uid"), df[id_col].cast("long").alias("vec_id"), df[vec_col].cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            flat = change(flat) if change else flat
            vecs = [flat[a:z] for a, z in zip(ends, ends[1:])]
            norms = [_length(v) for v in vecs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(v) for v in vecs], pa.int32()), pa.array(norms, pa.float64()), pa.array([v.tobytes() for v in vecs], pa.binary())],
                names=["uid", "vec_id", "dim", "norm", "vec"],
            )

    return rows.mapInArrow(run, "uid long, vec_id long, dim int, norm double, vec binary").withColumn("key", F.sha2("vec", 256))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Rows that can be among the k best besides the query's own: of equal vectors, the k + 1 with the least ids."""
    order = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")


def asked(rows: DataFrame, every: int) -> DataFrame:
    """(key, dim, norm, vec, asks): the distinct vectors of the query rows, and how many rows ask for each."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("key").agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.first("vec").alias("vec"), F.count("*").alias("asks"))


def matrix(table: pa.Table, name: str = "vec") -> np.ndarray:
    rows = table.column(name).to_pylist()
    if not rows:
        return np.empty((0, 0))
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    falling = -scores[at] if scores.dtype.kind == "f" else ~scores[at]  # the least long has no negative
    return at[np.lexsort((ids[at], falling))][:k]


def ids_of(block: pa.Table) -> np.ndarray:
    """Ids to order by; a missing one comes last."""
    return block.column("vec_id").fill_null(2**63 - 1).to_numpy()


def answers(found: DataFrame, queries: DataFrame, rows: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row, itself left out.

    ``found`` has (key, uid, vec_id, score), at least the k + 1 best of each distinct query that its blocks gave;
    ``queries`` comes from ``asked``. The k + 1 best meet the query rows by their key, however many hold it.
    """
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "uid", "vec_id", "score"))).alias("top"))
    lists = stash(lists.join(queries.select("key", "asks"), "key"), "answers")
    total = lists.agg(F.coalesce(F.sum("asks"), F.lit(0))).first()[0]
    asking = rows.where(F.col("vec_id") % every == 0).select("key", "uid", F.col("vec_id").alias("query_id"))
    met = skewed_lookup(asking, lists, "key", "asks", total)
    own = F.slice(F.filter("top", lambda a: a["uid"] != F.col("uid")), 1, k)
    return met.select("query_id", F.posexplode(own).alias("at", "a")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "a.vec_id", "a.score")


def cogrouped(queries: DataFrame, blocks: DataFrame, key: list[str], answer: Callable[[pa.Table, pa.Table], pa.Table], kinds: str) -> DataFrame:
    """``answer`` for each pair of query block and vector block. Queries get column names of their own on the way, as both sides come from one table."""
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return answer(a.rename_columns([c[2:] for c in a.column_names]), b)

    return asked.groupBy(*[f"q_{c}" for c in key]).cogroup(blocks.groupBy(*key)).applyInArrow(run, kinds)
