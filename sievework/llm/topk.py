"""Exact top-k search by inner product over norm buckets.

Vectors are ranked by length, longest first, and cut into buckets; some buckets make a block, which is what travels. A
query goes through the buckets of a block in turn. Its k-th best score so far, over the lengths of the query and of the
bucket's longest vector, is the local cosine threshold: above one, the bucket and all after it are skipped; when it is
high, the ranges that the query's largest coordinates leave for a candidate's prune the bucket; when it is low, only length
does. What is left is verified by the product. The block of the longest vectors goes first, for all queries; the scores
reached there tell which other blocks a query goes to at all.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import stash
from .vectors import answers, asked, best, candidates, cogrouped, ids_of, matrix, packed

K = 20
EVERY = 20
QUERY_BLOCK = 2048
BLOCK = 16384
#: Vectors of one bucket, the unit of pruning.
BUCKET = 512
#: Local cosine thresholds from here on are worth pruning by coordinates.
COORDINATES_FROM = 0.6
_FOUND = pa.schema([("key", pa.string()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(64.0 * x)


def _products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products, in doubles while these hold them exactly; what a long can't hold becomes its bound."""
    if c.size and np.abs(c).max() * np.abs(q).max() * c.shape[1] >= 2.0**53:
        exact = ((sum(int(a) * int(b) for a, b in zip(x, y)) for y in c) for x in q)
        return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in exact], dtype=np.int64).reshape(len(q), len(c))
    return (q @ c.T).astype(np.int64)


def _coordinates(unit: np.ndarray, q: np.ndarray, cosine: float) -> np.ndarray:
    """Candidates whose coordinates allow the cosine, by the query's three largest coordinates."""
    keep = np.ones(len(unit), dtype=bool)
    for f in np.argsort(-np.abs(q))[:3]:
        mid, half = q[f] * cosine, np.sqrt(max(0.0, 1 - q[f] ** 2) * max(0.0, 1 - cosine**2)) + 1e-9
        # beyond the cone's edge only one side bounds: the far side may come closer to the query itself
        low, high = mid - half, mid + half
        if cosine < abs(q[f]):
            low, high = (low, 1.0) if q[f] > 0 else (-1.0, high)
        keep &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
    return np.flatnonzero(keep)


def search_block(queries: pa.Table, block: pa.Table, k: int, bucket: int = BUCKET, told: Counter | None = None) -> pa.Table:
    """The k best vectors of one block for each of a block of queries; none under the query's threshold ``least``, if it has one.

    ``told`` counts what was pruned: pairs of query and bucket met by length, by coordinates or skipped, and products.
    """
    none = _FOUND.empty_table()
    if not queries.num_rows or not block.num_rows:
        return none
    c_norm = block.column("norm").to_numpy()
    order = np.lexsort((ids_of(block), -c_norm))
    block, c_norm = block.take(pa.array(order)), c_norm[order]
    c, c_id = matrix(block), ids_of(block)
    q, q_norm, keys = matrix(queries), queries.column("norm").to_numpy(), queries.column("key").to_pylist()
    least = np.array(queries.column("least").to_numpy()) if "least" in queries.column_names else np.full(len(q), -np.inf)
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64),) * 2 for _ in keys]
    told = Counter() if told is None else told

    def keep(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        at, scores = np.concatenate((held[i][0], at)), np.concatenate((held[i][1], scores))
        top = best(scores, c_id[at], k)
        held[i] = at[top], scores[top]
        if len(top) == k:
            least[i] = max(least[i], float(scores[top[-1]]))

    for s in range(0, len(c), bucket):
        z = min(s + bucket, len(c))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(least > 0, least / q_norm, -np.inf)  # the length that an answer has at least
            cosine = np.where(least > 0, need / c_norm[s], -1.0)
        alive = np.flatnonzero(cosine <= 1 + 1e-9)
        told["skipped"] += len(q) - len(alive)
        if not len(alive):
            break
        coordinates = alive[cosine[alive] >= COORDINATES_FROM]
        if len(coordinates):
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = np.nan_to_num(c[s:z] / c_norm[s:z, None])
            for i in coordinates.tolist():
                at = _coordinates(unit, q[i] / q_norm[i], min(1.0, cosine[i]))
                told["products"] += len(at)
                if len(at):
                    scores = _products(c[s + at], q[i : i + 1])[0]
                    ok = scores >= least[i]
                    if ok.any():
                        keep(i, s + at[ok], scores[ok])
            told["by coordinates"] += len(coordinates)
        by_length = alive[cosine[alive] < COORDINATES_FROM]
        told["by length"] += len(by_length)
        upto = s + np.searchsorted(-c_norm[s:z], -need[by_length] * (1 - 1e-12), "right")
        for t in range(0, len(by_length), 256):
            some, ends = by_length[t : t + 256], upto[t : t + 256]
            scores = _products(c[s : ends.max()], q[some])
            told["products"] += int((ends - s).sum())
            rows, at = np.nonzero((scores >= least[some][:, None]) & (np.arange(s, ends.max()) < ends[:, None]))
            cuts = np.searchsorted(rows, np.arange(len(some) + 1))
            for j, i in enumerate(some.tolist()):
                if cuts[j] < cuts[j + 1]:
                    mine = at[cuts[j] : cuts[j + 1]]
                    keep(i, s + mine, scores[j, mine])
    took = [len(at) for at, _ in held]
    at = pa.array(np.concatenate([at for at, _ in held]))
    return pa.table([pa.array(keys).take(pa.array(np.repeat(np.arange(len(q)), took))), block.column("uid").take(at), block.column("vec_id").take(at), pa.array(np.concatenate([x for _, x in held]))], schema=_FOUND)


def _cogrouped(queries: DataFrame, blocks: DataFrame, k: int, bucket: int) -> DataFrame:
    return cogrouped(queries, blocks, ["qb", "cb"], lambda a, b: search_block(a, b, k, bucket), "key string, uid long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all other rows.

    Vectors are turned into floor(64 x); null vectors and those with null or non-finite components take no part, and
    rows without an id are candidates, last among ties, but no queries. Only vectors of a query's own dimension are its
    candidates. A repeated row is a candidate of its twin, and asks for itself. Products beyond a long count as its bound.
    No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = stash(packed(vectors, id_col, vec_col, _quantised), "quantised")
    queries = stash(asked(rows, every), "queries")
    placed = global_rank(candidates(rows, k), ["dim", F.desc("norm"), "uid"], "place")
    # dimensions follow one another, each with blocks of its own: (dim, first place, first block, blocks, query blocks)
    n_q = {r["dim"]: r["count"] for r in queries.groupBy("dim").count().collect()}
    dims, place, first = [], 0, 0
    for r in placed.groupBy("dim").count().orderBy("dim").collect():
        blocks, q_blocks = -(-r["count"] // block), max(1, -(-n_q.get(r["dim"], 0) // query_block))
        dims.append((r["dim"], place, first, blocks, q_blocks))
        place, first = place + r["count"], first + blocks
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    listed = spark.createDataFrame(dims, "dim int, from_place long, from_block long, blocks long, q_blocks long")
    named = stash(placed.join(listed, "dim").select("uid", "vec_id", "norm", "vec", "dim", (F.col("from_block") + F.floor((F.col("place") - F.col("from_place")) / block)).alias("cb")), "blocked")
    queries = queries.join(listed, "dim").select("key", "norm", "vec", "dim", "asks", "q_blocks", "from_block", F.pmod(F.xxhash64("key"), F.col("q_blocks")).alias("q0"))
    # the longest block of each dimension first
    for_first = named.join(listed.select("from_block", "q_blocks"), F.col("cb") == F.col("from_block")).select("uid", "vec_id", "norm", "vec", "cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)).alias("qb"))
    found = [stash(_cogrouped(queries.select("key", "norm", "vec", F.col("q0").alias("qb"), F.col("from_block").alias("cb")), for_first, k + 1, bucket), "first")]
    if any(d[3] > 1 for d in dims):
        least = found[0].groupBy("key").agg(F.when(F.count("*") > k, F.min("score").cast("double")).alias("least"))
        sure = stash(queries.join(least, "key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "asked")
        # a block of queries needs vectors as long as its least demanding query does: the first blocks of its dimension
        need = F.min(F.when((F.col("least") > 0) & (F.col("norm") > 0), F.col("least") / F.col("norm") * (1 - 1e-9)).otherwise(F.lit(float("-inf"))))
        demand = {}
        for r in sure.groupBy("dim", "q0").agg(need.alias("need")).collect():
            demand.setdefault(r["dim"], []).append((r["need"], r["q0"]))
        longest = {r["cb"]: r["longest"] for r in named.groupBy("cb").agg(F.max("norm").alias("longest")).collect()}
        asks, met = [], []
        for dim, _, b0, blocks, _ in dims:
            wants = sorted(demand.get(dim, []))
            lengths, needs = np.array([longest[b0 + b] for b in range(blocks)]), np.array([n for n, _ in wants])
            asks += [(dim, q0, i, int(np.searchsorted(-lengths, -n, "right"))) for i, (n, q0) in enumerate(wants)]
            met += [(b0 + b, int(np.searchsorted(needs, lengths[b], "right"))) for b in range(1, blocks)]
        upto = spark.createDataFrame(asks, "dim int, q0 long, qb long, upto long")
        sent = sure.join(upto, ["dim", "q0"]).where("upto > 1").withColumn("cb", F.explode(F.sequence(F.col("from_block") + 1, F.col("from_block") + F.col("upto") - 1)))
        given = named.join(spark.createDataFrame(met, "cb long, upto long"), "cb").where("upto > 0").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto") - 1)))
        found.append(_cogrouped(sent.select("key", "norm", "vec", "least", "qb", "cb"), given.select("uid", "vec_id", "norm", "vec", "qb", "cb"), k + 1, bucket))
    every_found = found[0].unionByName(found[1]) if len(found) > 1 else found[0]
    return answers(every_found, queries, rows, every, k)


#: Brute force in DuckDB: the same integers, all products, ties to the smaller id.
OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.uid <> c.uid AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op3_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
