"""Approximate nearest neighbours in learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts; a small classifier learns the parts of a vector and
of its neighbours. Every row is indexed under its most probable part, and a query is routed to several, as many as a
held-out part of the sample needs; their rows are ranked by the exact cosine. Parts that are still large are partitioned
again in the same way, each by a sample and a classifier of its own, so that the rows of a part stay the same at any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .vectors import answers, asked, best, candidates, cogrouped, ids_of, matrix, packed

K = 5
EVERY = 50
#: Vectors of the sample that a graph and its classifier are made from; chosen by hash, so about as many.
SAMPLE = 12_000
NEIGHBOURS = 10
#: Rows of a part, and the parts that one classifier tells apart at most; more rows take another level.
ROWS_A_PART = 150
PARTS = 512
#: Share of a held-out query's neighbours that the parts it is routed to hold, over all levels.
ROUTED = 0.95
QUERY_BLOCK = 2048
BLOCK = 16384
SEED = 7
_FOUND = pa.schema([("key", pa.string()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each unit vector's k nearest others."""
    k = min(k, len(x) - 1)
    y, out = x.astype(np.float32), np.empty((len(x), k), dtype=np.int64)
    for s in range(0, len(x), 512):
        scores = y[s : s + 512] @ y.T
        scores[np.arange(len(scores)), np.arange(s, s + len(scores))] = -np.inf
        out[s : s + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.15) -> np.ndarray:
    """Cut the graph into parts of nearly equal size: median splits first, then moves to where most neighbours are."""
    rng = np.random.default_rng(SEED)
    part = np.zeros(len(x), dtype=np.int64)
    todo, next_part = [(np.arange(len(x)), parts)], 0
    while todo:
        rows, n = todo.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = next_part
            next_part += 1
            continue
        y = x[rows] - x[rows].mean(axis=0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        order = np.argsort(y @ v, kind="stable")
        cut = len(rows) * (n // 2) // n
        todo += [(rows[order[:cut]], n // 2), (rows[order[cut:]], n - n // 2)]
    room = int(np.ceil(len(x) / parts * slack))
    size = np.bincount(part, minlength=parts)
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[i].append(j)
            back[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            votes = np.bincount(part[back[i]], minlength=parts)
            own = part[i]
            votes[(size >= room) & (np.arange(parts) != own)] = -1
            to = int(votes.argmax())
            if votes[to] > votes[own]:
                size[own] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < len(x) // 200:
            break
    return part


class Router:
    """One hidden layer from unit vectors to part probabilities."""

    def __init__(self, dim: int, parts: int, hidden: int = 128) -> None:
        rng = np.random.default_rng(SEED)
        self.w = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.maximum(x * np.sqrt(x.shape[1]) @ w1 + b1, 0) @ w2 + b2

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 2e-3) -> None:
        rng = np.random.default_rng(SEED)
        first, second, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        x = x * np.sqrt(x.shape[1])
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                a, want = x[order[s : s + batch]], target[order[s : s + batch]]
                w1, b1, w2, b2 = self.w
                h = np.maximum(a @ w1 + b1, 0)
                z = h @ w2 + b2
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = (p - want) / len(a)
                dh = (d @ w2.T) * (h > 0)
                t += 1
                for i, g in enumerate((a.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.w[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)


def learn(x: np.ndarray, parts: int, k: int = K, routed: float = ROUTED) -> tuple[Router, int]:
    """The router, and to how many parts a query goes: what a held-out part of the sample, unknown to the router, needs."""
    x = _unit(x)
    parts = max(1, min(parts, len(x) // 8))
    router = Router(x.shape[1], parts)
    if parts == 1:
        return router, 1
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    target = np.eye(parts)[part] * 0.5
    for j in range(graph.shape[1]):
        target[np.arange(len(x)), part[graph[:, j]]] += 0.5 / graph.shape[1]
    held = np.random.default_rng(SEED).random(len(x)) < 0.15
    router.fit(x[~held], target[~held])
    logits = router.logits(x)
    home, order = logits.argmax(axis=1), np.argsort(-logits[held], axis=1)
    near = home[neighbour_graph(x, k)[held]]
    place = np.argsort(order, axis=1)  # rank of each part for each held-out query
    ranks = np.take_along_axis(place, near, axis=1)
    return router, next((p for p in range(1, parts) if (ranks < p).mean() >= routed), parts)


def _models(rows: DataFrame, k: int, routed: float) -> DataFrame:
    """(node, salts, probes, shapes, model): a router for each node of ``rows(node, vec, rows, parts)``, from a sample chosen by hash."""

    def run(t: pa.Table) -> pa.Table:
        router, probes = learn(matrix(t), t.column("parts")[0].as_py(), k, routed)
        shapes = [router.w[0].shape[0], router.w[0].shape[1], router.w[2].shape[1]]
        model = b"".join(a.astype("<f4").tobytes() for a in router.w)
        return pa.table({"node": t.column("node")[:1], "probes": pa.array([probes], pa.int32()), "shapes": pa.array([shapes], pa.list_(pa.int32())), "model": pa.array([model], pa.binary())})

    # a sample of about SAMPLE rows of each node, the same on every attempt
    share = F.col("rows") * (F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40))
    return rows.where(share < SAMPLE).select("node", "vec", "parts").groupBy("node").applyInArrow(run, "node long, probes int, shapes array<int>, model binary")


def _router(shapes: list[int], model: bytes) -> Router:
    dim, hidden, parts = shapes
    router, flat = Router(dim, parts, hidden), np.frombuffer(model, dtype="<f4").astype(np.float64)
    cuts = np.cumsum([dim * hidden, hidden, hidden * parts])
    w1, b1, w2, b2 = np.split(flat, cuts)
    router.w = [w1.reshape(dim, hidden), b1, w2.reshape(hidden, parts), b2]
    return router


def _routed(rows: DataFrame, models: DataFrame, many: bool) -> DataFrame:
    """Rows with the node of the next level: the most probable part of their own node, or with ``many`` each part that a query goes to.

    ``models`` has a row for each salt of a node, so that no task holds all rows of a node.
    """

    def run(a: pa.Table, m: pa.Table) -> pa.Table:
        if not a.num_rows or not m.num_rows:
            return a.select(["key", "node"]).slice(0, 0)
        router, probes = _router(m.column("shapes")[0].as_py(), m.column("model")[0].as_py()), m.column("probes")[0].as_py() if many else 1
        logits = router.logits(_unit(matrix(a)))
        parts = np.argsort(-logits, axis=1, kind="stable")[:, :probes]
        node = a.column("node")[0].as_py()
        children = node * (PARTS + 1) + 1 + parts
        return pa.table({"key": a.column("key").take(pa.array(np.repeat(np.arange(a.num_rows), parts.shape[1]))), "node": pa.array(children.ravel(), pa.int64())})

    salted = rows.select("key", "vec", "node", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"))
    keyed = models.select("probes", "shapes", "model", F.col("node").alias("m_node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("m_salt"))
    return salted.groupBy("node", "salt").cogroup(keyed.groupBy("m_node", "m_salt")).applyInArrow(run, "key string, node long")


def index(points: DataFrame, queries: DataFrame, n: int, k: int = K, rows_a_part: int = ROWS_A_PART) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """(key, part) of the distinct vectors ``points(key, vec)``, of one dimension, and of ``queries(key, vec)``; (parts, most probes) of each level.

    A level's nodes with more than ``rows_a_part`` rows are partitioned. There are as many levels as balanced parts of
    that size take, each with about as many parts a node; a part that one vector's copies or likes fill beyond it stays whole and is searched in blocks.
    """
    levels = max(1, math.ceil(math.log(max(n / rows_a_part, 2)) / math.log(PARTS) - 1e-9))
    at, asks, told = points.select("key", F.lit(0).cast("long").alias("node")), queries.select("key", F.lit(0).cast("long").alias("node")), []
    for level in range(levels):
        sizes = at.groupBy("node").agg(F.count("*").alias("rows")).withColumns({"parts": F.least(F.lit(PARTS), F.ceil(F.pow(F.col("rows") / rows_a_part, F.lit(1 / (levels - level))) - 1e-9)).cast("int"), "salts": F.ceil(F.col("rows") / BLOCK).cast("int")})
        sizes = stash(sizes, "nodes")
        large = sizes.where("parts > 1")
        rows = at.join(points, "key").join(large, "node").select("key", "vec", "node", "rows", "parts", "salts")
        models = stash(_models(rows, k, ROUTED ** (1 / levels)).join(sizes.select("node", "salts"), "node"), "models")
        if models.isEmpty():
            break
        told.append(tuple(models.agg(F.sum(F.col("shapes")[2]), F.max("probes")).first()))
        done = sizes.where("parts = 1").select("node")
        at = stash(_routed(rows, models, False).unionByName(at.join(done, "node", "left_semi").select("key", "node")), "placed")
        asking = asks.join(queries.select("key", "vec"), "key").join(large, "node").select("key", "vec", "node", "salts")
        asks = stash(_routed(asking, models, True).unionByName(asks.join(done, "node", "left_semi").select("key", "node")), "routes")
    return at.withColumnRenamed("node", "part"), asks.withColumnRenamed("node", "part"), told


def _block_answers(queries: pa.Table, block: pa.Table, k: int) -> pa.Table:
    none = _FOUND.empty_table()
    if not queries.num_rows or not block.num_rows:
        return none
    c, q = matrix(block), matrix(queries)
    c_id, keys = ids_of(block), queries.column("key")
    cu, qu = _unit(c), _unit(q)
    cn, qn = np.sqrt(np.square(c).sum(axis=1)), np.sqrt(np.square(q).sum(axis=1))
    who, which, what = [], [], []
    for s in range(0, len(q), 64):
        about = qu[s : s + 64] @ cu.T
        for i, row in enumerate(about, s):
            least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2.0
            at = np.flatnonzero(row >= max(least - 1e-9, -2.0))  # then the measure itself, summed alike for each row
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                scores = (c[at] * q[i]).sum(axis=1) / (cn[at] * qn[i])
            odd = ~np.isfinite(scores)
            scores[odd] = (cu[at[odd]] * qu[i]).sum(axis=1)
            top = best(scores, c_id[at], k)
            who.append(np.full(len(top), i))
            which.append(at[top])
            what.append(scores[top])
    at = pa.array(np.concatenate(which))
    return pa.table([keys.take(pa.array(np.concatenate(who))), block.column("uid").take(at), block.column("vec_id").take(at), pa.array(np.concatenate(what))], schema=_FOUND)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """(query_id, rank, vec_id, score) by cosine, for the rows whose id is divisible by ``every``, against all other rows.

    All rows are indexed; about SAMPLE of a part, by hash of the vector, fit its partition. Vectors null, zero or with
    null or non-finite components take no part; rows without an id are candidates, last among ties, but no queries.
    Dimensions other than the commonest are searched without partitions, each within itself. Repeated rows count each; a
    part that alike vectors fill is searched in blocks. No rows give no rows.
    """
    rows = stash(packed(vectors, id_col, vec_col).where((F.col("norm") > 0) | (F.col("norm") != F.col("norm"))), "vectors")
    spark = vectors.sparkSession
    queries = stash(asked(rows, every), "queries")
    found = stash(candidates(rows, k), "candidates")
    dims = {r["dim"]: r["count"] for r in found.groupBy("dim").count().collect()}
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = max(dims, key=lambda d: (dims[d], d))
    points = stash(found.where(F.col("dim") == common).groupBy("key").agg(F.first("vec").alias("vec")), "points")
    placed, routes, _ = index(points, queries.where(F.col("dim") == common), points.count(), k, rows_a_part)
    other = -F.col("dim").cast("long")
    placed = placed.unionByName(found.where(F.col("dim") != common).select("key", other.alias("part")).distinct())
    routes = routes.unionByName(queries.where(F.col("dim") != common).select("key", other.alias("part")))
    indexed = stash(found.join(placed, "key").select("uid", "vec_id", "vec", "part"), "indexed")
    asking = stash(queries.join(routes, "key").select("key", "vec", "part"), "asking")
    sizes = indexed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("subs"))
    asks = asking.groupBy("part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("q_subs"))
    both = stash(sizes.join(asks, "part"), "parts")
    sent = asking.join(both, "part").select("key", "vec", "part", F.pmod(F.xxhash64("key"), F.col("q_subs")).cast("int").alias("qs"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("cs"))
    blocks = indexed.join(both, "part").select("uid", "vec_id", "vec", "part", F.explode(F.sequence(F.lit(0), F.col("q_subs") - 1)).alias("qs"), F.pmod(F.xxhash64("uid"), F.col("subs")).cast("int").alias("cs"))
    hits = cogrouped(sent, blocks, ["part", "qs", "cs"], lambda a, b: _block_answers(a, b, k + 1), "key string, uid long, vec_id long, score double")
    return answers(hits, queries, rows, every, k)


def op5_learned_partitions(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
