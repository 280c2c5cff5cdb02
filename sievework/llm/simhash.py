"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits; each segment is mapped to its count of set bits. The Manhattan
distance of two count vectors never exceeds the Hamming distance of the fingerprints, so a range join within 4 in that
space loses no link. Counts are held in unary (0: 00, 1: 01, 2: 11), which makes the Manhattan distance the popcount of
an exclusive or. The range join runs on a grid: the 32 dimensions are split into 5 subspaces, and as the distance is at
most 4, two linked points share the cell of at least one; the other dimensions are split again in the same way, so
points meet on a cell of two subspaces (25 keys a point). Candidates are verified on whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, id_text, lean, skewed_lookup, stash
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
SEGMENTS = 32
#: A cell with more points than this is split into blocks; each pair of blocks is a task's group of its own.
BLOCK = 8192
_FLUSH = 200_000
_EVEN = 0x5555555555555555


def _fold(hashes: list[np.ndarray], sizes: list[int]) -> list[int]:
    """Majority bits for each run of hashes; fingerprints as unsigned integers."""
    bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    major = (counts * 2 > np.asarray(sizes)[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - SHINGLE + 1].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), dtype=np.uint64, count=len(starts))


def fingerprints_of(texts: list[bytes]) -> list[int]:
    """Unsigned fingerprints of UTF-8 texts. No words: 0. A long text is folded by itself in bounded pieces."""
    out = [0] * len(texts)
    held: list[np.ndarray] = []
    at: list[int] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            for i, fp in zip(at, _fold(held, [len(h) for h in held])):
                out[i] = fp
        held.clear()
        at.clear()
        n = 0

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        h = _shingle_hashes(words)
        if len(h) > _FLUSH:
            counts = sum(np.unpackbits(h[k : k + _FLUSH].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(h), _FLUSH))
            out[i] = int(np.packbits((counts * 2 > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])
            continue
        held.append(h)
        at.append(i)
        n += len(h)
        if n >= _FLUSH:
            flush()
    flush()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in lean(batches):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        fps = np.array(fingerprints_of(texts), dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts count as empty, and empty texts have 0."""
    return id_text(docs, id_col, text_col).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _split(members: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(members, parts) if len(x)]


def grid_masks(levels: int = 2) -> list[int]:
    """The bit masks of the grid's cells, over the unary counts: one for each path of subspaces."""
    paths = [((), list(range(SEGMENTS)))]
    for _ in range(levels):
        paths = [(used + tuple(part), [s for s in rest if s not in part]) for used, rest in paths for part in _split(rest, RADIUS + 1)]
    return [sum(3 << (2 * s) for s in used) for used, _ in paths]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: str = "fp"):
    """The count vector of a fingerprint column, each count in unary, packed in a long."""
    x, y, even = F.col(fp), F.shiftrightunsigned(F.col(fp), 1), F.lit(_EVEN)
    return x.bitwiseOR(y).bitwiseAND(even).bitwiseOR(F.shiftleft(x.bitwiseAND(y).bitwiseAND(even), 1))


def _unary(fp: np.ndarray) -> np.ndarray:
    even, one = np.uint64(_EVEN), np.uint64(1)
    y = fp >> one
    return ((fp | y) & even) | ((fp & y & even) << one)


def _near(a: np.ndarray, b, ua: np.ndarray, ub) -> np.ndarray:
    """Manhattan distance of the counts first; whole fingerprints where that bound holds."""
    ok = np.bitwise_count(ua ^ ub) <= RADIUS
    i = np.flatnonzero(ok)
    other = b if np.ndim(b) == 0 else b[i]
    return i[np.bitwise_count(a[i] ^ other) <= RADIUS]


def _links(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal cells. Runs of up to 32 points give all of theirs, longer ones a spanning forest."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    unary = _unary(fp)
    left, right = [], []
    small = np.repeat(sizes <= 32, sizes)
    for d in range(1, 32):
        i = np.flatnonzero((cell[d:] == cell[:-d]) & small[:-d])
        if not len(i):
            break
        i = i[_near(fp[i], fp[i + d], unary[i], unary[i + d])]
        left.append(fp[i])
        right.append(fp[i + d])
    for k in np.flatnonzero(sizes > 32):
        points, u = fp[starts[k] : starts[k] + sizes[k]], unary[starts[k] : starts[k] + sizes[k]]
        queue: list[tuple[np.uint64, np.uint64]] = []
        while len(points):
            if queue:
                p, pu = queue.pop()
            else:
                p, pu = points[0], u[0]
                points, u = points[1:], u[1:]
            hit = _near(points, p, u, pu) if len(points) else np.empty(0, dtype=np.int64)
            if len(hit):
                left.append(np.full(len(hit), p, dtype=np.uint64))
                right.append(points[hit])
                queue.extend(zip(points[hit], u[hit]))
                keep = np.ones(len(points), dtype=bool)
                keep[hit] = False
                points, u = points[keep], u[keep]
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the last cell of a batch waits for the rest of it."""
    held: list[pa.RecordBatch] = []

    def out(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _links(cell, fp)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def arrays(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        cell = np.concatenate([p.column(0).to_numpy(zero_copy_only=False) for p in parts])
        return cell, np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts]).view(np.uint64)

    for b in batches:
        if not b.num_rows:
            continue
        if held and held[-1].column(0)[0] == b.column(0)[b.num_rows - 1] and held[-1].column(0)[0] == held[-1].column(0)[held[-1].num_rows - 1]:
            held.append(b)
            continue
        cell, fp = arrays([*held, b])
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        yield out(cell[:cut], fp[:cut])
        held = [pa.RecordBatch.from_arrays([pa.array(cell[cut:]), pa.array(fp[cut:].view(np.int64))], names=["cell", "fp"])]
    if held:
        yield out(*arrays(held))


def links(points: DataFrame, levels: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``points(fp)`` that connect all at 4 or fewer differing bits.

    A cell is named by a 64-bit hash of its subspaces and counts; two cells under one name only add candidates. Cells
    of over ``block`` points are counted first; their points get a block each, and meet once for every pair of blocks.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in grid_masks(levels)])
    keyed = points.select("fp", embedding().alias("u")).select(
        "fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("u")))).alias("k", "v")
    ).select("fp", F.xxhash64("k", "v").alias("cell"))
    hot = stash(keyed.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot-cells")
    if hot.isEmpty():
        grouped = keyed.select("cell", "fp")
    else:
        rows = keyed.join(hot, "cell", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.when(F.col("blocks").isNull(), F.array(F.col("cell"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda s: F.xxhash64("cell", F.least(s, own), F.greatest(s, own)))
        )
        grouped = rows.select(F.explode(pairs).alias("cell"), "fp")
    ordered = grouped.repartition("cell").sortWithinPartitions("cell", "fp")
    return ordered.mapInArrow(_link_batches, "a long, b long").distinct()


def _classes(fps: DataFrame, levels: int | None) -> tuple[DataFrame, int]:
    """(fp, n, root, component_id) for each distinct fingerprint of ``fps(doc_id, fp)``, a written table, and its rows."""
    points = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "points")
    total, n = points.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # expected points in a cell of two subspaces stay under 2,000 up to 2^28 points; beyond that a third is used
    roots = components(links(points.select("fp"), levels or (2 if n < 1 << 28 else 3))).select(F.col("node").alias("fp"), "root")
    named = stash(points.join(roots, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "named")
    least = stash(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("points")), "least")
    # a class may hold a third of all points
    return stash(skewed_lookup(named, least, "root", "points", n).select("fp", "n", "root", "component_id"), "labels"), total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links of at most 4 bits, the row's own included. Equal fingerprints
    are one point, so groups of copies cost one row after the first aggregation. Repeated rows stay repeated; a null
    doc_id keeps its row and counts as no id; empty and null texts have fingerprint 0 and are linked like any other.
    """
    fps = stash(fingerprint(docs, id_col, text_col), "fingerprints")
    labels, total = _classes(fps, levels)
    return skewed_lookup(fps, labels.drop("root"), "fp", "n", total).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int | None = None) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that with the least id (rows without an id last), all its columns kept.

    Rows with one id and different texts are told apart by a hash of the text; of rows alike in both, one stays.
    """
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), key.alias("key"))
    fps = stash(texts.mapInArrow(_fingerprint_batches, "doc_id long, fp long, key long"), "fingerprints")
    labels, total = _classes(fps, levels)
    rows = fps.groupBy("doc_id", "key", "fp").agg(F.count("*").alias("copies"))
    placed = skewed_lookup(rows, labels.drop("component_id"), "fp", "n", total)
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "copies")).alias("m"))
    kept = stash(first.select(F.col("m.doc_id").alias("_kept_id"), F.col("m.key").alias("_kept_key"), F.col("m.copies").alias("_copies")), "kept")
    chosen = docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col("_kept_id")) & (key == F.col("_kept_key")))
    once = chosen.where("_copies = 1")
    repeated = chosen.where("_copies > 1").dropDuplicates(["_kept_id", "_kept_key"])
    return once.unionByName(repeated).select(*[f"`{c}`" for c in docs.columns])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
