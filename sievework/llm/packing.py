"""Packing token sequences by minimum bin slack.

Only lengths matter to the packing, and there are at most ``size`` of them, so the driver works on their histogram, of
the same size whatever the corpus: for each bin, the longest length left is taken, and subset-sum dynamic programming on
a bitset over the other lengths left finds the fullest feasible combination, which is removed, as many times as the
histogram allows. The resulting patterns (fewer than a few thousand) are then filled from the pieces by their rank
among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rank, buckets_for, id_text, lean, remembered, stash

SIZE = 1024
END = 2
Place = tuple[int, int]
#: Slack with which a bin may be taken as full; the best of these allowances is used.
SLACKS = (0, 2, 5, 8, 12, 16, 24, 32, 48, 64)


def _tokenizers(json_path: str, ranks_path: str):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, [t.content for t in slow.get_added_tokens_decoder().values()]


def token_ids(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """Ids as ``tokenizers`` gives them, from the faster reader of the same vocabulary unless an added token occurs."""
    slow, fast, added = remembered(("packing", json_path, ranks_path), lambda: _tokenizers(json_path, ranks_path))
    if not any(a in text for a in added):
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # beyond the limits of its pattern engine
            pass
    return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(n: int, size: int) -> list[Place]:
    """(start, length) of the pieces of ``n`` tokens: whole, or in pieces of ``size`` of which the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def compact(ids: np.ndarray) -> bytes:
    """A piece's ids (at least one) in two bytes each, or in four if one of them is greater."""
    return (ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")).tobytes()


def unfolded(column: pa.Array, length: np.ndarray) -> pa.Array:
    """Lists of ids from a column of ``compact`` ones, of which ``length`` has the numbers."""
    column = column.cast(pa.binary())
    ends = np.concatenate(([0], np.cumsum(length)))
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
    if at[-1] - at[0] == 2 * ends[-1]:
        ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view("<u2")
    else:
        ids = np.concatenate([np.frombuffer(x.as_buffer(), f"<u{x.as_buffer().size // n}") for x, n in zip(column, length.tolist())])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, keep_ids: bool = True, json_path: str | None = None, ranks_path: str | None = None, folded: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for the pieces of all texts; a null text counts as empty.

    ``folded`` ids are a binary column, see ``compact``.
    """
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary() if folded else pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            out: list[tuple] = []
            weight = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(token_ids(text.as_py(), json_path, ranks_path), np.uint32(end)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    part = ids[s : s + n]
                    row = (doc, k, s, n, zlib.crc32(part.tobytes()))
                    out.append((*row, compact(part) if folded else part.astype(np.int32)) if keep_ids else row)
                    weight += n if keep_ids else 1
                if weight > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, weight = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if folded else ", ids array<int>") * keep_ids
    return id_text(docs, id_col, text_col).mapInArrow(run, kinds)


def fullest(left: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """The multiset of lengths (at most ``left`` of each) with the greatest sum within ``room``.

    Longer lengths enter the sums first, and the search ends with the first sum that leaves ``slack`` at most.
    """
    reach, mask, steps, enough = 1, (1 << (room + 1)) - 1, [], max(0, room - slack)
    for length in sorted((x for x in left if x <= room), reverse=True):
        n, k = min(left[length], room // length), 1
        while n > 0 and not reach >> enough:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & mask
            n, k = n - k, k * 2
        if reach >> enough:
            break
    total, use = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            use[length] = use.get(length, 0) + k
    return use


def _patterns(histogram: dict[int, int], size: int, slack: int) -> list[tuple[int, list[tuple[int, int]]]]:
    left = {x: n for x, n in histogram.items() if n > 0}
    found = []
    while left:
        longest = max(left)
        rest = {x: n - (x == longest) for x, n in left.items() if n > (x == longest)}
        use = fullest(rest, size - longest, slack)
        use[longest] = use.get(longest, 0) + 1
        times = min(left[x] // k for x, k in use.items())
        for x, k in use.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
        found.append((times, sorted(use.items(), reverse=True)))
    return found


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, copies in each bin), ...]), longest lengths first.

    The programme runs strict and with each allowance in SLACKS: a bin that is full but for the allowance is taken at once,
    of longer lengths, which saves short ones for bins that need them. The run with the fewest bins counts.
    """
    least = -(-sum(x * n for x, n in histogram.items()) // size)
    best: list[tuple[int, list[tuple[int, int]]]] | None = None
    for slack in SLACKS:
        found = _patterns(histogram, size, slack)
        if best is None or sum(t for t, _ in found) < sum(t for t, _ in best):
            best = found
        if sum(t for t, _ in best) <= least:
            break
    return best or []


def pack(parts: DataFrame, size: int = SIZE, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32"), folded: str | None = None) -> DataFrame:
    """Add sequence_id (from 0, gapless) and offset to ``parts``, which has a column length of 1 to ``size``.

    ``parts`` is read three times, so it should be a written table. Ranks among pieces of one length are made in
    buckets, so a length that a third of all pieces have is no single task's work. A column of ``folded`` ids goes
    through the exchange as it is, and lists are made of it where pieces are placed; buckets of such wide rows are
    smaller, as several may fall to one task.
    """
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    table, base, used = [], 0, dict.fromkeys(histogram, 0)
    for times, items in patterns(histogram, size):
        offset = 0
        for length, k in items:
            table.append((length, used[length], base, k, offset))
            used[length] += times * k
            offset += length * k
        base += times
    table.sort()
    cols = np.array(table, dtype=np.int64).reshape(-1, 5)
    starts = (cols[:, 0] << 44) + cols[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = cols[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            nth = rank - at[:, 1]
            sequence, offset = at[:, 2] + nth // at[:, 3], at[:, 4] + nth % at[:, 3] * length
            names = [x for x in b.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(unfolded(b.column(x), length) if x == folded else b.column(x) for x in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    n = sum(histogram.values())
    ranked = bounded_rank(parts, ["length"], [F.col(c) for c in order], F.xxhash64("doc_id", "piece"), buckets_for(n, 1_000 if folded else 20_000), "rank").select(*parts.columns, "rank")
    kinds = ", ".join(f"`{f.name}` {'array<int>' if f.name == folded else f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, kinds)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """One row per piece of each document: where it is cut, its ids, and its place among the sequences.

    Null and empty texts are the one end token. Texts of over ``size`` tokens are cut. Repeated rows are packed as often
    as they occur; rows without an id too. No rows give no rows. Other columns are ignored.
    """
    return pack(stash(pieces(docs, id_col, text_col, size, keep_ids=keep_ids, folded=keep_ids), "pieces"), size, folded="ids" if keep_ids else None)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
