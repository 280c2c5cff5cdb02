"""Byte-level BPE by recursive queries.

Each partition's texts are split by the pattern, and the words not met before go to an embedded DuckDB as one row per
(word, position, token). A recursive query joins neighbouring tokens with the merge table and contracts each word's
leftmost pair of least rank, until no pair of any word merges. Decoding joins the ids with the vocabulary and
aggregates the bytes in the order of the positions.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import id_text

#: Words of one recursive query and bytes that its steps take (a word of n bytes leaves n lists of up to n ids), bytes of words and ids remembered within a process, and text and tokens handled at once.
WORDS_AT_ONCE = 60_000
BYTES_AT_ONCE = 64 << 20
REMEMBERED = 150 << 20
TEXT_AT_ONCE = 8_000_000
TOKENS_AT_ONCE = 300_000
#: Words of more bytes are contracted over a heap of pairs instead: the query needs a round for each of their merges and
#: keeps every round's ids, so that one word of 1,600 bytes is too much for its memory.
LONG_WORD = 400

_ENCODE = """
WITH RECURSIVE step(w, toks, live) AS (
  SELECT w, toks, true FROM start
  UNION ALL
  SELECT s.w, CASE WHEN best IS NULL THEN toks ELSE list_concat(list_append(toks[:best % 1024 - 1], best // 1024), toks[best % 1024 + 2:]) END, best IS NOT NULL
  FROM (SELECT w, toks FROM step WHERE live) s LEFT JOIN (
    SELECT w, min(m.c * 1024 + pos)::INTEGER AS best
    FROM (SELECT w, generate_subscripts(toks, 1) AS pos, unnest(toks) AS a, unnest(toks[2:]) AS b FROM step WHERE live) p
    JOIN merges m ON m.pair = p.a * 65536::BIGINT + p.b
    GROUP BY w
  ) USING (w)
)
SELECT w, toks FROM step WHERE NOT live
"""

_DECODE = """
SELECT doc, string_agg(v.bytes, '' ORDER BY pos) AS bytes FROM ids JOIN vocabulary v USING (tok) GROUP BY doc ORDER BY doc
"""


class Codec:
    """One process's vocabulary, merge table and connection."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.forget()
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        find = self.ranks.get
        pairs = [(a * 65536 + b, c) for t, c in self.ranks.items() for k in range(1, len(t)) if (a := find(t[:k])) is not None and (b := find(t[k:])) is not None]
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "c": pa.array([c for _, c in pairs], pa.int64())})
        vocabulary = pa.table({"tok": pa.array(list(self.bytes), pa.int64()), "bytes": [t.decode("latin-1") for t in self.bytes.values()]})
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "preserve_insertion_order": False, "temp_directory": ""})  # what a query holds is bounded, so nothing is spilled
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            with self.con.cursor() as cur:
                cur.register("given", table)
                cur.execute(f"CREATE TABLE {name} AS SELECT * FROM given").fetchall()

    def forget(self) -> None:
        """A word's number leads to its ids: lens[n] of them from starts[n] on in flat."""
        self.words: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.held = 0

    def _by_query(self, words: list[bytes]) -> list[np.ndarray]:
        """Of all words: their numbers in ``words``, in the order of the result, how many ids each has, and the ids."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        toks = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int32)
        start = pa.table({"w": np.arange(len(words), dtype=np.int32), "toks": pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lens))).astype(np.int32), toks)})
        with self.con.cursor() as cur:
            cur.register("start", start)
            found = cur.sql(_ENCODE).to_arrow_table().combine_chunks()
        lists = found.column("toks").combine_chunks()
        return [found.column("w").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()]

    def _by_heap(self, word: bytes) -> tuple[int, ...]:
        """The same contraction in n log n: least rank first, leftmost first among equals."""
        import heapq

        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        find = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := find(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not a or j < 0 or parts[j] is not b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := find(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(self.ranks[p] for p in parts if p is not None)

    def learn(self, words: set[str]) -> None:
        """Ids of words not known yet. Words that are tokens need no merging."""
        if self.held > REMEMBERED:
            self.forget()
        new = list(words.difference(self.words))
        raw = [w.encode() for w in new]
        numbers, lens, ids = [], [], []  # in the order in which ids come
        single = [(i, t) for i, b in enumerate(raw) if (t := self.ranks.get(b)) is not None]
        if single:
            numbers, lens, ids = [np.array([i for i, _ in single])], [np.ones(len(single), dtype=np.int64)], [np.array([t for _, t in single])]
        known = {i for i, _ in single}
        todo: list[int] = []
        size = 0

        def ask() -> None:
            w, n, toks = self._by_query([raw[i] for i in todo])
            numbers.append(np.array(todo)[w])
            lens.append(n)
            ids.append(toks)
            todo.clear()

        for i, b in enumerate(raw):
            if i in known:
                continue
            if len(b) > LONG_WORD:
                found = np.array(self._by_heap(b))
                numbers.append(np.array([i]))
                lens.append(np.array([len(found)]))
                ids.append(found)
                continue
            todo.append(i)
            size += len(b) * (2 * len(b) + 100)
            if size > BYTES_AT_ONCE or len(todo) >= WORDS_AT_ONCE:
                ask()
                size = 0
        if todo:
            ask()
        if not numbers:
            return
        base, at = len(self.lens), len(self.flat)
        n = np.concatenate(lens).astype(np.int64)
        self.flat = np.concatenate((self.flat, *ids)).astype(np.int32)
        self.lens = np.concatenate((self.lens, n))
        self.starts = np.concatenate((self.starts, at + np.cumsum(n) - n))
        self.words.update(zip((new[i] for i in np.concatenate(numbers).tolist()), range(base, base + len(n))))
        self.held += 200 * len(new) + 2 * sum(map(len, new)) + 4 * len(self.flat) - 4 * at

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and end."""
        split = [self.pattern.findall(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(n_words.sum()))
        lens = self.lens[at]
        ends = np.concatenate(([0], np.cumsum(lens)))
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], lens)]
        return ids, ends[np.concatenate(([0], np.cumsum(n_words)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, ends[1:-1])] if texts else []

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text, by ordered aggregation over some texts' ids at once."""
        out = [b""] * (len(ends) - 1)
        k = 0
        while k < len(out):
            z = max(k + 1, int(np.searchsorted(ends, ends[k] + TOKENS_AT_ONCE, "right")) - 1)
            own = ids[ends[k] : ends[z]]
            with self.con.cursor() as cur:
                cur.register("ids", pa.table({"doc": np.repeat(np.arange(k, z), np.diff(ends[k : z + 1])), "pos": np.arange(len(own)), "tok": own.astype(np.int64)}))
                for doc, text in cur.execute(_DECODE).fetchall():
                    out[doc] = text.encode("latin-1")
            k = z
        return out

    def decode(self, docs: list[list[int]]) -> list[bytes]:
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, docs), dtype=np.int64, count=len(docs)))))
        return self.decode_flat(np.fromiter(chain.from_iterable(docs), dtype=np.int64, count=int(ends[-1])), ends)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _portions(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch, some megabytes of text at a time."""
    ids, texts, size = [], [], 0
    for i, t in zip(b.column(0).to_pylist(), b.column(1)):
        t = t.as_py()
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size > TEXT_AT_ONCE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row; a null text counts as empty and has no ids. Special tokens are ordinary text."""
    path, pattern = _vocabulary(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for ids, texts in _portions(b):
                found, ends = c.encode_flat(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids); null ids count as none. Ids that aren't in the vocabulary raise."""
    path, pattern = _vocabulary(path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            if unknown := {i for x in ids for i in x if i not in c.bytes}:
                raise ValueError(f"ids not in the vocabulary: {sorted(unknown)[:5]}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.decode(ids), pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts are encoded, then decoded from the ids alone.

    One row for each row, repeated rows included; texts of any length are taken whole; other columns are ignored.
    """
    path, pattern = _vocabulary(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for docs_, texts in _portions(b):
                ids, ends = c.encode_flat(texts)
                listed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids).cast(pa.string())), ",")
                sent = [hashlib.sha256(x.as_buffer()).hexdigest() for x in listed]
                back = [hashlib.sha256(x).hexdigest() for x in c.decode_flat(ids, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(sent, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
