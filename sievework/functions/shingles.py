"""Character shingles, their Jaccard similarity, and MinHash parameters."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILY = "sievework-minhash"


def shingle_array(near: Column, size: int) -> Column:
    """Distinct code-point n-grams of a near text: none of an empty one, the whole of a shorter one."""
    if size < 1:
        raise ValueError("shingle size must be at least 1")
    # one code point is consumed a match, so none starts inside of a surrogate pair
    grams = F.regexp_extract_all(near, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))
    return F.when(near == "", F.array().cast("array<string>")).when(F.char_length(near) < size, F.array(near)).otherwise(F.array_distinct(grams))


def jaccard_of(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def shingles(near: str, size: int) -> set[str]:
    """The same in Python."""
    if size <= 0:
        raise ValueError("shingle size must be at least 1")
    if len(near) < size:
        return {near} if near else set()
    return {near[i : i + size] for i in range(len(near) - size + 1)}


def u32(data: bytes) -> int:
    """The first four bytes of the SHA-256, big-endian."""
    return int.from_bytes(hashlib.sha256(data).digest()[:4], "big")


def permutations(count: int, seed: int, family: str = FAMILY) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and addends of ``count`` permutations of 32-bit numbers."""
    a = np.array([u32(f"{family}-a:{seed}:{i}".encode()) | 1 for i in range(count)], dtype=np.uint32)
    b = np.array([u32(f"{family}-b:{seed}:{i}".encode()) for i in range(count)], dtype=np.uint32)
    return a, b


def signature(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least permuted id for each permutation; zeros without ids. Bounded memory for any number of ids."""
    if not len(ids):
        return np.zeros(len(a), dtype=np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(ids), 512):
        permuted = ids[s : s + 512, None] * a
        permuted += b
        np.minimum(least, permuted.min(axis=0), out=least)
    return least


class Grams:
    """Shingles of texts as numbers, exactly: each code point has a number of its own, and a shingle packs its numbers into 64 bits.

    Shingles of over 8 code points, and texts once more code points are met than fit, have no such numbers.
    """

    def __init__(self, size: int) -> None:
        if size < 1:
            raise ValueError("shingle size must be at least 1")
        self.size, self.bits, self.known = size, min(64 // size, 16), 0
        self.numbers = np.zeros(0x110000 if size <= 8 else 0, dtype=np.uint16)

    def places(self, near: str) -> np.ndarray | None:
        """The number of the shingle at each place of a text, repeats included."""
        if self.size > 8:
            return None
        points = np.frombuffer(near.encode("utf-32-le"), dtype=np.uint32)
        numbers = self.numbers[points]
        if not numbers.all():
            new = np.unique(points[numbers == 0])
            if self.known + len(new) >= 1 << self.bits:
                return None
            self.numbers[new] = np.arange(self.known + 1, self.known + 1 + len(new))
            self.known += len(new)
            numbers = self.numbers[points]
        numbers = numbers.astype(np.uint64)
        last = max(len(numbers) - self.size + 1, min(len(numbers), 1))
        packed = numbers[:last].copy()
        for i in range(1, min(self.size, len(numbers))):
            packed |= numbers[i : i + last] << np.uint64(self.bits * i)
        return packed


class Ids:
    """``u32`` of a text's distinct shingles. Those met of late are remembered, in a table of a fixed size."""

    SLOTS = 21

    def __init__(self, size: int) -> None:
        self.grams = Grams(size)
        self.codes, self.values = np.zeros(1 << self.SLOTS, dtype=np.uint64), np.zeros(1 << self.SLOTS, dtype=np.uint32)

    def of(self, near: str) -> np.ndarray:
        """An id for each distinct shingle, in no order."""
        places = self.grams.places(near)
        if places is None:
            found = shingles(near, self.grams.size)
            return np.fromiter((u32(g.encode()) for g in found), dtype=np.uint32, count=len(found))
        codes = np.sort(places)
        codes = codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes
        slots = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)
        ids, missed = self.values[slots], self.codes[slots] != codes
        if missed.any():
            new = codes[missed]
            # the last place of each is as good as any
            at = np.zeros(len(new), dtype=np.int64)
            where = np.searchsorted(new, places)
            where[where == len(new)] = 0
            held = new[where] == places
            at[where[held]] = np.flatnonzero(held)
            size = self.grams.size
            hashed = np.fromiter((u32(near[i : i + size].encode()) for i in at.tolist()), dtype=np.uint32, count=len(at))
            ids[missed] = hashed
            # of two that share a slot, one is remembered with its own id
            kept, first = np.unique(slots[missed], return_index=True)
            self.codes[kept], self.values[kept] = new[first], hashed[first]
        return ids


def rows_per_band(count: int) -> int:
    rows = 4 if count >= 4 else 1
    while count % rows:
        rows -= 1
    return rows
