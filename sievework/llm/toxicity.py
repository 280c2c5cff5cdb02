"""Toxicity scores after noisy-channel deobfuscation.

Words written in leetspeak, with spaces or signs between their letters, or with repeated letters are lattices of what
each character may stand for. A Viterbi decoder under a character trigram model of the whole corpus restores the likeliest
word. Words and their restored forms, whole and by their first letters, are looked up in a lexicon learnt from labelled
documents, and a logistic model turns what a text holds into a score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, id_text, lean, plain, remembered, stash

#: Labelled documents that the lexicon and the logistic model are fitted on, at most, chosen by a hash of their id.
SAMPLE = 20_000
THRESHOLD = 0.7
#: Log-likelihood ratio (G squared) from which a word or beginning counts as a sign of toxicity.
SIGNIFICANT = 28.0
PREFIXES = (4, 5)
LETTERS = 27  # a to z, and 0 for all else

_WORD = re.compile(r"[^\W\d_]+")
_LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
_SIGNS = frozenset("._-*~'`^/\\,:;#=%&\"<>{}[]()!+|$@")
_DOUBLED = re.compile(r"(.)\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
_SUBSTITUTED, _DROPPED = -1.0, -2.5


def _letter_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz", 1):
        table[c] = table[c - 32] = i
    return table


def trigram_counts(texts: Iterator[bytes]) -> np.ndarray:
    table, counts = _letter_table(), np.zeros(LETTERS**3, dtype=np.int64)
    for t in texts:
        x = table[np.frombuffer(b"  " + t + b"  ", dtype=np.uint8)]
        counts += np.bincount(x[:-2] * LETTERS**2 + x[1:-1] * LETTERS + x[2:], minlength=LETTERS**3)
    return counts


def _joined(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[bytes]:
    """A batch's texts by the megabyte: counting has a fixed cost."""
    held: list[bytes] = []
    size = 0
    for t in batch.column(1):
        b = t.as_py().encode()
        held.append(b)
        size += len(b)
        if size > limit:
            yield b"  ".join(held)
            held, size = [], 0
    if held:
        yield b"  ".join(held)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two others, from the trigrams of all texts (at most 27^3 rows reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LETTERS**3, dtype=np.int64)
        for b in batches:
            counts += trigram_counts(_joined(b))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["gram", "n"])

    counts = np.full(LETTERS**3, 0.1)
    for gram, n in docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] += n
    cube = counts.reshape(LETTERS, LETTERS, LETTERS)
    return np.log(cube / cube.sum(axis=2, keepdims=True))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each character of a token may stand for, with costs; '' drops it."""
    out: list[list[tuple[str, float]]] = []
    last = ""
    for c in token:
        if c.isalpha():
            out.append([(c, 0.0), ("", _DROPPED)] if c == last else [(c, 0.0)])
            last = c
            continue
        options = [(x, _SUBSTITUTED) for x in _LEET.get(c, "")]
        if c in _SIGNS or c.isspace() or not options:
            options.append(("", 0.0 if not options else _DROPPED))
        out.append(options)
        last = ""
    return out


def decoded(token: str, model: np.ndarray) -> str | None:
    """The likeliest reading of a token, if it has several or its only one is another than itself."""
    if token.isalpha() and not _DOUBLED.search(token):
        return None
    columns = lattice(token)
    if any(len(options) > 1 for options in columns):
        return viterbi(columns, model)
    reading = "".join(c for ((c, _),) in columns)
    return None if reading == token else reading


def viterbi(columns: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest reading. States are the last two letters read; the word ends at a boundary."""

    def code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 0

    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in columns:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for c, cost in options:
                key, s, p = (a, b), score + cost, path
                if c:
                    key, s, p = (b, code(c)), s + model[a, b, code(c)], (path, c)
                if key not in new or s > new[key][0]:
                    new[key] = (s, p)
        states = new
    _, path = max(((s + model[a, b, 0], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, c = path
        letters.append(c)
    return "".join(reversed(letters))


def _named(word: str) -> Iterator[str]:
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "-"


class Reader:
    """Turns tokens into features, each token once as long as it is remembered, in a bounded number of bytes."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float] | None = None, remembered: int = 80 << 20) -> None:
        self.model, self.lexicon, self.remembered = model, lexicon, remembered
        self.known: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def _token(self, token: str) -> tuple[str, ...]:
        bare = token[:-1] if token[-1] in ".,;:?" else token
        if bare.isalpha() and not _DOUBLED.search(bare):  # one reading, as most words have
            return tuple(f for f in _named(bare) if self.lexicon is None or f in self.lexicon)
        words = _WORD.findall(token)
        core = token.lstrip("\"'([{<").rstrip("\"')]}>.,;:!?%&*#$-_~")
        for t in {token, core}:  # signs at the ends may stand for letters or be punctuation
            words += _WORD.findall(decoded(t, self.model) or "")
        found = {f for w in words for f in _named(w)}
        if self.lexicon is not None:
            found &= self.lexicon.keys()
        return tuple(found)

    def _spaced(self, run: str) -> set[str]:
        """Features of letters set apart: they may join several words, so a beginning may be anywhere."""
        word = viterbi(lattice("".join(run.split())), self.model)
        if self.lexicon is None:
            return set(_named(word))
        return {f for i in range(len(word)) for n in PREFIXES if (f := word[i : i + n] + "-") in self.lexicon or (f := word[i : i + n]) in self.lexicon}

    def features(self, text: str) -> set[str]:
        text = text.lower()
        tokens = set(text.split())
        known = self.known
        if self.held > self.remembered:
            known.clear()
            self.held = 0
        found: set[str] = set()
        for t in tokens:
            f = known.get(t)
            if f is None:
                f = self._token(t)
                known[t] = f
                self.held += 200 + len(t) + sum(60 + len(x) for x in f)
            if f:
                found.update(f)
        for m in _SPACED.finditer(text):
            found |= self._spaced(m.group())
        return found


def _reader(key: str, model: np.ndarray, lexicon: dict[str, float]) -> Reader:
    """This process's reader: tasks that follow one another in a worker go on with what it remembers."""
    return remembered(("toxicity", key), lambda: Reader(model, lexicon))


@dataclass
class Classifier:
    model: np.ndarray
    lexicon: dict[str, float]
    weights: tuple[float, ...]

    def measures(self, found: set[str]) -> tuple[float, float]:
        """The strongest sign, and how many words or beginnings there are, on a log scale."""
        w = [self.lexicon[f] for f in found if f in self.lexicon]
        return (max(w), math.log1p(len(w))) if w else (0.0, 0.0)

    def score(self, found: set[str]) -> float:
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], self.measures(found)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sketch(text: str) -> int:
    """Least hash over five-word shingles: near copies mostly share it, so that a group of copies counts as one witness."""
    words = text.split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def _g2(a: int, b: int, na: int, nb: int) -> float:
    n, t = na + nb, a + b
    total = 0.0
    for seen, rows, cols in ((a, na, t), (b, nb, t), (na - a, na, n - t), (nb - b, nb, n - t)):
        if seen > 0:
            total += seen * math.log(seen * n / (rows * cols))
    return 2 * total


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Learn from labelled rows outside the held-out third; the character model is of all texts.

    Rows of ``labels`` with no id or a label other than 0 and 1 are passed over; several labels of one id count as their
    greatest. Without labels of both kinds every score is the share of toxic labels, or a half.
    """
    texts = id_text(docs, id_col, text_col)
    model = character_model(texts)
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        reader = Reader(model)
        for b in lean(batches):
            texts_ = b.column(1).to_pylist()
            for s in range(0, len(texts_), 500):
                some = texts_[s : s + 500]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, len(some)), b.column(2).slice(s, len(some)), pa.array(map(_sketch, some), pa.int64()), pa.array([list(reader.features(t)) for t in some], pa.list_(pa.string()))], names=["doc_id", "label", "sketch", "features"])

    read = stash(texts.join(F.broadcast(known), "doc_id").mapInArrow(run, "doc_id long, label int, sketch long, features array<string>"), "labelled")
    toxic, clean = (read.where(F.col("label") == k).select("sketch").distinct().count() for k in (1, 0))
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Classifier(model, {}, (math.log(share / (1 - share)), 0.0, 0.0))
    seen = read.select("label", "sketch", F.explode("features").alias("feature")).groupBy("feature")
    counts = seen.agg(F.countDistinct(F.when(F.col("label") == 1, F.col("sketch"))).alias("t"), F.countDistinct(F.when(F.col("label") == 0, F.col("sketch"))).alias("c")).where(F.col("t") >= 3).where(F.col("t") * clean > F.col("c") * toxic * 3).collect()
    lexicon = {f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for f, t, c in counts if _g2(t, c, toxic, clean) >= SIGNIFICANT}
    judge = Classifier(model, lexicon, (0.0, 0.0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [judge.measures(set(f)) for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in m], pa.float64()), pa.array([y for _, y in m], pa.float64())], names=["doc_id", "label", "a", "b"])

    # one row for each labelled id, of which there are at most ``sample``, however often documents repeat it
    measured = read.select("doc_id", "label", "features").mapInArrow(measure, "doc_id long, label int, a double, b double")
    rows = measured.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("a").alias("a"), F.max("b").alias("b")).orderBy("label", "a", "b").toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in ("a", "b")], axis=1)
    return Classifier(model, lexicon, tuple(_logistic(x, rows.column("label").to_numpy()).tolist()))


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and toxicity, from the text alone; null and empty texts get the score of no signs."""
    columns = docs.columns
    at, name = columns.index(text_col), "toxicity"
    while name in columns:
        name += "_"

    key = hashlib.sha256(classifier.model.tobytes() + repr(sorted(classifier.lexicon.items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(key, classifier.model, classifier.lexicon)
        for b in lean(batches):
            scores = [classifier.score(reader.features(t)) if (t := x.as_py()) else classifier.score(set()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    given = plain(docs)
    return given.mapInArrow(run, StructType([*given.schema.fields]).add(name, DoubleType())).toDF(*columns, name)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, repeated rows and rows without an id included."""
    classifier = fit(docs, labels, sample, id_col, text_col)
    texts = id_text(docs, id_col, text_col)
    scored = score(texts, classifier)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
