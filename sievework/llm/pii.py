"""Personal data by bootstrapped contextual extraction.

Seed entities are the identifiers of four kinds with expressions of their own (the base) and values assigned to names that
say what they hold (``token = "..."``). What they stand in induces lexical patterns of three forms: the two words before
("L"), the name that a value is assigned to ("K"), and the shape of a value that mixes letters and digits ("S"). In the
bipartite graph of patterns and instances, a pattern's confidence is the share of all its occurrences that sure instances
fill. A pattern is trusted from CONFIDENT on with SUPPORT different sure instances, its confidence is settled then, and its
instances are as sure as the best of their trusted patterns. Rounds go on until none is added, which is a fixpoint: the
set of trusted patterns only grows. Trusted patterns mark identifiers that the seeds do not know.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import forget, lean, plain, skewed_lookup, stash

KINDS = ("email", "ip", "card", "phone", "id")
ID = KINDS.index("id")
#: A pattern is trusted from this confidence on, with so many different sure instances, however large the input.
CONFIDENT = 0.6
SUPPORT = 5
#: A value assigned to a name that ends so is a seed if it mixes letters and digits over SECRET characters or more.
SEED_NAMES = ("token", "secret", "password", "passwd", "apikey", "api_key", "access_key", "private_key")
SECRET = 16
#: Characters from which on the shape of a value is a pattern.
SHAPED = 12
#: Up to so many trusted patterns go along with the function that reads texts; more are joined, with the same result.
FEW = 200_000
#: Bits of the filter (1 MB) that tells most of the words and patterns that are not looked for; a join tells the rest.
BITS = 1 << 23

Range = tuple[int, int]

_SPANS = ArrayType(StructType().add("start", LongType()).add("kind", IntegerType()).add("end", LongType()))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# a run of digits is entered at its start only: entered later, it would fail or succeed in the same way
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"(?<![A-Za-z0-9_./:#-])[A-Za-z_./:#-]*+[0-9][A-Za-z0-9_./:#-]*+")
_JOINERS = "_./:#-"
_OPERATOR = re.compile(r"[=:]+>?")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_LETTER = re.compile(r"[A-Za-z]")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")
_HEX = re.compile(r"[0-9A-Fa-f]+\Z")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each starts as far left of its @ as the local part's characters and the last match allow."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in order; code points, end exclusive."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0") or "0") < 4 and int(p) <= 255 for x in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def context(text: str, start: int) -> str:
    """The two whole words before the token that ``start`` is in, in lower case; '^' where the text starts.

    What the token has before the identifier (brackets, quotes, 'mailto:', 'key=') is no word of its own, so each context
    is a pair of words as ``str.split`` gives them, which is how occurrences are counted.
    """
    width = 120
    while True:
        a = max(0, start - width)
        words = text[a:start].rsplit(None, 4)
        if start and words and not text[start - 1].isspace():
            words.pop()
        if not a or len(words) > 2:  # the first of them may be cut
            return " ".join((["^"] * 2 + words)[-2:]).lower()
        width *= 4


def contexts(text: str, starts: list[int]) -> list[str]:
    """The context of each start, in order; those within one token share it, so that long tokens are read once."""
    out: list[str] = []
    for i, start in enumerate(starts):
        same = i and not _SPACE.search(text, starts[i - 1], start)
        out.append(out[-1] if same else context(text, start))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[Range]:
    """Runs of letters, digits and joining signs, with a digit, of four characters or more, that look like identifiers.

    They are never part of a word of other letters, nor of a base span; one may hold a base span whole.
    """
    out: list[Range] = []
    if not _DIGIT.search(text):
        return out
    k = 0
    for m in _RUN.finditer(text):
        run = m.group()
        a, z = m.start() + len(run) - len(run.lstrip(_JOINERS)), m.end() - (len(run) - len(run.rstrip(_JOINERS)))
        if z - a < 4 or (a and (text[a - 1].isalnum() or text[a - 1] == "@")) or (z < len(text) and (text[z].isalnum() or text[z] == "@")):
            continue
        while k < len(base) and base[k][2] <= a:
            k += 1
        touched = takewhile(lambda s: s[0] < z, islice(base, k, None))
        if all(y <= a or (a <= x and y <= z and (x, y) != (a, z)) for x, _, y in touched):
            out.append((a, z))
    return out


def assignments(text: str) -> dict[int, str]:
    """Where a value starts, and the name, in lower case, that it is assigned to by =, :, := or =>; quotes and brackets are passed over."""
    out: dict[int, str] = {}
    n = len(text)
    for m in _OPERATOR.finditer(text):
        a, z = m.start(), m.end()
        while a and text[a - 1] in " \t":
            a -= 1
        if a and text[a - 1] in "\"'":
            a -= 1
        b = a
        while b and text[b - 1] in _NAME:
            b -= 1
        name = text[b:a].strip("_.-").lower()
        if not name or not _LETTER.match(name) or (b and text[b - 1].isalnum()):
            continue
        while z < n and text[z] in " \t":
            z += 1
        for _ in range(2):
            if z < n and text[z] in "\"'([":
                z += 1
        if z < n and not text[z].isspace():
            out[z] = name
    return out


def shape(value: str) -> str | None:
    """Classes and lengths of a value's segments: d digits, h hexadecimal, a letters, x both. None for short values and those without letters or digits."""
    if len(value) < SHAPED or not _DIGIT.search(value) or not _LETTER.search(value):
        return None

    def named(m: re.Match) -> str:
        part = m.group()
        kind = "d" if part.isdigit() else "h" if _HEX.match(part) and _DIGIT.search(part) else "a" if part.isalpha() else "x"
        return f"{kind}{len(part)}"

    return _SEGMENT.sub(named, value)


def is_seed(name: str | None, value: str) -> bool:
    """Whether the name that the value is assigned to says that it is one to hide."""
    return bool(name) and len(value) >= SECRET and name.replace("-", "_").endswith(SEED_NAMES) and bool(_DIGIT.search(value)) and bool(_LETTER.search(value))


class Instance(NamedTuple):
    """A span; kind is its place in KINDS, and seed whether it is sure from the start."""

    start: int
    end: int
    kind: int
    seed: bool
    patterns: list[str]


def instances(text: str) -> list[Instance]:
    """Base spans and candidates of a text with the patterns that they fill."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    base = base_spans(text)
    names = assignments(text)
    found = sorted(base + [(a, ID, z) for a, z in candidates(text, base)])
    out = []
    for (a, kind, z), words in zip(found, contexts(text, [a for a, _, _ in found])):
        name, value = names.get(a), text[a:z]
        patterns = [f"L{words}"]
        if name:
            patterns.append(f"K{name}")
        if kind == ID and (s := shape(value)):
            patterns.append(f"S{s}")
        out.append(Instance(a, z, kind, kind != ID or is_seed(name, value), patterns))
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, value, seed, n): edges of the graph. A value is named by a hash; assignments of anything else count against their name, under no value."""
    forget()
    for b in lean(batches):
        counts: dict[tuple[str, str, int], int] = {}
        for t in b.column(0):
            text = t.as_py()
            own = instances(text)
            for i in own:
                value = xxhash.xxh3_128_hexdigest(text[i.start : i.end].encode())
                for p in i.patterns:
                    edge = (p, value, int(i.seed))
                    counts[edge] = counts.get(edge, 0) + 1
            if "=" in text or ":" in text:
                filled = {i.start for i in own}
                for start, name in assignments(text).items():
                    if start not in filled:
                        edge = (f"K{name}", "", 0)
                        counts[edge] = counts.get(edge, 0) + 1
        columns = list(zip(*counts)) or [()] * 3
        kinds = (pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(list(counts.values()), pa.int64())], names=["pattern", "value", "seed", "n"])


def _bit(words: str) -> int:
    return xxhash.xxh3_64_intdigest(words.encode()) % BITS


def _holds(bits: bytes, words: str) -> int:
    h = _bit(words)
    return bits[h >> 3] >> (h & 7) & 1


def _filter(listed: DataFrame) -> bytes:
    """BITS bits, those of each pattern and of the second word of each pair of words. Its size is the same for any number of patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 64, dtype=np.uint64)
        for b in batches:
            for c in b.column(0).to_pylist():
                for h in (_bit(c), _bit(c.split(" ")[1] if c[0] == "L" else c)):
                    bits[h >> 6] |= np.uint64(1 << (h & 63))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits[at].view(np.int64), pa.int64())], names=["place", "bits"])

    found = listed.select("pattern").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, dtype="<i8")
    bits[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return bits.tobytes()


def _occurrences(docs: DataFrame, bits: bytes, held: int = 100_000) -> DataFrame:
    """(pattern, occurs): how often the texts hold each pair of words, whatever follows. Some others that pass the filter are among them."""

    def batch(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        second: dict[str, int] = {}
        counts: dict[str, int] = {}
        other: set[str] = set()
        for b in batches:
            for t in b.column(0):
                words = ["^", "^", *t.as_py().lower().split()]
                last = ""
                for w in words:
                    known = second.get(w)
                    if known is None:
                        known = _holds(bits, w)
                        if len(w) < 100:  # what is remembered is bounded in bytes
                            second[w] = known
                    if known and last:
                        c = f"L{last} {w}"
                        if c in counts:
                            counts[c] += 1
                        elif c not in other:
                            if _holds(bits, c):
                                counts[c] = 1
                            elif len(c) < 200:
                                other.add(c)
                    last = w
                if len(second) > held:
                    second.clear()
                if len(other) > held:
                    other.clear()
                if len(counts) > held:
                    yield batch(counts)
                    counts = {}
        yield batch(counts)

    return docs.mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("occurs"))


def trusted_patterns(texts: DataFrame, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(pattern, confidence): patterns of ``texts(text)`` that identifiers fill.

    The graph is aggregated to (pattern, value) with counts before anything is joined; a value that a third of all rows
    hold is one node. Patterns with fewer than ``support`` different values can never be trusted and are left out at
    once. Everything stays in tables, with the same support at any size; the driver sees filters and counts.
    """
    edges = texts.mapInArrow(_seen, "pattern string, value string, seed int, n long").groupBy("pattern", "value").agg(F.sum("n").alias("n"), F.max("seed").alias("seed"))
    edges = stash(edges, "edges")
    met = edges.groupBy("pattern").agg(F.count(F.when(F.col("value") != "", 1)).alias("values"), F.sum("n").alias("sum_n"), F.count("*").alias("degree"))
    met = stash(met.where(F.col("values") >= support), "met")
    none = met.select("pattern", F.lit(0.0).alias("confidence")).limit(0)
    pairs = met.where(F.col("pattern").startswith("L"))
    if met.isEmpty():
        return none
    total = edges.count()
    if pairs.isEmpty():
        sized = met.withColumn("size", F.col("sum_n"))
    else:
        occurrences = _occurrences(texts, _filter(pairs))
        # of a name or a shape every occurrence is an edge; pairs of words also stand before other things
        sized = met.join(occurrences, "pattern", "left").withColumn("size", F.greatest("sum_n", F.coalesce("occurs", F.lit(0))))
    sized = stash(sized.select("pattern", "size", "degree", F.col("degree").alias("rows")), "sized")
    graph = stash(skewed_lookup(edges, sized, "pattern", "rows", total).withColumnRenamed("degree", "g_degree"), "graph")
    sure = stash(graph.where("value <> ''").groupBy("value").agg(F.max("seed").cast("double").alias("sure"), F.count("*").alias("degree")), "sure")
    trusted, total = stash(none, "trusted"), graph.count()
    while True:
        scored = skewed_lookup(graph, sure.where("sure > 0"), "value", "degree", total).groupBy("pattern").agg(
            F.least(F.lit(1.0), F.sum(F.col("n") * F.col("sure")) / F.max("size")).alias("confidence"), F.count("*").alias("filled"), F.max("g_degree").alias("degree")
        )
        new = scored.where((F.col("confidence") >= confident) & (F.col("filled") >= support)).select("pattern", "confidence", "degree").join(trusted, "pattern", "left_anti")
        new = stash(new, "new")
        if new.isEmpty():
            return trusted
        trusted = stash(trusted.unionByName(new.drop("degree")), "trusted")
        marked = skewed_lookup(graph, new, "pattern", "degree", total).where("value <> ''").groupBy("value").agg(F.max("confidence").alias("now"))
        sure = stash(sure.join(marked, "value", "left").select("value", F.greatest("sure", F.coalesce("now", F.lit(0.0))).alias("sure"), "degree"), "sure")


def _marked(texts: DataFrame, trusted: DataFrame) -> DataFrame:
    """(_digest, _more): the identifiers that fill trusted patterns, for each different text that has any."""
    bits = _filter(trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, str, int, int]] = []
            for t, digest in zip(b.column(0), b.column(1)):
                for i in instances(t.as_py()):
                    rows += [(digest.as_py(), p, i.start, i.end) for p in i.patterns if i.kind == ID and _holds(bits, p)]
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_digest", "pattern", "start", "end"])

    asked = texts.select("text", F.sha2("text", 256)).mapInArrow(run, "_digest string, pattern string, start long, end long").distinct()
    return stash(asked.join(trusted, "pattern").groupBy("_digest").agg(F.collect_set(F.struct("start", "end")).alias("_more")), "marked")


def find(docs: DataFrame, text_col: str = "text", trusted: DataFrame | None = None, redacted: bool = False) -> DataFrame:
    """All columns of ``docs`` and two arrays of (start, kind, end), by start, then kind: ``base`` and ``spans`` (all).

    A null text counts as empty and has no spans; texts are read whole; every row has its result, repeated or not, and
    no rows give no rows. Added spans, seeds that are not of the base and what fills trusted patterns, have the kind "id"
    and are never part of a base span. Names that ``docs`` has already are given a trailing underscore. With ``redacted``,
    spans in the text itself are replaced by their kinds. ``trusted`` has the patterns to go by, if they are known.
    """
    given, at, width = docs.columns, docs.columns.index(text_col), len(docs.columns)
    docs = plain(docs)
    whole = F.coalesce(F.col(f"c{at}").cast("string"), F.lit(""))
    texts = docs.select(whole.alias("text"))
    trusted = trusted_patterns(texts) if trusted is None else trusted
    few = trusted.limit(FEW + 1).count() <= FEW
    sent = frozenset(r["pattern"] for r in trusted.select("pattern").collect()) if few else frozenset()
    names = ["base", "spans"]
    for i, n in enumerate(names):
        while names[i] in given:
            names[i] += "_"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in lean(batches):
            columns, base, spans, texts = list(b.columns)[:width], [], [], []
            marked = [None] * len(b) if few else b.column(width).to_pylist()
            for t, m in zip(b.column(at), marked):
                text = t.as_py()
                own = instances(text) if text else []
                x = [(i.start, i.kind, i.end) for i in own if i.kind != ID]
                more = {(r["start"], r["end"]) for r in m or ()}
                more |= {(i.start, i.end) for i in own if i.kind == ID and (i.seed or not sent.isdisjoint(i.patterns))}
                y = sorted(x + [(a, ID, z) for a, z in more])
                base.append([{"start": a, "kind": k, "end": z} for a, k, z in x])
                spans.append([{"start": a, "kind": k, "end": z} for a, k, z in y])
                if redacted:
                    texts.append(redact(text, y) if y else text)
            if redacted:
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base, kind), pa.array(spans, kind)], names=[*b.schema.names[:width], *names])

    schema = StructType([*docs.schema.fields])
    for n in names:
        schema = schema.add(n, _SPANS)
    if few:
        return docs.mapInArrow(run, schema).toDF(*given, *names)
    keyed = docs.withColumn("_digest", F.sha2(whole, 256))
    return keyed.join(_marked(texts, trusted), "_digest", "left").select(*docs.columns, "_more").mapInArrow(run, schema).toDF(*given, *names)


def _listed(spans: str):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans replaced by their kinds; of spans that overlap, the first is named."""
    out, at = [], 0
    for a, k, z in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def count(spans: str, kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return find(docs).select("doc_id", *[count("base", k) for k in range(ID)], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), count("spans", ID))
