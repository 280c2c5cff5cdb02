import math
import random
import zlib

import numpy as np
import pytest
from helpers import documents

from sievework.llm import toxicity

BAD = ["nastyword", "vilething", "horridly"]


def made(n=900, seed=2):
    """Documents of made-up words; one in six holds bad words. Labels of all."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ba", "ne", "to", "ri", "lu", "sha", "men", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        ws = rng.choices(words, k=rng.randint(5, 60))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(BAD))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = made()
    rows += [(5000, None), (5001, ""), (None, "ba ne to"), (5002, "ba nastyword to"), (5003, "ba n4styw0rd to"), (5004, "ne n a s t y w o r d ri"), (5005, "ne nastywooooord ri"), (5006, "to n.a.s.t.y.w.o.r.d ba"), (5007, "ba ne " * 20_000), (5007, "ba ne " * 20_000)]
    labels += [(None, 1, 1), (3, None, None), (4, 1, 7), (5, 0, 0)]
    docs, given = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, {i: t for i, _, t in labels}, toxicity.toxicity(docs, given).collect()


def test_held_out_accuracy(fitted):
    rows, labels, got = fitted
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(held) > 200 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    right = np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held])
    assert right >= 0.97


def test_obfuscated_words_are_restored(fitted):
    got = {r["doc_id"]: r["predicted"] for r in fitted[2]}
    assert [got[i] for i in range(5002, 5007)] == [1] * 5 and got[5000] == got[5001] == got[5007] == got[None] == 0


def test_no_labels_or_documents(spark):
    docs = documents(spark, [(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(documents(spark, []), none).count() == 0


def brute_viterbi(columns, model):
    """All readings, the likeliest."""
    import itertools

    def code(c):
        return ord(c) - 96 if "a" <= c <= "z" else 0

    best = None
    for choice in itertools.product(*columns):
        a = b = 0
        score = 0.0
        for c, cost in choice:
            score += cost
            if c:
                score += model[a, b, code(c)]
                a, b = b, code(c)
        score += model[a, b, 0]
        if best is None or score > best[0] + 1e-12:
            best = (score, "".join(c for c, _ in choice))
    return best


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(27) * 0.3, size=(27, 27)) + 1e-6)
    for token in ("h3ll0", "b1tt3r", "aaab", "a.b_c", "s$1!x", "x"):
        columns = toxicity.lattice(token)
        score, word = brute_viterbi(columns, model)
        assert toxicity.viterbi(columns, model) == word


def test_trigram_counts():
    counts = toxicity.trigram_counts(iter([b"AbC"]))
    assert counts[1 * 27 * 27 + 2 * 27 + 3] == 1 and counts.sum() == 5


def test_every_token_with_several_readings_is_decoded():
    counts = toxicity.trigram_counts(iter([b"the", b"stupid", b"idiot", b"is", b"an", b"ass"] * 50)).reshape(27, 27, 27) + 0.1
    reader = toxicity.Reader(np.log(counts / counts.sum(axis=2, keepdims=True)))
    for noisy, word in (("stuupid", "stupid"), ("idioot", "idiot"), ("a$$", "ass"), ("@$$", "ass"), ("(a$$)", "ass"), ("stuupid,", "stupid"), ("s t  u\tp \n i  d", "stupid"), ("st.up_id", "stupid")):
        assert word in reader.features(f"the {noisy} is"), noisy
    assert reader.features("the stupid") == {"the", "stupid", "stup-", "stupi-"}
    for token in ("idiot", "idiot.", "idiot,", "idiot?", "idiot:", "É,", ".", "x;", "the?!", "the."):  # as through the lattice
        words = toxicity._WORD.findall(token) + toxicity._WORD.findall(toxicity.decoded(token, reader.model) or "")
        assert set(reader._token(token)) >= {f for w in words for f in toxicity._named(w)} and (len(words) > 0) == (len(reader._token(token)) > 0)


def test_model_lexicon_and_scores_against_brute_force(spark):
    rows, labels = made(300, 5)
    docs, given = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.fit(docs, given)

    counts = np.full((27, 27, 27), 0.1)
    for _, t in rows:
        code = [0, 0, *[ord(c) - 96 if "a" <= c <= "z" else 0 for c in t.lower()], 0, 0]
        for abc in zip(code, code[1:], code[2:]):
            counts[abc] += 1
    brute = np.log(counts / counts.sum(axis=2, keepdims=True))
    # how texts of a batch follow one another is the only difference: blanks
    assert np.abs(found.model[1:, 1:, :] - brute[1:, 1:, :]).max() < 1e-9

    train = [(t, labels[i][2]) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    n1, n0 = (len({min(toxicity.xxhash.xxh64_intdigest(" ".join(t.split()[k : k + 5])) >> 1 for k in range(max(1, len(t.split()) - 4))) for t, y in train if y == label}) for label in (1, 0))
    seen = {}
    for t, y in train:
        ws = set(t.split())  # made-up words without doubled letters have one reading
        for w in ws | {w[:n] + "-" for w in ws for n in (4, 5) if len(w) > n}:
            seen.setdefault(w, [0, 0])[y] += 1
    lexicon = {}
    for w, (c, t) in seen.items():
        if t >= 3 and t * n0 > c * n1 * 3:
            cells = [(t, n1, t + c), (c, n0, t + c), (n1 - t, n1, n1 + n0 - t - c), (n0 - c, n0, n1 + n0 - t - c)]
            if 2 * sum(o * math.log(o * (n1 + n0) / (a * b)) for o, a, b in cells if o > 0) >= 28:
                lexicon[w] = math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))
    assert set(found.lexicon) == set(lexicon) and set(lexicon) >= set(BAD) and all(abs(found.lexicon[w] - x) < 1e-9 for w, x in lexicon.items())

    def measures(text):
        ws = set(text.split())
        w = [lexicon[f] for f in ws | {w[:n] + "-" for w in ws for n in (4, 5) if len(w) > n} if f in lexicon]
        return (1.0, max(w), math.log1p(len(w))) if w else (1.0, 0.0, 0.0)

    x, y, w = np.array([measures(t) for t, _ in train]), np.array([y for _, y in train]), np.array(found.weights)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    assert np.abs(x.T @ (p - y) + 1e-2 * w).max() < 1e-5  # the ridge's optimum
    for r in toxicity.score(docs, found).collect():
        assert abs(r["toxicity"] - 1 / (1 + math.exp(-np.clip(np.dot(measures(r["text"]), w), -30, 30)))) < 1e-9
