"""Fixtures that several operators' tests share."""

import random

DOCS = "doc_id long, text string, lang string, fp long, key long, spans string, base string, copies int"


def documents(spark, rows):
    """A documents table with extra columns whose names operators use themselves; rows are (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", 1, 2, "x", "y", 3) for i, t in rows], DOCS)


def corpus(n=120, seed=3):
    """Texts with copies, near copies, a third from one group, nulls, blanks, repeated rows and a row without an id."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    base = " ".join(rng.choices(vocabulary, k=80))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            words = base.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))))
    long = " ".join(rng.choices(vocabulary, k=30_000))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "One"), (n + 4, "ONE"), (None, "no id at all"), (n + 5, long), (n + 6, long + " end"), (5, rows[5][1]), (5, rows[5][1])]
    return rows
