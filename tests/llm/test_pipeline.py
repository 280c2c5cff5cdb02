import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_pii import brute, brute_marks
from test_simhash import classes, fingerprint
from test_toxicity import BAD, made
from tokenizers import Tokenizer

from sievework.llm import pii


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, labels = made(400)
    rows += [(1000, rows[7][1]), (1001, rows[7][1] + " tail"), (1002, "write to some@one.example now please thanks"), (1003, None), (1004, "")]
    rows += [(1005, 'set token = "04dbebab91ab85687d33eeaa" there'), (1006, " ".join(f"longword{i} of a text" for i in range(3000)))]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    clean = [(i, t) for i, t in rows if not set((t or "").split()) & set(BAD)]
    kept, seen = [], set()
    for (i, t), root in zip(clean, classes([fingerprint(t) for _, t in clean])):
        if root not in seen:  # rows come by id, so the first of a class has its least id
            seen.add(root)
            kept.append((i, t))
    trusted = brute_marks([t or "" for _, t in kept])
    masked = []
    for i, t in kept:
        more = [(x.start, pii.ID, x.end) for x in pii.instances(t or "") if x.kind == pii.ID and (x.seed or set(x.patterns) & set(trusted))]
        masked.append((i, pii.redact(t, sorted(brute(t) + more)) if t else t))
    assert "<ID>" in dict(masked)[1005]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in masked:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for k in range(-(-len(ids) // 1024)):
            n = (len(ids) - 1) % 1024 + 1 if k == 0 else 1024  # the first piece is the shorter one
            expected.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_stages_take_any_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, `a.b` string, base string, spans string, fp long, key long"
    spark.createDataFrame([(i, 0, i % 2) for i in range(1, 30)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, t, None, None, None, None, "x", "y", "z", 1, 2) for i, t in ((1, "one two three four"), *((k, f"text{k} of its{k} own{k} words{k}") for k in range(4, 30)), (2, None), (None, "mail a@b.cd to us"), (None, None), (3, ""), (1, "one two three four"), (1, "one two three four"))]
    for n in (rows, []):
        docs = spark.createDataFrame(n, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.strip("`") for c in ("doc_id", "text", "lang", "source", "n_chars", "toxicity", "a.b", "base", "spans", "fp", "key")], name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted((r["doc_id"] for r in packed), key=str) == sorted([*range(4, 30), 1, 2, None] if n else [], key=str)
