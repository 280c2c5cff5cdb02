import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.canonical import record_json, text_digest
from sievework.functions.text import display, near_text, strip

SPACES = [chr(i) for i in range(0x110000) if chr(i).isspace()]


def python_json(record: dict, strip_: bool) -> str:
    def value(v):
        if isinstance(v, str):
            return v.strip() if strip_ else v
        if isinstance(v, dict):
            return {k: value(x) for k, x in v.items()}
        if isinstance(v, list):
            return [value(x) for x in v]
        return v if v is None or isinstance(v, (bool, int, float)) else str(v)

    return json.dumps({k: value(v) for k, v in record.items()}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_strip_knows_every_space(spark):
    assert len(SPACES) == 29
    texts = [f"{s}a{s}b{s}" for s in SPACES] + ["​x​", "".join(SPACES), "", "plain"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", strip(F.col("t")).alias("s"), near_text(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["s"] for r in got] == [t.strip() for t in texts]
    assert [r["n"] for r in got] == [" ".join(t.lower().split()) for t in texts]


def test_record_json_is_pythons(spark):
    rng = random.Random(5)
    schema = T.StructType([
        T.StructField("s", T.StringType()), T.StructField("i", T.LongType()), T.StructField("b", T.BooleanType()), T.StructField("d", T.DoubleType()),
        T.StructField("a", T.ArrayType(T.StringType())), T.StructField("n", T.StructType([T.StructField("z", T.StringType()), T.StructField("a", T.IntegerType())])),
        T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("day", T.DateType()), T.StructField("odd \"name", T.StringType()),
    ])
    alphabet = [*"abc \"\\\n\t\r\b\f/", *map(chr, range(32)), "é", "☃", "😀", " ", "\x7f"]

    def text():
        return "".join(rng.choices(alphabet, k=rng.randint(0, 8)))

    rows = []
    for _ in range(150):
        rows.append((
            text() if rng.random() < 0.9 else None, rng.choice([None, 0, -5, 2**60]), rng.choice([None, True, False]), rng.choice([None, 0.1, 1e16, 1e22, 1e-7, -0.0, 1e10, 123456.75, 3.0]),
            rng.choice([None, [], [text(), None]]), rng.choice([None, {"z": text(), "a": None}, {"z": None, "a": 3}]), rng.choice([None, [1.5, None, 1e16]]), rng.choice([None, dt.date(2024, 2, 29)]), text(),
        ))
    df = spark.createDataFrame(rows, schema)
    for flag in (True, False):
        got = [r[0] for r in df.select(record_json(df, flag)).collect()]
        assert got == [python_json(dict(zip(schema.names, r)), flag) for r in rows]


def test_special_floats_timestamps_decimals(spark):
    df = spark.sql("select double('NaN') a, double('-Infinity') b, timestamp_ntz'2024-01-02 03:04:05.5' c, timestamp_ntz'2024-01-02 03:04:05' d, cast(1.50 as decimal(10,2)) e, cast('hi' as binary) f, float(0.1) g, map('k', 1) m, null n")
    got = json.loads(df.select(record_json(df, True)).first()[0])
    assert got["c"] == "2024-01-02 03:04:05.500000" and got["d"] == "2024-01-02 03:04:05" and got["e"] == "1.50" and got["g"] == 0.10000000149011612
    assert got["b"] == float("-inf") and got["a"] != got["a"] and got["m"] == {"k": 1} and got["n"] is None


def test_text_digest_of_a_known_text(spark):
    df = spark.createDataFrame([("hello",), (" hello\n",)], "t string")
    known = "cbbbdcd27692344de5dbab3abcaba413fb0f45307267de7081401576df1cb176"
    assert [r[0] for r in df.select(text_digest(F.col("t"), True)).collect()] == [known, known]
    assert df.select(text_digest(F.col("t"), False)).collect()[1][0] == hashlib.sha256(b'{"text":" hello\\n"}').hexdigest()


@pytest.mark.parametrize("n", [119, 120, 121, 500])
def test_display(spark, n):
    got = spark.createDataFrame([("é" * n,), (None,)], "t string").select(display(F.col("t"))).collect()
    assert got[0][0] == ("é" * n if n <= 120 else "é" * 119 + "…") and got[1][0] == "null"
