import pytest
from pyspark.sql import functions as F

from sievework.operators.overlap import evidence
from sievework.operators.ranking import global_rank
from sievework.session import discard, shared_dir, stash
from sievework.sources.datasets import ROW, dataset_of


@pytest.fixture
def partitions(spark, request):
    name = "spark.sql.shuffle.partitions"
    held = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, held)


@pytest.mark.parametrize("partitions", [1, 8, 200], indirect=True)
def test_every_row_has_its_place(spark, partitions):
    df = spark.range(0, 20_000, 1, 8).select((F.col("id") * 7919 % 20_000).alias("k"), F.repeat(F.lit("wide "), 50).alias("w"))
    got = global_rank(df, ["k"], "place").select("k", "place").toPandas()
    assert len(got) == 20_000 and (got["k"] == got["place"]).all()
    tied = global_rank(df.select((F.col("k") % 3).alias("k")), [F.desc("k")], "place").toPandas().sort_values("place")
    assert tied["place"].tolist() == list(range(20_000)) and tied["k"].is_monotonic_decreasing
    assert global_rank(df.where("k < 0"), ["k"], "place").count() == 0


@pytest.mark.parametrize("partitions", [200], indirect=True)
def test_frames_are_datasets(spark, partitions):
    df = spark.range(0, 3000, 1, 8).select(F.concat(F.lit("t"), (F.col("id") % 1000).cast("string")).alias("text"), (3000 - F.col("id")).alias("n"))
    d = dataset_of(df, ["n"])
    assert d.columns == ["text", "n"] and d.rows() == 3000
    assert sorted(r[ROW] for r in d.frame.select(ROW).collect()) == list(range(3000))
    numbered = d.frame.select(F.col(ROW).alias("row"), F.col("text").alias("digest"))
    assert [tuple(r) for r in evidence(numbered, numbered, 3).collect()] == [(0, 0), (0, 1000), (0, 2000), (1, 1)]


def test_written_tables_are_deleted(spark, tmp_path):
    df = stash(spark.range(5), "own")
    path = df._stashed.removeprefix("file://")
    import os

    assert df.count() == 5 and os.path.isdir(path) and df._stashed.startswith(shared_dir(spark))
    discard(df)
    assert not os.path.exists(path)
