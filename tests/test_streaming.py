from pyspark.sql import functions as F

from sievework.streaming.incremental import audit_into, drop_repeats


def test_incremental_index(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def arrive(k, rows):
        spark.createDataFrame(rows, "text string, n int").coalesce(1).toPandas().to_parquet(src / f"{k}.parquet")
        stream = spark.readStream.schema("text string, n int").parquet(str(src))
        audit_into(stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp"), ["text"]).awaitTermination()

    arrive(0, [("a", 1), ("b", 2)])
    arrive(1, [(" a ", 3), ("c", 4)])
    got = {(r["n"], r["seen"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, False), (2, False), (3, True), (4, False)}
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3
    arrive(2, [("d", 5), ("d ", 6), ("d", 7), ("a", 8), ("e", 9)])
    got = sorted((r["n"], r["seen"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[4:] in [[(5, not f == 5), (6, not f == 6), (7, not f == 7), (8, True), (9, False)] for f in (5, 6, 7)]
    # another run reads the index from its first batch on
    stream = spark.readStream.schema("text string, n int").parquet(str(src))
    audit_into(stream, str(tmp_path / "index"), str(tmp_path / "again"), str(tmp_path / "cp2"), ["text"]).awaitTermination()
    assert {r["seen"] for r in spark.read.parquet(str(tmp_path / "again")).collect()} == {True}
    assert spark.read.parquet(str(tmp_path / "index")).count() == 5


def test_drop_repeats(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), (" a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "text string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = drop_repeats(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s")), "at", "1 hour", ["text"])
    q = stream.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("kept").count() == 2
