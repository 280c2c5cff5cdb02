"""Auditing data as it arrives: batches of a stream against an index of digests in storage."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.canonical import record_digest
from ..session import discard, stash


def with_stream_digest(stream: DataFrame, columns: list[str] | None = None, strip: bool = True) -> DataFrame:
    """The digest column is the same expression as for tables."""
    return stream.withColumn("digest", record_digest(stream, strip, columns))


def drop_repeats(stream: DataFrame, time_col: str, delay: str, columns: list[str] | None = None, strip: bool = True) -> DataFrame:
    """The stream without records seen before within ``delay`` of event time; state is bounded by the watermark."""
    return with_stream_digest(stream, columns, strip).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["digest"])


def windowed_counts(stream: DataFrame, time_col: str, delay: str, window: str, strip: bool = True) -> DataFrame:
    """Records and (approximate) distinct records for each window of event time."""
    digested = with_stream_digest(stream, [c for c in stream.columns if c != time_col], strip).withWatermark(time_col, delay)
    return digested.groupBy(F.window(time_col, window)).agg(F.count("*").alias("records"), F.approx_count_distinct("digest").alias("distinct_records"))


def audit_into(stream: DataFrame, index: str, output: str, checkpoint: str, columns: list[str] | None = None, strip: bool = True) -> StreamingQuery:
    """Write each micro-batch to ``output/run=<run>/batch=<id>`` with ``seen``: whether its digest is in the index already, or
    earlier in the batch; new digests join the index.

    A run is named by its checkpoint: a repeated batch overwrites what it wrote before, and an index that other runs have
    filled is read from the first batch on. Of equal records in a batch one is new and the others are seen, however many.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        digested = stash(batch.withColumns({"digest": record_digest(batch, strip, columns), "__at": F.monotonically_increasing_id()}), "batch")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            told = spark.read.schema("digest string, run string, batch long").option("basePath", index).parquet(index)
            known = told.where((F.col("run") != run) | (F.col("batch") < number)).select("digest").distinct()
        else:
            known = spark.createDataFrame([], "digest string")
        groups = digested.groupBy("digest").agg(F.min("__at").alias("__first")).join(known.withColumn("__known", F.lit(True)), "digest", "left")
        first = stash(groups.select("digest", "__first", F.coalesce("__known", F.lit(False)).alias("__known")), "first")
        # both sides are written, so a digest that fills the batch is a skewed partition that can be split
        marked = digested.join(first, "digest").withColumn("seen", F.col("__known") | (F.col("__at") != F.col("__first")))
        marked.drop("__at", "__first", "__known").write.mode("overwrite").parquet(f"{output}/run={run}/batch={number}")
        first.where("not __known").select("digest").write.mode("overwrite").parquet(f"{index}/run={run}/batch={number}")
        discard(first)
        discard(digested)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
