"""Dataset files as DataFrames that know the order of their rows."""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSONL, PARQUET = "jsonl", "parquet"
SUFFIXES = {".jsonl": JSONL, ".json": JSONL, ".parquet": PARQUET, ".pq": PARQUET}
#: The 0-based row number that every loaded dataset carries beside its own columns.
ROW = "__row"


class Dataset(NamedTuple):
    """A loaded dataset. ``frame`` has the file's columns and ROW; ``columns`` are the file's, in the file's order."""

    frame: DataFrame
    format: str
    path: str
    columns: list[str]
    size_bytes: int

    @property
    def records(self) -> DataFrame:
        return self.frame.select(*["`" + c.replace("`", "``") + "`" for c in self.columns])

    def rows(self) -> int:
        return self.frame.count()


def detect_format(path: str | Path) -> str:
    p = Path(path)
    if p.suffix.lower() not in SUFFIXES:
        raise ValueError(f"Unsupported format for '{p.name}' (suffix '{p.suffix.lower()}'). Supported: {', '.join(sorted(SUFFIXES))}")
    return SUFFIXES[p.suffix.lower()]


def resolve(path: str | Path) -> Path:
    return Path(path).expanduser().resolve()


def file_size_bytes(path: str | Path) -> int:
    p = Path(path)
    return sum(f.stat().st_size for f in p.rglob("*") if f.is_file() and not f.name.startswith(("_", "."))) if p.is_dir() else p.stat().st_size


def _numbered(raw: DataFrame) -> DataFrame:
    """Add ROW: rows in the order of file path, block within the file and place within the block.

    Each block is one task's, so its places come from the task's counter; blocks are counted first and get their offsets
    by a window over one row for each of them.
    """
    placed = raw.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    offsets = blocks.select("__file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(offsets, ["__file", "__block"]).withColumn(ROW, F.col("__at") + F.col("__shift")).drop("__file", "__block", "__at", "__shift")


def _json_columns(lines: DataFrame) -> list[str]:
    """Keys in the order in which they are first seen."""
    keys = lines.select(F.col(ROW), F.posexplode(F.json_object_keys("value")).alias("pos", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(ROW, "pos")).alias("first")).orderBy("first")
    return [r["key"] for r in first.collect()]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """One JSON object a line; blank lines are skipped, other lines that aren't objects raise when they are read."""
    lines = _numbered(spark.read.text(path).where(F.trim("value") != ""))
    if schema is None:
        inferred = spark.read.option("mode", "FAILFAST").option("inferTimestamp", "false").json(path).schema
        columns = [c for c in _json_columns(lines) if c in inferred.names]
        schema = T.StructType([inferred[c] for c in columns])
    columns = list(schema.names)
    # renumbered, as blank lines took no number of their own
    parsed = lines.withColumn("__record", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return parsed.select(*[F.col("__record").getField(c).alias(c) for c in columns], ROW), columns


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    raw = spark.read.parquet(path)
    if Path(path.removeprefix("file://")).is_dir():
        return _numbered(raw.select("*", "_metadata")).drop("_metadata"), list(raw.columns)
    return raw.select("*", F.col("_metadata.row_index").alias(ROW)), list(raw.columns)


def read_dataset(spark: SparkSession, path: str | Path, schema: T.StructType | None = None, allow_directory: bool = False) -> Dataset:
    """Load a file (or, if allowed, a folder of files of one format, named like a file). Lazy but for JSON's schema."""
    p = resolve(path)
    if not p.exists():
        raise FileNotFoundError(f"Dataset not found: {p}")
    if not p.is_file() and not allow_directory:
        raise ValueError(f"Expected a file, got: {p}")
    kind = detect_format(p)
    frame, columns = read_jsonl(spark, str(p), schema) if kind == JSONL else read_parquet(spark, str(p))
    return Dataset(frame, kind, str(p), columns, file_size_bytes(p))


def dataset_of(df: DataFrame, order: list[str], name: str = "(frame)") -> Dataset:
    """A DataFrame as a dataset; ``order`` columns, which must be unique together, give the rows' numbers."""
    from ..operators.ranking import global_rank

    return Dataset(global_rank(df, order, ROW), "frame", name, list(df.columns), 0)
