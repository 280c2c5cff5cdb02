"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, on one machine only, one of our own where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="sievework-")
    return _OWN_DIRS[app]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean(spark: SparkSession) -> None:
    """At the end of the process: what was written for a session that is still running goes."""
    sc = spark.sparkContext
    if sc._jsc is not None:
        for path in _WRITTEN.pop(sc.applicationId, ()):
            _delete(spark, path)


def stash(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and an executor's loss costs nothing.

    The table stays until ``discard`` or the end of the process. ``options`` are the writer's.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = set()
        atexit.register(_clean, spark)
    _WRITTEN[app].add(path)
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stashed = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that ``stash`` wrote, once nothing reads it any more."""
    path, spark = df._stashed, df.sparkSession
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)
    _delete(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sievework-py-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def bound_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Bound the bytes, not only the rows, of batches sent to Python, unless the session does so more strictly itself.

    A batch is held several times over: in buffers that double as they grow and lie outside of the executor's heap, and in
    the worker with what is made of it, for each task that runs at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > limit:
        spark.conf.set(name, str(limit))


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster, use the session that the cluster gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    bound_batches(spark)
    return spark
