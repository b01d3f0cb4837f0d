"""Session helpers shared by the library."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves if Spark runs on it
    alone, as in tests; a cluster has to name one.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def text_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 32) -> None:
    """Lower Arrow's rows and bytes per batch, from Spark's 10,000 rows of any size, for operators that hand whole texts to Python.

    Settings of the session, as Spark reads them when a lazy result runs; lower ones stay.
    """
    for key, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", megabytes << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        have = spark.conf.get(key)
        # Sizes may be written with a unit.
        if not have.isdigit() or int(have) > limit:
            spark.conf.set(key, str(limit))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all shuffle partitions: few small rows that stand for much work must not be put together for their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def task_groups(spark: SparkSession, most: int) -> int:
    """Groups for work that copies a table to each of them: two for each core, as more would only take disk; 12 at least, while executors may still come."""
    return min(most, max(12, 2 * spark.sparkContext.defaultParallelism))


#: Shuffle files go at the end of a run, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors, and what was shuffled for it is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*frames: DataFrame) -> None:
    """Delete what stash() wrote, once nothing reads it any more; only files in the shared folder go."""
    for df in frames:
        spark = df.sparkSession
        inside = shared_dir(spark).rstrip("/") + "/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if folder.split(":", 1)[-1].lstrip("/").startswith(inside.split(":", 1)[-1].lstrip("/")):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
