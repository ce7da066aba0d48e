"""Session helpers: a local session for tests and benches, and tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("netsets")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one (tests) gets a new folder below TMPDIR, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-netsets-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: cuts the lineage and survives lost executors.

    The table is removed by discard(), or with the driver's end.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if not _paths:
        atexit.register(_remove_all)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[path] = spark
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if _paths.pop(path, None) is not None:
            _remove(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage: the shuffle files of plans that are through go only with their objects. Nothing within TIDY_S."""
    if time.monotonic() - _tidied[0] < TIDY_S:
        return
    _tidied[0] = time.monotonic()
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    """What this driver has written and not discarded; nothing where the session has ended already."""
    for path, spark in list(_paths.items()):
        if spark.sparkContext._jsc is None:
            return
        try:
            _remove(spark, path)
        except Exception:  # the session's process has ended before: there is nobody to ask
            return


_paths: dict[str, SparkSession] = {}
#: Seconds between two collections of garbage, at least, and when the last began.
TIDY_S, _tidied = 5, [0.0]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once per application; local sessions have it already."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-netsets-"), "netsets"), "zip", os.path.dirname(root), os.path.basename(root))
    context.addPyFile(archive)  # served by the driver; the archive itself is not read on other machines
    _shipped.add(context.applicationId)
