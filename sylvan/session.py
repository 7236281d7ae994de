"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, name: str = "sylvan") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in ``spark.checkpoint.dir``;
    only where that is unset (local tests) is a temporary one made."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sylvan-")
        sc.setCheckpointDir(named)
    return named or os.path.dirname(sc.getCheckpointDir())


def _session_dir(spark: SparkSession) -> str:
    """This session's folder in the shared one; it is deleted when the session's JVM ends."""
    sc = spark.sparkContext
    known = getattr(sc, "_sylvan_dir", None)
    if known is None:
        known = f"{shared_dir(spark).rstrip('/')}/sylvan-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        path = sc._jvm.org.apache.hadoop.fs.Path(known)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._sylvan_dir = known
    return known


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share, deleted when the session ends."""
    return _session_dir(spark)


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of a file with ``data`` in this session's folder."""
    return write_file(spark, f"{_session_dir(spark)}/{name}", data)


def write_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file to any file system that the cluster knows."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    try:
        out = fs.create(path, True)
        out.write(data)
        out.close()
    finally:
        fs.setWriteChecksum(True)
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: ends its lineage, survives
    lost executors, keeps columnar pruning and real size statistics for later joins."""
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sylvan_cut = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``, once nothing lazy is derived from it any more. A
    DataFrame that is none of its results is left alone."""
    path = getattr(df, "_sylvan_cut", None)
    if path is not None:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def once(spark: SparkSession, source: str, name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a session for each state (time and size) of the source files."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    state = (source, name, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength())
    held = sc.__dict__.setdefault("_sylvan_once", {})
    if state not in held:
        held[state] = make()
    return held[state]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
