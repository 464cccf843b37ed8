"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[str] = []
_every: list[list[str]] = []
_lock = threading.Lock()


class _Folders(threading.local):
    """The scratch folders that this thread's queries wrote, in order: other threads' are not its to delete."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        with _lock:
            _every.append(self.paths)


_own = _Folders()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset and all tasks run on this machine, a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltworks-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/siltworks/{name}-{uuid.uuid4().hex}"
    with _lock:
        if not any(_every):
            atexit.unregister(clear_scratch)
            atexit.register(clear_scratch, spark)
    _own.paths.append(path)
    return path


def scratch_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and read it with its own schema.

    A lost executor costs a re-read, not a recomputation; row ids and random draws are fixed once written.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_buckets(df: DataFrame, name: str, buckets: int, key: str, by: str | None = None) -> DataFrame:
    """``scratch_table`` whose rows lie in ``buckets`` by hash of ``key``: grouping by ``key`` needs no shuffle.

    Spark keeps buckets in its catalogue only: the entry is dropped by ``clear_scratch``, the files with it.
    """
    path = scratch_path(df.sparkSession, name)
    table = f"silt_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key)
    (writer.partitionBy(by) if by else writer).saveAsTable(table)
    with _lock:
        _tables.append(table)
    return df.sparkSession.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_mark() -> int:
    """Where this thread's list of scratch tables stands; for ``drop_scratch`` in the same thread."""
    return len(_own.paths)


def drop_scratch(spark: SparkSession, mark: int, last: int = 1) -> None:
    """Delete the tables that this thread wrote since ``mark`` but the ``last`` ones, which hold what is still needed."""
    paths = _own.paths
    gone = paths[mark : len(paths) - last]
    del paths[mark : len(paths) - last]
    for path in gone:
        drop_path(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this process's scratch tables, those of all threads; call it once their results are stored."""
    with _lock:
        tables, paths = list(_tables), [p for some in _every for p in some]
        _tables.clear()
        for some in _every:
            some.clear()
    try:
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in paths:
            drop_path(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit; files are then left behind
        return
