"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_MARKED: set[str] = set()
_SCOPE = threading.local()


def build_session(app: str = "isotherm", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators count on.

    ``spark.sql.shuffle.partitions`` is left to the caller: it is a cluster
    size, and AQE coalesces it downwards.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder, which goes with the process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        folder = tempfile.mkdtemp(prefix="isotherm-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_DIRS[context.applicationId] = folder
    return _LOCAL_DIRS[context.applicationId]


def _work_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/isotherm/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table written by a job.

    All paths of an application lie in one folder, which goes when the driver's JVM ends or with ``clear_work``.
    """
    root = _work_root(spark)
    if root not in _MARKED:
        system, target = _file_system(spark, root)
        system.deleteOnExit(target)
        _MARKED.add(root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Work paths that this thread takes inside go when the block ends: for jobs that run again and again, such as micro-batches."""
    outer, _SCOPE.paths = getattr(_SCOPE, "paths", None), []
    try:
        yield
    finally:
        for path in _SCOPE.paths:
            delete_path(spark, path)
        _SCOPE.paths = outer


def clear_work(spark: SparkSession) -> None:
    """Delete what this application has staged; tables that were read from it can no longer be used."""
    delete_path(spark, _work_root(spark))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    For a reduced table that feeds several outputs. It is computed once, an executor that is lost later costs
    nothing, scans of it are pruned, and the optimizer knows its size, from which it decides about broadcasts.
    """
    path = new_work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
