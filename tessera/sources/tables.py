"""Parquet tables of a data folder, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shipped(spark: SparkSession) -> None:
    """Sees to it that workers can import this package: where it isn't on PYTHONPATH, which they are given,
    it is sent to them once for each context."""
    package = Path(__file__).resolve().parents[1]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if package.parent in known or getattr(context, "_has_" + package.name, False):
        return
    folder = tempfile.mkdtemp(prefix=package.name)
    shutil.copytree(package, f"{folder}/src/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/src"))
    setattr(context, "_has_" + package.name, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (one Parquet file or a folder of them)."""
    shipped(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, and where it is read in fewer parts than there are cores (a small table in one file),
    dealt out over all of them. A table of more parts is never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    Where a session on one machine names none (tests), a local folder is set once for it; on a cluster
    the setting is required, since executors would write to folders that the others can't see.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Removes what ``settled`` wrote for this application. It is called when the application ends; results
    that still rest on these tables can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _discard_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            discard(spark)
    except Exception:  # noqa: BLE001 - the context may be gone, and the folder then stays
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING, _LOCK = {}, threading.Lock()


@contextmanager
def _cleaned(spark: SparkSession):
    """Shuffle files of what is run here go when it ends: nothing comes back to them, and they would stay
    until the driver collects its garbage. The setting is as before once no thread of the session needs it."""
    key = spark.sparkContext.applicationId, id(spark._jsparkSession)
    with _LOCK:
        n, was = _CLEANING.get(key, (0, spark.conf.get(_CLEANUP, None)))
        _CLEANING[key] = n + 1, was
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, was = _CLEANING.pop(key)
            if n > 1:
                _CLEANING[key] = n - 1, was
            elif was is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, was)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and
    keeps what several later stages read from being computed again."""
    spark = df.sparkSession
    shipped(spark)
    if not getattr(spark.sparkContext, "_discards", False):
        spark.sparkContext._discards = True
        atexit.register(_discard_at_exit, spark)
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
