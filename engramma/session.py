"""Session helpers: reading tables, cutting lineage on shared storage, checked broadcasts."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = re.compile(r"local(\[|-cluster|$)")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; no schema inference beyond the Parquet footers."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a folder of its own; on a cluster that is an error, since the
    machines would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not _LOCAL.match(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = _own_dir()
    spark.sparkContext.setCheckpointDir(own)
    return own


@functools.cache
def _own_dir() -> str:
    own = tempfile.mkdtemp(prefix="engramma-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint, so that lost executors cost no recomputation of what went before."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back (column pruning works on the copy); deleted at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a stored table when the application ends; results that read it are lazy, so not before."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already; nothing is lost but space
        pass


def local_spark(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("engramma")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ENGRAMMA_DRIVER_MEMORY", "6g"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of ``spark``, once a session; they may not share the driver's path."""
    sc = spark.sparkContext
    if getattr(sc, "_engramma_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = shutil.make_archive(os.path.join(_own_dir(), "engramma-src"), "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(packed)
    sc._engramma_shipped = True
