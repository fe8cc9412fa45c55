"""Intermediate tables in the folder that all executors share.

`written` cuts a plan's lineage: another executor can rebuild any lost task from the files. Tables
of a session are in one folder, which is removed when the Python process ends. The shuffle files
that a table was made from go as soon as it is written, not when the driver happens to collect its
garbage.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _remove(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM may have gone before
        pass


def folder(spark: SparkSession) -> str:
    """This session's folder in spark.checkpoint.dir. Where that is unset, a temporary folder, which
    only a local session may use."""
    sc = spark.sparkContext
    if found := getattr(sc, "_sedimark_folder", None):
        return found
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sedimark-")
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    sc._sedimark_folder = f"{path.rstrip('/')}/sedimark-{uuid.uuid4().hex}"
    atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), sc._sedimark_folder)
    return sc._sedimark_folder


@contextlib.contextmanager
def _without_shuffle_files(spark: SparkSession):
    """Statements inside remove their shuffle files at their end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _without_shuffle_files(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
