"""Tables in the shared folder."""

from pathlib import Path

from pyspark.sql import functions as F

from sedimark.sources import scratch


def test_written_tables_leave_no_shuffle_files(spark):
    """What a table was shuffled for goes as it is written; the session's setting stays as it was."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f.name for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key)
    rows = spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 99).alias("k")).agg(F.sum("id").alias("s"))
    table = scratch.written(rows)
    assert files() <= before and spark.conf.get(key) == was
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    assert files() - before  # such as a plain collect leaves
