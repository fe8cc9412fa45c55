"""Sources and sinks for record files: JSON lines, shards, ledgers, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimark.sources.scratch import written


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Lines end with LF only (texts may hold U+2028). strict: a broken line is an error;
    otherwise it is left out."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", mode).json(path)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that isn't there is an empty relation."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema)


def stream_jsonl(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).option("lineSep", "\n").json(folder)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def with_shards(df: DataFrame, order: list, size: int) -> DataFrame:
    """df with shard: numbers of `size` rows in order; size <= 0 is one shard. Rows are counted
    by ranges first, so no task sorts all of them. The ranges are written: planned twice, once to
    number rows and once to count them, they would be cut at different places."""
    if size <= 0:
        return df.withColumn("shard", F.lit(0).cast("long"))
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of the range above 33 bits, the number of the row within it below.
    numbered = written(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    totals = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))  # a row per range
    at = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(starts), "_part").withColumn("shard", F.floor(at / size)).drop("_part", "_at", "_start")


def write_shards(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("shard").json(path)


def read_datasets(spark: SparkSession, paths: dict[str, str], schema: StructType | str) -> DataFrame:
    """Several files as one relation with a dataset column."""
    out = None
    for name, path in paths.items():
        own = read_jsonl(spark, path, schema).withColumn("dataset", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def append_ledger(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_ledger(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.withColumns({c: F.col(c).try_cast("double") for c in numeric})


def read_cards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(folder)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, length of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def unscored(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates whose (query_id, doc_id) the cache doesn't have: where scoring resumes."""
    return candidates.join(cache.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
