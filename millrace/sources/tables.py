"""One table, two faces: a batch DataFrame and a streaming DataFrame over the same Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Batch face of `<root>/<name>.parquet`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def stream_table(spark: SparkSession, root: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming face of `<root>/<name>.parquet`, a file or a folder of files.

    The file source wants a folder, so a single file is read from its parent through a name filter.
    """
    path = f"{root}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def replay_files(df: DataFrame, order: str, parts: int) -> str:
    """Writes the rows as `parts` files in arrival order and returns their folder. Read as a stream with one file for each
    batch, they arrive in that order: files are written one after the other, and the file source goes by their age."""
    folder = shared_dir(df.sparkSession, "replay")
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = -(-((high or 0) - (low or 0) + 1) // parts)
    for k in range(parts):
        begin = (low or 0) + k * step
        df.filter((F.col(order) >= begin) & (F.col(order) < begin + step)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def with_cents(events: DataFrame) -> DataFrame:
    """Adds `c`, the value in integer cents, so that sums do not depend on their order."""
    return events.withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
