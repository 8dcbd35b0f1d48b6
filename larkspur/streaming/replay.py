"""A table as a stream: files in the order of a column, as many for each micro-batch as there are tasks at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import temporary


def in_order(rows: DataFrame, order: str, batches: int, folder: str | None = None) -> DataFrame:
    """rows as a stream whose micro-batches are consecutive ranges of a column; nulls come first.

    The ranges' bounds are approximate quantiles, one number a batch; the ranges are written one after another, as a stream's source takes files by age. All have
    the same number of files, empty ones if need be, so that a micro-batch is a range.
    """
    spark = rows.sparkSession
    many = spark.sparkContext.defaultParallelism
    folder = folder or temporary(spark, "stream")
    number = F.unix_micros(F.col(order).cast("timestamp")) if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order)
    bounds = rows.agg(F.percentile_approx(number, [k / batches for k in range(1, batches)], 10_000).alias("b")).first()["b"] or []
    edges = [None, *sorted(set(bounds)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows if low is None else rows.where(number > low)
        part = part if high is None else part.where(number <= high)
        part = part.unionByName(rows.where(number.isNull())) if low is None and high is not None else part
        part.repartition(many).write.mode("append").parquet(folder)
        while _files(spark, folder) % many:
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", many).parquet(folder)


def _files(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sum(s.getPath().getName().startswith("part-") for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def result(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All that a stream gives for what has come by now, written and read again."""
    spark = stream.sparkSession
    folder = folder or temporary(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
