"""Edges and addresses that arrive as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_urls(urls: DataFrame, url: str = "url", at: str = "at", within: str = "1 hour") -> DataFrame:
    """Each address once, as long as its repeats come ``within`` the time; what is later than that is dropped with its state."""
    return urls.filter(F.col(url).isNotNull()).withWatermark(at, within).dropDuplicatesWithinWatermark([url])


def activity(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; a window is put out once ``late`` has passed after it."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def edges_to_table(edges: DataFrame, path: str, checkpoint: str, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Append edges (file_id, tag_id, namespace) that aren't in the table at ``path`` yet, batch by batch.

    The table lies in buckets by file, and a batch looks at those of its own files alone. What a batch adds to a bucket is a
    folder of the batch's number, so one that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter("file_id is not null and tag_id is not null").dropDuplicates(["file_id", "tag_id"])
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            fresh = fresh.persist()
            touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
            shape = "file_id long, tag_id long, namespace long, bucket int, batch long"
            have = spark.read.schema(shape).parquet(path).filter(F.col("bucket").isin(touched) & (F.col("batch") != number))
            fresh = fresh.join(have.select("bucket", "file_id", "tag_id"), ["bucket", "file_id", "tag_id"], "left_anti")
        rows = fresh.select("file_id", "tag_id", "namespace", "bucket", F.lit(number).cast("long").alias("batch")).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        fresh.unpersist()

    writer = edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
