"""Where tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def swap_in(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: written beside it first, then renamed, so readers see the old one or the new one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def backup(df: DataFrame, root: str, epoch: int) -> str:
    """A copy under ``root`` in the folder of the day ``epoch`` lies in; returns that folder."""
    day = df.sparkSession.range(1).select(F.date_format(F.timestamp_seconds(F.lit(epoch)), "yyyy/MM/dd")).first()[0]
    df.write.mode("overwrite").parquet(f"{root}/{day}")
    return f"{root}/{day}"
