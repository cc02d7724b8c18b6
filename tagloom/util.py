"""Helpers that every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where none is named a folder of this machine is set, but only if the executors run on it too.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tagloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut: it is computed once and survives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """As ``cut``, as a table of Parquet: for rows that are many, as it is far smaller, and read by columns."""
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """A file of the shared folder, whatever file system it lies in; returns its address."""
    address = f"{shared_folder(spark)}/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(address)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return address


def ratio(x: float | str | Fraction) -> tuple[int, int]:
    """Numerator and denominator of the decimal a caller wrote, so that thresholds compare in whole numbers."""
    f = x if isinstance(x, Fraction) else Fraction(str(x))
    return f.numerator, f.denominator


def whole(c: Column) -> Column:
    """A count as an exact number wide enough for products of two counts."""
    return c.cast("decimal(38,0)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(c: Column) -> Column:
    """A set column's members: sorted, without nulls and repeats; a null set stays null."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
