"""Ids for new rows, and pages of ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.util import cut


def dense_ids(df: DataFrame, order: Sequence[str], start: int = 1, name: str = "id") -> DataFrame:
    """``df`` with ids start, start + 1 ... in the order of ``order``, whose values must tell all rows apart.

    Rows are sorted by range and numbered within each range; what a range begins with is the sum of the sizes before it,
    one number for each range. So no task sees all rows, and the ids are the same in every run. Nulls come first.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_i", number).join(base, "_p").withColumn(name, (F.col("_base") + F.col("_i") + (start - 1)).cast("long")).drop("_p", "_i", "_base")


def page_after(df: DataFrame, keys: Sequence[str], last: Sequence, limit: int) -> DataFrame:
    """The next ``limit`` rows by ``keys`` after the row whose keys are ``last``; from the first if ``last`` is empty."""
    if last:
        later: Column = F.lit(False)
        same: Column = F.lit(True)
        for k, v in zip(keys, last, strict=True):
            later = later | (same & (F.col(k) > F.lit(v)))
            same = same & (F.col(k) == F.lit(v))
        df = df.filter(later)
    return df.orderBy(*keys).limit(limit)


def page_at(df: DataFrame, keys: Sequence[str], offset: int, limit: int) -> DataFrame:
    """``limit`` rows by ``keys`` from the ``offset``-th on."""
    return df.orderBy(*keys).offset(offset).limit(limit)


def in_lists(df: DataFrame, name: str, size: int) -> DataFrame:
    """(chunk, ids): the values of ``name`` in order, ``size`` of them in each list, as text with commas."""
    numbered = dense_ids(df.select(name), [name], start=0, name="_nth")
    return numbered.groupBy(F.floor(F.col("_nth") / size).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list(name)).cast("array<string>"), ",").alias("ids"))


def pages(jobs: DataFrame, first: Column, last: Column, step: int = 1, name: str = "page") -> DataFrame:
    """``jobs`` fanned out: a row for each number from ``first`` to ``last``."""
    return jobs.select("*", F.explode(F.sequence(first, last, F.lit(step))).alias(name))
