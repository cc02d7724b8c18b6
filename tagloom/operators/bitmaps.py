"""Sets of ids as bitmaps, one for each bucket of 32,768 ids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def _without(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x if y is None else (np.frombuffer(x, "uint8") & ~np.frombuffer(y, "uint8")).tobytes() for x, y in zip(a, b)])


def to_bitmaps(rel: DataFrame, key: str = "tag_id", member: str = "file_id") -> DataFrame:
    """(``key``, bucket, bitmap): the members of each key. Negative ids aren't supported; nulls are left out."""
    rows = rel.select(F.col(key), F.col(member).alias("_m")).filter(F.col(key).isNotNull() & F.col("_m").isNotNull())
    return rows.groupBy(key, F.bitmap_bucket_number("_m").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_m")).alias("bitmap"))


def add_members(bitmaps: DataFrame, rel: DataFrame, key: str = "tag_id", member: str = "file_id") -> DataFrame:
    """``bitmaps`` with the members in ``rel`` too; only the new ones are made into bitmaps."""
    both = bitmaps.select(key, "bucket", "bitmap").unionByName(to_bitmaps(rel, key, member))
    return both.groupBy(key, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def remove_members(bitmaps: DataFrame, rel: DataFrame, key: str = "tag_id", member: str = "file_id") -> DataFrame:
    """``bitmaps`` without the members in ``rel``; a bucket that is left empty goes."""
    gone = to_bitmaps(rel, key, member).select(key, "bucket", F.col("bitmap").alias("_gone"))
    left = bitmaps.join(gone, [key, "bucket"], "left").select(key, "bucket", _without("bitmap", "_gone").alias("bitmap"))
    return left.filter(F.bitmap_count("bitmap") > 0)


def cardinality(bitmaps: DataFrame, key: str = "tag_id") -> DataFrame:
    return bitmaps.groupBy(key).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def union_count(bitmaps: DataFrame, keys: Sequence[int], key: str = "tag_id") -> DataFrame:
    """How many members at least one of ``keys`` has: (n)."""
    per_bucket = bitmaps.filter(F.col(key).isin(list(keys))).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("b"))
    return per_bucket.agg(F.coalesce(F.sum(F.bitmap_count("b")), F.lit(0)).alias("n"))


def intersection_count(bitmaps: DataFrame, keys: Sequence[int], key: str = "tag_id") -> DataFrame:
    """How many members all of ``keys`` have: (n). A bucket that one key lacks adds nothing."""
    want = len(set(keys))
    per_bucket = bitmaps.filter(F.col(key).isin(list(keys))).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("b"), F.count_distinct(key).alias("k"))
    return per_bucket.filter(F.col("k") == want).agg(F.coalesce(F.sum(F.bitmap_count("b")), F.lit(0)).alias("n"))


def difference_count(bitmaps: DataFrame, keep: int, drop: int, key: str = "tag_id") -> DataFrame:
    """How many members of ``keep`` aren't in ``drop``: (n)."""
    size = lambda k: F.sum(F.when(F.col(key) == k, F.bitmap_count("bitmap")).otherwise(0))
    per_bucket = bitmaps.filter(F.col(key).isin(keep, drop)).groupBy("bucket").agg(size(keep).alias("a"), F.bitmap_and_agg("bitmap").alias("b"), F.count_distinct(key).alias("k"))
    return per_bucket.agg(F.coalesce(F.sum(F.col("a") - F.when(F.col("k") == 2, F.bitmap_count("b")).otherwise(0)), F.lit(0)).alias("n"))
