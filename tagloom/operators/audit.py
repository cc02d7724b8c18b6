"""What changed between two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(``keys``, action): create, delete, or update where any of ``values`` differs; null equals null. Keys are unique."""
    a = old.select(*keys, F.struct(*[F.col(v) for v in values], F.lit(1).alias("_")).alias("_a"))
    b = new.select(*keys, F.struct(*[F.col(v) for v in values], F.lit(1).alias("_")).alias("_b"))
    both = a.join(b, list(keys), "full")
    action = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return both.withColumn("action", action).filter("action is not null").select(*keys, "action")


def backfill(files: DataFrame, tags: DataFrame, rel: DataFrame, now: int) -> DataFrame:
    """One `create` row for every file, tag and edge there is: (changed_at, entity_type, action, file_id, tag_id)."""
    none = F.lit(None).cast("long")
    row = lambda df, kind, f, t: df.select(F.lit(now).cast("long").alias("changed_at"), F.lit(kind).alias("entity_type"), F.lit("create").alias("action"), f.alias("file_id"), t.alias("tag_id"))
    return row(files, "file", F.col("id"), none).unionByName(row(tags, "tag", none, F.col("id"))).unionByName(row(rel, "relationship", F.col("file_id"), F.col("tag_id")))


def entries(audit: DataFrame, file_id: int | None = None, tag_id: int | None = None) -> DataFrame:
    """Rows about a file or a tag, or both where both are given."""
    if file_id is not None:
        audit = audit.filter(F.col("file_id") == file_id)
    return audit if tag_id is None else audit.filter(F.col("tag_id") == tag_id)
