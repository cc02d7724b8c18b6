"""Parents and children of tags."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.catalog import TagCatalog
from tagloom.operators.lookup import _ids
from tagloom.util import cut


def parents_of(c: TagCatalog, tags: DataFrame | Sequence[int]) -> DataFrame:
    return c.parents.join(_ids(c.parents, tags, "tag_id"), "tag_id", "left_semi")


def children_of(c: TagCatalog, tags: DataFrame | Sequence[int]) -> DataFrame:
    return c.parents.join(_ids(c.parents, tags, "relate_tag_id"), "relate_tag_id", "left_semi").select("tag_id", "relate_tag_id", "limit_to")


def one_parent(c: TagCatalog, tag: int, parent: int) -> DataFrame:
    """The edge between two tags; of several scopes the unlimited one, then the least."""
    return c.parents.filter((F.col("tag_id") == tag) & (F.col("relate_tag_id") == parent)).orderBy(F.asc_nulls_first("limit_to")).limit(1)


def files_with_parents(c: TagCatalog, tag: int) -> DataFrame:
    """Files with a tag or any of its parents."""
    own = c.parents.sparkSession.createDataFrame([(tag,)], "tag_id long")
    ids = own.unionByName(c.parents.filter(F.col("tag_id") == tag).select(F.col("relate_tag_id").alias("tag_id")))
    return c.rel.join(ids, "tag_id", "left_semi").select("file_id").distinct()


def structure_exists(c: TagCatalog, tag: int, parent: int, limit_to: int | None) -> DataFrame:
    """(found): is there this edge with exactly this scope, where no scope is one too?"""
    hit = c.parents.filter((F.col("tag_id") == tag) & (F.col("relate_tag_id") == parent) & F.col("limit_to").eqNullSafe(F.lit(limit_to)))
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))


def scope_exists(c: TagCatalog, parent: int, limit_to: int) -> DataFrame:
    hit = c.parents.filter((F.col("relate_tag_id") == parent) & (F.col("limit_to") == limit_to))
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """All (``child``, ancestor, depth), depth the least number of steps; cycles end where they began.

    A round joins only what the last one added, and drops what is known already, so the rounds end by themselves.
    """
    step = cut(edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).filter("_c is not null and _p is not null").distinct())
    known = step.select("_c", F.col("_p").alias("_a"), F.lit(1).alias("_d"))
    fresh = known
    for depth in count(2):
        grown = fresh.select("_c", F.col("_a").alias("_m")).join(step.select(F.col("_c").alias("_m"), F.col("_p").alias("_a")), "_m").select("_c", "_a").distinct()
        fresh = cut(grown.join(known, ["_c", "_a"], "left_anti").select("_c", "_a", F.lit(depth).alias("_d")))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    return known.select(F.col("_c").alias(child), F.col("_a").alias("ancestor"), F.col("_d").alias("depth"))
