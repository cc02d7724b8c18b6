"""Look-ups in the tag graph, for one id and for many at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.catalog import TagCatalog


def _ids(df: DataFrame, ids: DataFrame | Sequence[int], name: str) -> DataFrame:
    """The ids asked for, once each, as a table."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("long").alias(name)).filter(f"{name} is not null").distinct()
    return df.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], f"{name} long")


def namespace_id(c: TagCatalog, name: str) -> DataFrame:
    return c.namespace.filter(F.col("name") == name).select("id")


def tags_in_namespace(c: TagCatalog, ns: int) -> DataFrame:
    return c.tags.filter(F.col("namespace") == ns).select("id")


def files_in_namespace(c: TagCatalog, ns: int) -> DataFrame:
    """Files with any tag of a namespace; only its folder of edges is read."""
    return c.rel.filter(F.col("namespace") == ns).select("file_id").distinct()


def tags_filtered(c: TagCatalog, file_id: int, ns: int) -> DataFrame:
    return c.rel.filter((F.col("namespace") == ns) & (F.col("file_id") == file_id)).select("tag_id").distinct()


def tags_of_files(c: TagCatalog, files: DataFrame | Sequence[int]) -> DataFrame:
    """(file_id, tag_ids sorted): every file asked for, without tags an empty array."""
    want = _ids(c.rel, files, "file_id")
    sets = c.rel.join(want, "file_id", "left_semi").groupBy("file_id").agg(F.sort_array(F.collect_set("tag_id")).alias("tag_ids"))
    return want.join(sets, "file_id", "left").withColumn("tag_ids", F.coalesce("tag_ids", F.array().cast("array<long>")))


def files_of_tags(c: TagCatalog, tags: DataFrame | Sequence[int]) -> DataFrame:
    """(tag_id, file_id) rows of the tags asked for; a popular tag's files stay rows and are never gathered."""
    return c.rel.join(_ids(c.rel, tags, "tag_id"), "tag_id", "left_semi").select("tag_id", "file_id").distinct()


def tag_objects(c: TagCatalog, tags: DataFrame | Sequence[int]) -> DataFrame:
    """(id, name, ns, description) of the tags that exist."""
    ns = c.namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns"), "description")
    return c.tags.join(_ids(c.tags, tags, "id"), "id", "left_semi").join(ns, "namespace").select("id", "name", "ns", "description")


def file_tag_objects(c: TagCatalog, files: DataFrame | Sequence[int]) -> DataFrame:
    """(file_id, tag_id, name, ns) of the files asked for."""
    edges = c.rel.join(_ids(c.rel, files, "file_id"), "file_id", "left_semi").select("file_id", "tag_id").distinct()
    ns = c.namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns"))
    return edges.join(c.tags.select(F.col("id").alias("tag_id"), "name", "namespace"), "tag_id").join(ns, "namespace").select("file_id", "tag_id", "name", "ns")


def first_file_of_tag(c: TagCatalog, name: str, ns: str) -> DataFrame:
    """The file with the least id that bears a tag; no row if none does."""
    tag = c.tags.filter(F.col("name") == name).join(c.namespace.filter(F.col("name") == ns).select(F.col("id").alias("namespace")), "namespace").select(F.col("id").alias("tag_id"))
    least = c.rel.join(tag, "tag_id", "left_semi").agg(F.min("file_id").alias("id"))
    return c.files.join(least, "id", "left_semi")


def least_file_per_tag(c: TagCatalog) -> DataFrame:
    return c.rel.groupBy("tag_id").agg(F.min("file_id").alias("file_id"))


def untagged_files(c: TagCatalog) -> DataFrame:
    return c.files.join(c.rel.select(F.col("file_id").alias("id")), "id", "left_anti").select("id")


def dead_urls(c: TagCatalog, urls: DataFrame) -> DataFrame:
    """(url, dead) for every url asked for."""
    asked = urls.select(F.col(urls.columns[0]).alias("url")).filter("url is not null").distinct()
    return asked.join(c.dead_urls.distinct().withColumn("_d", F.lit(True)), "url", "left").select("url", F.col("_d").isNotNull().alias("dead"))


def by_hash(c: TagCatalog, algorithm: str, digests: Sequence[str]) -> DataFrame:
    return c.file_hashes.filter((F.col("algorithm") == algorithm) & F.col("digest").isin(list(digests))).select("digest", "file_id")
