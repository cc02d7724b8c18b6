"""Small keyed tables: settings, dead addresses, storage locations, digests of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.ids import dense_ids


def put(df: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the rows of ``new`` in place of those with the same keys; of rows of ``new`` with one key the greatest counts.

    Keys compare with nulls alike. An empty ``new`` changes nothing.
    """
    rest = [c for c in df.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_n")) if rest else new.select(*keys).distinct()
    last = last.select(*keys, "_n.*") if rest else last
    same = [df[k].eqNullSafe(last[k]) for k in keys]
    return df.join(last, same, "left_anti").unionByName(last.select(df.columns))


def get(df: DataFrame, name: str) -> DataFrame:
    """The setting of a name; no row if there is none."""
    return df.filter(F.col("name") == name)


def get_or_create(df: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """``df`` (id, ``name``) with the values that it lacks; new ids follow the greatest in the order of the values."""
    top = df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = values.select(name).filter(F.col(name).isNotNull()).distinct().join(df, name, "left_anti")
    return df.unionByName(dense_ids(fresh, [name], start=top + 1).select(df.columns))


def add_digests(hashes: DataFrame, new: DataFrame) -> DataFrame:
    """Digests (file_id, algorithm, digest) once per file and algorithm; known ones stay, empty ones are none."""
    want = new.filter("digest <> ''").groupBy("file_id", "algorithm").agg(F.min("digest").alias("digest"))
    return hashes.unionByName(want.join(hashes, ["file_id", "algorithm"], "left_anti").select(hashes.columns))


def located(files: DataFrame, storage: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path) of files that lie in some location: the first one by id whose sharded path is listed (location, path)."""
    from tagloom.functions.content import sharded_path

    inner = F.regexp_replace(sharded_path(F.lit(""), F.col("hash"), F.col("extension")), "^/", "")
    want = files.filter("hash is not null").select("id", inner.alias("path")).filter("path is not null")
    at = listing.join(storage.select(F.col("id").alias("storage_id"), "location"), "location")
    return want.join(at, "path").groupBy("id").agg(F.min(F.struct("storage_id", F.concat_ws("/", "location", "path").alias("path"))).alias("m")).select("id", "m.path")


def without_digests(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files (id) that have no digest yet."""
    return files.join(hashes.select(F.col("file_id").alias("id")), "id", "left_anti").select("id").distinct()


def without_size(files: DataFrame) -> DataFrame:
    """Files (id) whose contents are there but whose size isn't known."""
    return files.filter("size_bytes is null and hash is not null").select("id").distinct()


def to_download(urls: DataFrame, dead: DataFrame) -> DataFrame:
    """Addresses (url) that aren't known to be dead, each once."""
    return urls.select("url").filter("url is not null").distinct().join(dead, "url", "left_anti")
