"""Trees of folders and files as tables of nodes: (handle, parent, kind, name), kind `file`, `folder` or `root`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.hierarchy import closure
from tagloom.util import cut


def files_below(nodes: DataFrame, handles: DataFrame) -> DataFrame:
    """(top, handle) of all files under each of ``handles`` (handle), through folders and roots only; a file is under itself."""
    inner = nodes.filter(F.col("kind").isin("folder", "root")).select(F.col("handle").alias("parent"))
    links = nodes.join(inner, "parent", "left_semi").select("handle", "parent")
    under = closure(links, "handle", "parent").select(F.col("ancestor").alias("top"), "handle")
    files = nodes.filter("kind = 'file'").select("handle")
    own = files.select(F.col("handle").alias("top"), "handle")
    return own.unionByName(under.join(files, "handle", "left_semi").select("top", "handle")).join(handles.select(F.col("handle").alias("top")).distinct(), "top", "left_semi").distinct()


def paths(nodes: DataFrame) -> DataFrame:
    """(handle, path): names from the top down, joined by slashes.

    A node whose parent isn't in the table is a top. A round reaches one level more, by a join with that level alone;
    nodes on a cycle have no path.
    """
    named = nodes.select("handle", "parent", "name")
    tops = named.join(nodes.select(F.col("handle").alias("parent")), "parent", "left_anti").select("handle", F.col("name").alias("path"))
    level = cut(tops)
    done = level
    while not level.isEmpty():
        level = cut(named.join(level.toDF("parent", "_path"), "parent").select("handle", F.concat_ws("/", "_path", "name").alias("path")))
        done = done.unionByName(level)
    return done


def metadata_tags(nodes: DataFrame, snapshot: str) -> DataFrame:
    """(handle, ns, name) of what is known about each file: its name, size, path, times and parent, and the snapshot they are of.

    ``nodes`` has (handle, parent, kind, name, size, created, modified), times in epoch seconds; what is null gives no row.
    """
    rows = nodes.filter("kind = 'file'").join(paths(nodes), "handle")
    one = lambda ns, c: F.struct(F.lit(ns).alias("ns"), c.cast("string").alias("name"))
    every = F.array(
        one("handle", F.col("handle")), one("name", F.col("name")), one("size", F.col("size")), one("path", F.col("path")), one("snapshot", F.lit(snapshot)),
        one("created", F.col("created")), one("modified", F.col("modified")), one("parent", F.col("parent")),
    )
    return rows.select("handle", F.inline(every)).filter("name is not null")
