"""A tag graph read from the retail star schema: parts' attributes are tags, orders are files, lines are edges."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.catalog import TagCatalog
from tagloom.operators.ids import dense_ids
from tagloom.util import cut, shared_folder, table

_kept: dict[tuple[str, str], TagCatalog] = {}


def _build(spark: SparkSession, d: str) -> TagCatalog:
    """The graph without the tags' counts, which come from the edges once they are written."""
    part, lines, orders, events = (table(spark, d, t) for t in ("part", "lineitem", "orders", "events"))
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    pair = lambda ns, c: F.struct(F.lit(ns).alias("ns"), c.cast("string").alias("name"))
    linked = part.select("p_partkey", F.inline(F.array(pair("brand", F.col("p_brand")), pair("name", F.col("p_name")), pair("size", F.col("p_size")), pair("type", F.col("p_type")))))
    structural = part.select(F.inline(F.array(pair("color", word(1)), pair("noun", word(2)))))
    every = linked.select("ns", "name").unionByName(structural).filter("name is not null").distinct()
    namespace = dense_ids(every.select("ns").distinct(), ["ns"]).select("id", F.col("ns").alias("name"), F.lit(None).cast("string").alias("description"))
    tag0 = cut(dense_ids(every, ["ns", "name"]).join(namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns")), "ns"))
    on_part = linked.join(tag0, ["ns", "name"]).select("p_partkey", F.col("id").alias("tag_id"), "namespace")
    rel = lines.select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("p_partkey")).join(on_part, "p_partkey").select("file_id", "tag_id", "namespace").distinct()
    tags = tag0.select("id", "name", "namespace", F.lit(None).cast("long").alias("count"))
    named = lambda ns, col, out: tag0.filter(F.col("ns") == ns).select(F.col("name").alias(col), F.col("id").alias(out))
    owned = part.join(named("name", "p_name", "tag_id"), "p_name")
    scoped = owned.join(named("brand", "p_brand", "relate_tag_id"), "p_brand").join(named("type", "p_type", "limit_to"), "p_type").select("tag_id", "relate_tag_id", "limit_to")
    free = owned.withColumn("color", word(1)).join(named("color", "color", "relate_tag_id"), "color").select("tag_id", "relate_tag_id", F.lit(None).cast("long").alias("limit_to"))
    key = F.col("o_orderkey").cast("string")
    files = orders.select(F.col("o_orderkey").alias("id"), F.upper(F.md5(key)).alias("hash"), F.lower("o_orderstatus").alias("extension"), (F.col("o_orderkey") % 3 + 1).alias("storage_id"), F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice")).cast("long").alias("size_bytes"))
    digest = lambda name, c: F.struct(F.lit(name).alias("algorithm"), c.alias("digest"))
    hashed = orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("file_id"), F.inline(F.array(digest("MD5", F.md5(key)), digest("SHA1", F.upper(F.sha1(key))), digest("SHA256", F.upper(F.sha2(key, 256))))))
    k = F.get_json_object("props", "$.k").cast("long")
    jobs = events.select(
        F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("time"), (k * 60).alias("reptime"), F.floor("value").cast("long").alias("priority"), (F.col("event_id") % 7 == 0).alias("is_running"),
        F.when(k % 3 == 0, F.lit('{"kind":"AlwaysTime","interval":3600,"count":2}')).when(k % 3 == 1, F.lit('{"kind":"AlwaysTime","interval":600}')).alias("recreation"), F.col("event_type").alias("site"), F.col("props").alias("param"), F.concat(F.lit('{"user":"'), F.col("user_id"), F.lit('"}')).alias("user_data"),
    )
    dead = table(spark, d, "comment_item").select(F.explode(F.regexp_extract_all("content", F.lit(r"files\.example\.org/p/\d+/\d+"), F.lit(0))).alias("url")).filter("cast(split_part(url, '/', 4) as bigint) % 10 = 0").distinct()
    return TagCatalog(namespace, tags, rel, scoped.unionByName(free).distinct(), files, hashed, jobs, dead)


def catalog(spark: SparkSession, d: str) -> TagCatalog:
    """The graph of folder ``d``: written once a session to the shared folder, then read from there."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _kept:
        mark = hashlib.md5(f"{key}".encode()).hexdigest()
        root = f"{shared_folder(spark)}/graph-{mark}"
        c = _build(spark, d)
        edges = c.write_edges(root, f"edges_{mark}")
        n = edges.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        c.tags = c.tags.join(n, "id", "left").select("id", "name", "namespace", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
        for name in ("namespace", "tags", "parents", "files", "file_hashes", "jobs", "dead_urls"):
            getattr(c, name).write.mode("overwrite").parquet(f"{root}/{name}")
        _kept[key] = TagCatalog.from_parquet(spark, root)
        _kept[key].rel = edges
    return _kept[key]


def shifted(c: TagCatalog, offset: int = 1_000_000) -> TagCatalog:
    """Another graph that shares names and hashes with ``c`` but no id: parts of small size only, all ids moved."""
    small = c.tags.join(c.namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns")), "namespace").filter((F.col("ns") != "size") | (F.try_to_number("name", F.lit("99")) <= 25)).select("id")
    move = lambda col: (F.col(col) + offset).alias(col)
    tags = c.tags.join(small, "id", "left_semi").select(move("id"), "name", move("namespace"), "count")
    rel = c.rel.filter("file_id % 3 = 0").join(small, c.rel.tag_id == small.id, "left_semi").select(move("file_id"), move("tag_id"), move("namespace"))
    parents = c.parents.join(small.withColumnRenamed("id", "tag_id"), "tag_id", "left_semi").join(small.withColumnRenamed("id", "relate_tag_id"), "relate_tag_id", "left_semi").select(move("tag_id"), move("relate_tag_id"), move("limit_to"))
    files = c.files.filter("id % 3 = 0").select(move("id"), "hash", "extension", "storage_id", "size_bytes")
    hashes = c.file_hashes.filter("file_id % 3 = 0").select(move("file_id"), "algorithm", "digest")
    return TagCatalog(c.namespace.select(move("id"), "name", "description"), tags, rel, parents, files, hashes, c.jobs, c.dead_urls)
