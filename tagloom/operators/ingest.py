"""Changes to the tag graph, each from whole tables to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.catalog import TagCatalog
from tagloom.operators.ids import dense_ids
from tagloom.util import cut

#: Namespaces that a Set action never touches.
SET_SPARES = ("source_url", "")


def _top(df: DataFrame, col: str = "id") -> int:
    return df.agg(F.coalesce(F.max(col), F.lit(0))).first()[0]


def upsert_namespaces(namespace: DataFrame, new: DataFrame) -> DataFrame:
    """``namespace`` with those of ``new`` (name, description): ids stay, the greatest description given wins, null gives none."""
    want = new.filter("name is not null").groupBy("name").agg(F.max("description").alias("_d"))
    kept = namespace.join(want, "name", "left").select("id", "name", F.coalesce("_d", "description").alias("description"))
    fresh = want.join(namespace, "name", "left_anti").select("name", F.col("_d").alias("description"))
    return kept.unionByName(dense_ids(fresh, ["name"], start=_top(namespace) + 1).select("id", "name", "description"))


def flatten_tags(actions: DataFrame) -> DataFrame:
    """(name, ns, ns_desc) of all tags in actions, those they relate to and their scopes included; empty names and special tags are none."""
    t = actions.select(F.explode("tags").alias("t")).filter("t.tag_type in ('Normal', 'NormalNoRegex')")
    empty = F.lit(None).cast("string")
    one = lambda n, ns, d: F.struct(F.col(n).alias("name"), F.col(ns).alias("ns"), d.alias("ns_desc"))
    rows = t.select(F.inline(F.array(one("t.name", "t.ns", F.col("t.ns_desc")), one("t.relates_to.name", "t.relates_to.ns", empty), one("t.relates_to.limit_name", "t.relates_to.limit_ns", empty))))
    return rows.filter("name is not null and name <> '' and ns is not null").groupBy("name", "ns").agg(F.max("ns_desc").alias("ns_desc"))


def add_tags(c: TagCatalog, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(namespace, tags, parents) with all that ``actions`` mention: old ids stay, new ones follow in the order of namespace and name."""
    flat = cut(flatten_tags(actions))
    namespace = cut(upsert_namespaces(c.namespace, flat.select(F.col("ns").alias("name"), F.col("ns_desc").alias("description"))))
    keyed = flat.join(namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns")), "ns").select("name", "namespace")
    fresh = keyed.join(c.tags, ["name", "namespace"], "left_anti")
    added = dense_ids(fresh, ["namespace", "name"], start=_top(c.tags) + 1)
    tags = cut(c.tags.unionByName(added.select("id", "name", "namespace", F.lit(0).cast("long").alias("count"))))
    ids = tags.join(namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns")), "namespace").select("id", "name", "ns")
    t = actions.select(F.explode("tags").alias("t")).filter("t.tag_type in ('Normal', 'NormalNoRegex') and t.relates_to.name <> ''").select(F.col("t.name").alias("n"), F.col("t.ns").alias("s"), F.col("t.relates_to.name").alias("rn"), F.col("t.relates_to.ns").alias("rs"), F.col("t.relates_to.limit_name").alias("ln"), F.col("t.relates_to.limit_ns").alias("ls"))
    edges = t.join(ids.toDF("tag_id", "n", "s"), ["n", "s"]).join(ids.toDF("relate_tag_id", "rn", "rs"), ["rn", "rs"]).join(ids.toDF("limit_to", "ln", "ls"), ["ln", "ls"], "left")
    return namespace, tags, add_parents(c.parents, edges.select("tag_id", "relate_tag_id", "limit_to"))


def add_parents(parents: DataFrame, new: DataFrame) -> DataFrame:
    """Edges once each, where no scope equals no scope; a tag is never its own parent."""
    return parents.unionByName(new.filter("tag_id <> relate_tag_id")).dropDuplicates(["tag_id", "relate_tag_id", "limit_to"])


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """``files`` with ``new`` (hash, extension, storage_id, size_bytes): a known hash keeps id and size and takes the rest."""
    want = new.filter("hash is not null and extension is not null").groupBy("hash").agg(F.max(F.struct("extension", "storage_id", "size_bytes")).alias("_n"))
    kept = files.join(want, "hash", "left").select("id", "hash", F.coalesce("_n.extension", "extension").alias("extension"), F.coalesce("_n.storage_id", "storage_id").alias("storage_id"), "size_bytes")
    fresh = want.join(files, "hash", "left_anti").select("hash", "_n.*")
    return kept.unionByName(dense_ids(fresh, ["hash"], start=_top(files) + 1).select("id", "hash", "extension", "storage_id", "size_bytes"))


def update_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``files`` with hash, extension and storage_id as in ``changes`` (id, hash, extension, storage_id), nulls included.

    Of several changes of a file the greatest counts; changes of unknown files do nothing.
    """
    want = changes.filter("id is not null").groupBy("id").agg(F.max(F.struct("hash", "extension", "storage_id")).alias("_n"))
    take = lambda col: F.when(F.col("_n").isNotNull(), F.col(f"_n.{col}")).otherwise(F.col(col)).alias(col)
    return files.join(want, "id", "left").select("id", take("hash"), take("extension"), take("storage_id"), "size_bytes")


def add_edges(c: TagCatalog, new: DataFrame) -> DataFrame:
    """``rel`` with ``new`` (file_id, tag_id); edges to unknown tags are dropped, known ones stay single.

    Edges that are there are only looked at by those that are new, within their namespaces; they are never sorted out again.
    """
    known = new.select("file_id", "tag_id").join(c.tags.select(F.col("id").alias("tag_id"), "namespace"), "tag_id").select("file_id", "tag_id", "namespace").distinct()
    return c.rel.select("file_id", "tag_id", "namespace").unionByName(known.join(c.rel, ["file_id", "tag_id", "namespace"], "left_anti"))


def drop_edges(rel: DataFrame, gone: DataFrame) -> DataFrame:
    return rel.join(gone.select("file_id", "tag_id").distinct(), ["file_id", "tag_id"], "left_anti")


def drop_tags(c: TagCatalog, tags: DataFrame) -> TagCatalog:
    """Without these tags (id): their edges and parent edges go too, scopes by them become none."""
    gone = tags.select("id").distinct()
    out = TagCatalog(**c.__dict__)
    out.tags = c.tags.join(gone, "id", "left_anti")
    out.rel = c.rel.join(gone.withColumnRenamed("id", "tag_id"), "tag_id", "left_anti").select(c.rel.columns)
    left = c.parents.join(gone.withColumnRenamed("id", "tag_id"), "tag_id", "left_anti").join(gone.withColumnRenamed("id", "relate_tag_id"), "relate_tag_id", "left_anti")
    scoped = left.join(gone.select(F.col("id").alias("limit_to"), F.lit(True).alias("_gone")), "limit_to", "left")
    out.parents = scoped.withColumn("limit_to", F.when(F.col("_gone").isNull(), F.col("limit_to"))).select("tag_id", "relate_tag_id", "limit_to").distinct()
    return out


def drop_namespace(c: TagCatalog, ns: int) -> TagCatalog:
    out = drop_tags(c, c.tags.filter(F.col("namespace") == ns))
    out.namespace = c.namespace.filter(F.col("id") != ns)
    out.rel = out.rel.filter(F.col("namespace") != ns)
    return out


def named_tags(c: TagCatalog, actions: DataFrame) -> DataFrame:
    """(file_id, operation, tag_id, namespace, ns) of the tags that ``actions`` name and that exist."""
    ns = c.namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns"))
    t = actions.select("file_id", "operation", F.explode("tags").alias("t")).filter("t.tag_type in ('Normal', 'NormalNoRegex')").select("file_id", "operation", F.col("t.name").alias("name"), F.col("t.ns").alias("ns"))
    tags = c.tags.select(F.col("id").alias("tag_id"), "name", "namespace")
    return t.join(ns, "ns").join(tags, ["name", "namespace"]).select("file_id", "operation", "tag_id", "namespace", "ns").distinct()


def apply_actions(c: TagCatalog, actions: DataFrame, all_namespaces: bool = True) -> DataFrame:
    """``rel`` after ``actions`` (file_id, operation, tags), whose tags exist.

    Add adds edges, Del removes them. Set makes the tags of each namespace it mentions the file's only ones there, but for
    edges that are added in the same batch; it leaves SET_SPARES alone. What is both removed and added is removed.

    Only the namespaces that the actions mention are read for it, looked at and sorted out; the edges of the others are put
    beside as they are, or left out without ``all_namespaces``, for ``TagCatalog.replace_namespaces``.
    """
    t = cut(named_tags(c, actions))
    touched = [r.namespace for r in t.select("namespace").distinct().collect()]
    here = F.col("namespace").isin(touched)
    edge = ["file_id", "tag_id", "namespace"]
    added = t.filter("operation = 'Add'").select(edge)
    sets = t.filter(F.col("operation").isin("Set") & ~F.col("ns").isin(*SET_SPARES)).select(edge)
    removed = t.filter("operation = 'Del'").select("file_id", "tag_id")
    scope = sets.select("file_id", "namespace").distinct()
    old = c.rel.filter(here).select(edge)
    replaced = old.join(scope, ["file_id", "namespace"], "left_semi").join(sets, ["file_id", "tag_id"], "left_anti").join(added, ["file_id", "tag_id"], "left_anti").select("file_id", "tag_id")
    changed = drop_edges(old.unionByName(added).unionByName(sets).dropDuplicates(["file_id", "tag_id"]), removed.unionByName(replaced))
    return changed.unionByName(c.rel.filter(~here).select(edge)) if all_namespaces else changed


def merge(into: TagCatalog, other: TagCatalog) -> TagCatalog:
    """One graph out of two: namespaces meet by name, tags by name and namespace, files by hash; ids of ``into`` stay."""
    out = TagCatalog(**into.__dict__)
    out.namespace = cut(upsert_namespaces(into.namespace, other.namespace.select("name", "description")))
    ns_map = other.namespace.select(F.col("id").alias("_ns"), "name").join(out.namespace.select(F.col("id").alias("namespace"), "name"), "name").select("_ns", "namespace")
    theirs = cut(other.tags.filter("name is not null").select(F.col("id").alias("_old"), "name", F.col("namespace").alias("_ns")).join(ns_map, "_ns").select("_old", "name", "namespace"))
    fresh = dense_ids(theirs.select("name", "namespace").distinct().join(into.tags, ["name", "namespace"], "left_anti"), ["namespace", "name"], start=_top(into.tags) + 1)
    all_tags = cut(into.tags.select("id", "name", "namespace").unionByName(fresh.select("id", "name", "namespace")))
    tag_map = cut(theirs.join(all_tags, ["name", "namespace"]).select("_old", F.col("id").alias("_new"), "namespace"))
    out.files = cut(upsert_files(into.files, other.files))
    file_map = cut(other.files.select(F.col("id").alias("_oldf"), "hash").join(out.files.select(F.col("id").alias("_newf"), "hash"), "hash").select("_oldf", "_newf"))
    moved = other.rel.select(F.col("file_id").alias("_oldf"), F.col("tag_id").alias("_old")).join(file_map, "_oldf").join(tag_map, "_old")
    out.rel = cut(into.rel.select("file_id", "tag_id", "namespace").unionByName(moved.select(F.col("_newf").alias("file_id"), F.col("_new").alias("tag_id"), "namespace")).dropDuplicates(["file_id", "tag_id"]))
    counts = out.rel.groupBy("tag_id").agg(F.count(F.lit(1)).alias("count"))
    out.tags = all_tags.join(counts, all_tags.id == counts.tag_id, "left").select("id", "name", "namespace", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    m = tag_map.select("_old", "_new")
    p = other.parents.join(m.toDF("tag_id", "_t"), "tag_id").join(m.toDF("relate_tag_id", "_r"), "relate_tag_id").join(m.toDF("limit_to", "_l"), "limit_to", "left")
    out.parents = add_parents(into.parents, p.select(F.col("_t").alias("tag_id"), F.col("_r").alias("relate_tag_id"), F.col("_l").alias("limit_to")))
    hashes = other.file_hashes.join(file_map, other.file_hashes.file_id == file_map._oldf).select(F.col("_newf").alias("file_id"), "algorithm", "digest")
    out.file_hashes = into.file_hashes.unionByName(hashes).dropDuplicates(["file_id", "algorithm"])
    return out


def put_tags(c: TagCatalog, actions: DataFrame) -> DataFrame:
    """``rel`` with every tag that ``actions`` name, those they relate to and their scopes linked to the file; the operation doesn't matter."""
    t = actions.select("file_id", F.explode("tags").alias("t")).filter("t.tag_type in ('Normal', 'NormalNoRegex')")
    pair = lambda n, s: F.struct(F.col(n).alias("name"), F.col(s).alias("ns"))
    named = t.select("file_id", F.inline(F.array(pair("t.name", "t.ns"), pair("t.relates_to.name", "t.relates_to.ns"), pair("t.relates_to.limit_name", "t.relates_to.limit_ns"))))
    ids = c.tags.select(F.col("id").alias("tag_id"), "name", "namespace").join(c.namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns")), "namespace").select("tag_id", "name", "ns")
    return add_edges(c, named.join(ids, ["name", "ns"]).select("file_id", "tag_id").distinct())


def exact_counts(tags: DataFrame, rel: DataFrame) -> DataFrame:
    """``tags`` with ``count`` as the number of distinct files."""
    n = rel.groupBy("tag_id", "file_id").agg(F.lit(1)).groupBy("tag_id").agg(F.count(F.lit(1)).alias("_n"))
    return tags.join(n, tags.id == n.tag_id, "left").select("id", "name", "namespace", F.coalesce("_n", F.lit(0)).cast("long").alias("count"))
