"""Queries on the tag graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagloom.functions import content, extract, posts
from tagloom.operators import audit, bitmaps, hierarchy, ids, ingest, jobs, lookup, policy, search, settings, snapshots, textsearch, trees
from tagloom.operators.ids import page_after, page_at
from tagloom.operators.search import SearchQuery, SearchSpec, search_files
from tagloom.plans.graph_sql import SQL  # noqa: F401
from tagloom.plans.registry import Registry
from tagloom.sources import readers, sinks
from tagloom.sources.retail import catalog, shifted
from tagloom.streaming import ingest as streams
from tagloom.util import members, shared_folder, table, write_shared

#: A moment to ask for due jobs at, and ids the look-ups use.
NOW = 1704067200 + 5 * 86400
FILES = list(range(1, 400, 7))
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tag_ids(c, *names: tuple[str, str]) -> list[int]:
    """Ids of tags by namespace and name, one small look-up for all; -1 where there is none."""
    cond = F.lit(False)
    for ns, name in names:
        cond = cond | ((F.col("ns") == ns) & (F.col("name") == name))
    rows = c.tags.join(c.namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns")), "namespace").filter(cond).select("ns", "name", "id").collect()
    found = {(r.ns, r["name"]): r.id for r in rows}
    return [found.get(n, -1) for n in names]


RED, B2, B17, SMALL = ("name", "red widget"), ("brand", "Brand#2"), ("brand", "Brand#17"), ("type", "SMALL")


@query
def search_and_or_not(spark, d):
    c = catalog(spark, d)
    red, b2, b17, small = tag_ids(c, RED, B2, B17, SMALL)
    return search_files(c.rel, SearchSpec([red], [[b2, b17]], [small]))


@query
def search_and(spark, d):
    c = catalog(spark, d)
    return search_files(c.rel, SearchSpec(tag_ids(c, RED, B2)))


@query
def search_or(spark, d):
    c = catalog(spark, d)
    return search_files(c.rel, SearchSpec(any_of=[tag_ids(c, RED, B17)]))


@query
def search_not_only(spark, d):
    c = catalog(spark, d)
    return search_files(c.rel, SearchSpec(none_of=tag_ids(c, SMALL, B2)))


@query
def search_or_groups2(spark, d):
    c = catalog(spark, d)
    red, b2, b17, small = tag_ids(c, RED, B2, B17, SMALL)
    return search_files(c.rel, SearchSpec(any_of=[[red, small], [b2, b17]]))


@query
def search_limit(spark, d):
    c = catalog(spark, d)
    return search_files(c.rel, SearchSpec(any_of=[tag_ids(c, RED, B2)]), limit=25)


@query
def search_offset_limit(spark, d):
    c = catalog(spark, d)
    return SearchQuery().all_of(*tag_ids(c, B2)).page(10, 20).run(c.rel)


@query
def search_unknown_and(spark, d):
    c = catalog(spark, d)
    return search_files(c.rel, SearchSpec([*tag_ids(c, B2), 10**12]))


@query
def search_unknown_or(spark, d):
    c = catalog(spark, d)
    return search_files(c.rel, SearchSpec(any_of=[[*tag_ids(c, B2), 10**12]]))


@query
def search_many_ids(spark, d):
    """A group of more ids than a filter holds is joined as a table."""
    c = catalog(spark, d)
    (b2,) = tag_ids(c, B2)
    return search_files(c.rel, SearchSpec([b2], [range(1, 1000)]))


@query
def search_by_names(spark, d):
    return search.search_by_groups(catalog(spark, d), and_names=["red widget", "brand2"])


@query
def search_by_name_groups(spark, d):
    """Of the second and third name either will do, as none beside them must: each is a group of its own."""
    return search.search_by_groups(catalog(spark, d), and_names=["widget", "brand1"], not_names=["small"])


@query
def search_project_sets(spark, d):
    """Files whose current set has the two most frequent tags but not the third."""
    sets = snapshots.latest(table(spark, d, "relationship_roaring_fileid"), "fileid", "written_at", "tagid_bitmap")
    rel = sets.select(F.col("fileid").alias("file_id"), F.explode(members(F.col("tagid_bitmap"))).alias("tag_id"))
    top = [r.tag_id for r in rel.groupBy("tag_id").count().orderBy(F.desc("count"), "tag_id").limit(3).collect()]
    return search_files(rel, SearchSpec(top[:2], [], top[2:]))


@query
def current_sets(spark, d):
    """Every file's current set, one row per member."""
    sets = snapshots.latest(table(spark, d, "relationship_roaring_fileid"), "fileid", "written_at", "tagid_bitmap")
    return sets.select("fileid", F.explode(members(F.col("tagid_bitmap"))).alias("tagid"))


@query
def tag_file_sets(spark, d):
    """Every tag's files, gathered over its many rows."""
    rows = table(spark, d, "relationship_roaring_tagid").select("tagid", F.explode("fileid_bitmap").alias("fileid"))
    return rows.filter("tagid is not null and fileid is not null").distinct()


@query
def search_bitmap_and(spark, d):
    c = catalog(spark, d)
    ids = tag_ids(c, RED, B2)
    return bitmaps.intersection_count(bitmaps.to_bitmaps(c.rel.filter(F.col("tag_id").isin(ids))), ids)


@query
def search_bitmap_or(spark, d):
    c = catalog(spark, d)
    ids = tag_ids(c, RED, B2)
    return bitmaps.union_count(bitmaps.to_bitmaps(c.rel.filter(F.col("tag_id").isin(ids))), ids)


@query
def search_bitmap_andnot(spark, d):
    c = catalog(spark, d)
    red, b2 = tag_ids(c, RED, B2)
    return bitmaps.difference_count(bitmaps.to_bitmaps(c.rel.filter(F.col("tag_id").isin([red, b2]))), red, b2)


@query
def bitmap_cardinality(spark, d):
    return bitmaps.cardinality(bitmaps.to_bitmaps(catalog(spark, d).rel))


@query
def rel_tags_of_files_many(spark, d):
    return lookup.tags_of_files(catalog(spark, d), FILES).select("file_id", F.array_join(F.col("tag_ids").cast("array<string>"), ",").alias("tag_ids"))


@query
def rel_tags_of_file(spark, d):
    c = catalog(spark, d)
    return c.rel.filter("file_id = 8").select("tag_id").distinct()


@query
def rel_files_of_tag(spark, d):
    c = catalog(spark, d)
    (b2,) = tag_ids(c, B2)
    return lookup.files_of_tags(c, [b2]).select("file_id")


@query
def rel_files_of_tags_many(spark, d):
    c = catalog(spark, d)
    return lookup.files_of_tags(c, tag_ids(c, RED, B2, SMALL, ("color", "red")))


@query
def namespace_get(spark, d):
    return lookup.namespace_id(catalog(spark, d), "brand")


@query
def files_in_namespace(spark, d):
    c = catalog(spark, d)
    ns = lookup.namespace_id(c, "type").first().id
    return lookup.files_in_namespace(c, ns)


@query
def tags_in_namespace(spark, d):
    c = catalog(spark, d)
    return lookup.tags_in_namespace(c, lookup.namespace_id(c, "brand").first().id)


@query
def tags_filtered(spark, d):
    c = catalog(spark, d)
    return lookup.tags_filtered(c, 8, lookup.namespace_id(c, "size").first().id)


@query
def files_all(spark, d):
    return catalog(spark, d).files.select("id")


@query
def tags_all(spark, d):
    return catalog(spark, d).tags.select("id")


@query
def tag_objects(spark, d):
    return lookup.tag_objects(catalog(spark, d), [1, 2, 3, 50, 60, 10**12])


@query
def file_tags_objects(spark, d):
    return lookup.file_tag_objects(catalog(spark, d), FILES)


@query
def tag_get_file(spark, d):
    return lookup.first_file_of_tag(catalog(spark, d), "Brand#2", "brand")


@query
def min_file_per_tag(spark, d):
    return lookup.least_file_per_tag(catalog(spark, d))


@query
def untagged_files(spark, d):
    return lookup.untagged_files(catalog(spark, d))


@query
def hash_lookup(spark, d):
    import hashlib

    return lookup.by_hash(catalog(spark, d), "MD5", [hashlib.md5(str(i).encode()).hexdigest() for i in (1, 2, 3, 4, 5)])


@query
def dead_url_get(spark, d):
    urls = table(spark, d, "comment_item").select(F.explode(F.regexp_extract_all("content", F.lit(r"files\.example\.org/p/\d+/\d+"), F.lit(0))).alias("url"))
    return lookup.dead_urls(catalog(spark, d), urls)


@query
def parent_rel(spark, d):
    c = catalog(spark, d)
    return hierarchy.parents_of(c, tag_ids(c, RED))


@query
def parent_rel_many(spark, d):
    return hierarchy.parents_of(catalog(spark, d), range(1, 120))


@query
def child_rel(spark, d):
    c = catalog(spark, d)
    return hierarchy.children_of(c, tag_ids(c, B2))


@query
def child_rel_many(spark, d):
    return hierarchy.children_of(catalog(spark, d), range(1, 60))


@query
def parent_one(spark, d):
    c = catalog(spark, d)
    red, b2 = tag_ids(c, RED, B2)
    return hierarchy.one_parent(c, red, b2)


@query
def parent_files(spark, d):
    c = catalog(spark, d)
    return hierarchy.files_with_parents(c, tag_ids(c, RED)[0])


@query
def parent_structure_exists(spark, d):
    c = catalog(spark, d)
    red, color = tag_ids(c, RED, ("color", "red"))
    return hierarchy.structure_exists(c, red, color, None)


@query
def parent_limit_exists(spark, d):
    c = catalog(spark, d)
    b2, small = tag_ids(c, B2, SMALL)
    return hierarchy.scope_exists(c, b2, small)


@query
def parent_closure(spark, d):
    """Steps between tags, by parents and from brands on to their types."""
    c = catalog(spark, d)
    onward = c.parents.filter("limit_to is not null").select(F.col("relate_tag_id").alias("tag_id"), F.col("limit_to").alias("relate_tag_id"))
    return hierarchy.closure(c.parents.select("tag_id", "relate_tag_id").unionByName(onward), "tag_id", "relate_tag_id")


@query
def tag_counts(spark, d):
    c = catalog(spark, d)
    return ingest.exact_counts(c.tags, c.rel).select("id", "count")


@query
def popular_tags(spark, d):
    return textsearch.popular(catalog(spark, d).tags)


@query
def structural_tags(spark, d):
    c = catalog(spark, d)
    return c.tags.join(c.rel.select(F.col("tag_id").alias("id")), "id", "left_anti").select("id", "name")


@query
def tags_topk(spark, d):
    return catalog(spark, d).tags.orderBy(F.desc("count"), "id").limit(20).select("id", "count")


@query
def rarest_first_rank(spark, d):
    return search.rarest_first(catalog(spark, d).tags, range(1, 40))


@query
def tags_keyset_page(spark, d):
    return page_after(catalog(spark, d).tags.select("namespace", "id"), ["namespace", "id"], [2, 30], 25)


@query
def files_offset_page(spark, d):
    return page_at(catalog(spark, d).files.select("id"), ["id"], 100, 50)


def _named_tags(spark, d):
    """The project's tags, one row per id."""
    return table(spark, d, "tags").filter("name is not null").groupBy("id").agg(F.min("name").alias("name"), F.max("count").alias("count"), F.min("namespace_id").alias("namespace"))


@query
def tag_search_prefix(spark, d):
    return textsearch.search_tags(_named_tags(spark, d), "glass", 10)


@query
def tag_search_substring(spark, d):
    return textsearch.search_tags(_named_tags(spark, d), "fountain", 25)


@query
def tag_search_typo(spark, d):
    return textsearch.search_tags(_named_tags(spark, d), "unttiled", 15)


@query
def tag_search_topk(spark, d):
    return textsearch.search_tags(_named_tags(spark, d), "mo", 50)


@query
def tag_search_bigram_candidates(spark, d):
    return textsearch.bigram_candidates(_named_tags(spark, d), "curtain")


@query
def tag_search_fts(spark, d):
    return textsearch.fts_candidates(_named_tags(spark, d), "castle gadren")


@query
def normalize_names(spark, d):
    return table(spark, d, "tags").filter("name is not null").select("name", textsearch.normalized(F.col("name")).alias("normalized")).distinct()


@query
def allowed_distance_cases(spark, d):
    """How far every name would be off at most, were it a query."""
    return _named_tags(spark, d).select(F.col("name").alias("query"), textsearch.allowed_for(F.col("name")).alias("distance")).distinct()


@query
def fts_terms(spark, d):
    return spark.createDataFrame([(t,) for t in textsearch.fts_terms("red fox")], "term string")


@query
def match_scores(spark, d):
    """Scores of every tag name against a few queries."""
    asked = spark.createDataFrame([(q, textsearch.allowed_distance(q)) for q in ("sketch", "untitled", "harbor")], "q string, dist int")
    names = _named_tags(spark, d).select(textsearch.normalized(F.col("name")).alias("name")).distinct()
    return names.join(F.broadcast(asked)).select("q", "name", textsearch.match_score(F.col("q"), F.col("name"), F.col("dist")).alias("score")).filter("score is not null")


@query
def tag_regex_scan(spark, d):
    return textsearch.scan_tags(_named_tags(spark, d), pattern="[0-9]+")


@query
def tag_substring_scan(spark, d):
    return textsearch.scan_tags(_named_tags(spark, d), text="castle", deny=[2], allow=[1, 3, 7, 8, 9, 10, 11, 12])


@query
def tag_name_groups(spark, d):
    """Names that several ids hold, under one spelling."""
    return textsearch.same_names(_named_tags(spark, d))


@query
def jobs_runnable_topk_per_site(spark, d):
    return jobs.runnable(catalog(spark, d).jobs, NOW, 20).select("id", "site", "priority", "rank")


@query
def jobs_by_site(spark, d):
    return jobs.of_site(catalog(spark, d).jobs, "purchase").select("id", "time", "reptime")


@query
def job_sites(spark, d):
    return jobs.sites(catalog(spark, d).jobs)


@query
def jobs_dedup_upsert(spark, d):
    c = catalog(spark, d)
    new = c.jobs.filter("id % 10 < 2").select("time", F.when(F.col("id") % 10 == 0, F.col("reptime")).otherwise(F.col("reptime") + 1).alias("reptime"), "site", "param", (F.col("priority") + 100).alias("priority"), "user_data", "recreation", F.col("id").alias("seq"))
    return jobs.upsert(c.jobs, new, "seq").select("id", "time", "reptime", "site", "param", "priority")


@query
def jobs_recreate(spark, d):
    return jobs.recreated(catalog(spark, d).jobs.filter("is_running"), NOW)


@query
def jobs_retry_later(spark, d):
    return jobs.retry_later(catalog(spark, d).jobs, list(range(0, 70, 7)), NOW, 300).select("id", "time", "reptime", "is_running")


@query
def jobs_removed(spark, d):
    return jobs.without(catalog(spark, d).jobs, list(range(50))).select("id")


@query
def jobs_by_plugin(spark, d):
    routes = spark.createDataFrame([("view", "viewer"), ("click", "viewer"), ("purchase", "shop")], "site string, plugin string")
    return jobs.grouped_by_plugin(catalog(spark, d).jobs, routes)


@query
def job_param_json(spark, d):
    return jobs.param_field(catalog(spark, d).jobs, "k")


@query
def skip_if_file_tag(spark, d):
    """Jobs whose number is no tag with files."""
    c = catalog(spark, d)
    return jobs.without_known_tag(c.jobs, "k", c.rel)


@query
def should_download_urls(spark, d):
    return settings.to_download(_mirrors(spark, d), catalog(spark, d).dead_urls)


def _actions(spark, d):
    """Actions made of the retail tables: each names a tag by its text."""
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    t = lambda name, ns: F.struct(name.alias("name"), F.lit(ns).alias("ns"), F.lit(None).cast("string").alias("ns_desc"), F.lit("Normal").alias("tag_type"), F.lit(None).cast("struct<name:string,ns:string,limit_name:string,limit_ns:string>").alias("relates_to"))
    rows = lines.filter("l_orderkey % 20 < 6").join(part, lines.l_partkey == part.p_partkey)
    op = F.when(F.col("l_orderkey") % 20 < 2, "Add").when(F.col("l_orderkey") % 20 < 4, "Del").otherwise("Set")
    return rows.select(F.col("l_orderkey").alias("file_id"), op.alias("operation"), F.array(t(F.when(F.col("l_orderkey") % 2 == 0, F.lit("Brand#2")).otherwise(F.col("p_brand")), "brand")).alias("tags")).distinct()


@query
def apply_actions_edges(spark, d):
    """The edges of the namespaces that the actions touch, as they are to be written anew."""
    return ingest.apply_actions(catalog(spark, d), _actions(spark, d), all_namespaces=False).select("file_id", "tag_id")


@query
def apply_actions_all(spark, d):
    """The whole edge table after the actions."""
    return ingest.apply_actions(catalog(spark, d), _actions(spark, d)).select("file_id", "tag_id")


@query
def ingest_tags_new_ids(spark, d):
    """Tags of posts, added to the graph: their text is split at commas and semicolons."""
    c = catalog(spark, d)
    names = table(spark, d, "post_item").select(F.explode(F.split("tags", "[,;]")).alias("n")).select(F.trim("n").alias("n")).filter("n <> ''").distinct()
    none = F.lit(None).cast("string")
    tag = F.struct(F.col("n").alias("name"), F.lit("post").alias("ns"), F.lit("from posts").alias("ns_desc"), F.lit("Normal").alias("tag_type"), F.struct(F.lit("archive").alias("name"), F.lit("root").alias("ns"), none.alias("limit_name"), none.alias("limit_ns")).alias("relates_to"))
    namespace, tags, parents = ingest.add_tags(c, names.select(F.lit(0).cast("long").alias("file_id"), F.lit("Add").alias("operation"), F.array(tag).alias("tags")))
    ns = namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns"))
    return tags.join(ns, "namespace").join(parents.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("n_parents")), "id", "left").select("id", "ns", "name", F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"))


@query
def namespace_upsert(spark, d):
    new = table(spark, d, "tag_namespace").select("name", "description").unionByName(spark.createDataFrame([("brand", "Makers"), ("size", None)], "name string, description string"))
    return ingest.upsert_namespaces(catalog(spark, d).namespace, new)


@query
def file_upsert(spark, d):
    """Files of the project, added to those of the graph."""
    return ingest.upsert_files(catalog(spark, d).files, table(spark, d, "files").select("hash", "extension", "storage_id", "size_bytes"))


@query
def parents_dedupe_nullsafe(spark, d):
    c = catalog(spark, d)
    return ingest.add_parents(c.parents, c.parents.unionByName(c.parents.withColumn("limit_to", F.lit(None).cast("long"))))


@query
def rel_add(spark, d):
    """The whole edge table with two tags, and one that isn't known, added to every second file."""
    c = catalog(spark, d)
    new = c.files.filter("id % 2 = 0").select(F.col("id").alias("file_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 10**12)])).alias("tag_id"))
    return ingest.add_edges(c, new).select("file_id", "tag_id")


@query
def rel_add_all(spark, d):
    """The whole edge table with two tags, and one that isn't known, added to every file."""
    c = catalog(spark, d)
    new = c.files.select(F.col("id").alias("file_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 10**12)])).alias("tag_id"))
    return ingest.add_edges(c, new).select("file_id", "tag_id")


@query
def rel_delete(spark, d):
    c = catalog(spark, d)
    return ingest.drop_edges(c.rel, c.rel.filter("file_id % 10 <> 0")).select("file_id", "tag_id")


@query
def tag_cascade_delete(spark, d):
    c = catalog(spark, d)
    left = ingest.drop_tags(c, c.tags.filter("id % 3 = 0"))
    return left.parents


@query
def namespace_cascade_delete(spark, d):
    c = catalog(spark, d)
    left = ingest.drop_namespace(c, lookup.namespace_id(c, "type").first().id)
    return left.rel.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query
def merge_databases(spark, d):
    """Tags of two graphs merged, with their files and parents."""
    c = catalog(spark, d)
    m = ingest.merge(shifted(c), c)
    ns = m.namespace.select(F.col("id").alias("namespace"), F.col("name").alias("ns"))
    up = m.parents.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("n_parents"))
    return m.tags.join(ns, "namespace").join(up, "id", "left").select("ns", "name", "count", F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"))


@query
def audit_diff(spark, d):
    c = catalog(spark, d)
    new = c.files.filter("id % 11 <> 0").withColumn("size_bytes", F.when(F.col("id") % 13 == 0, F.lit(None).cast("long")).otherwise(F.col("size_bytes")))
    old = c.files.filter("id % 17 <> 0")
    return audit.diff(old, new, ["id"], ["hash", "extension", "size_bytes"])


@query
def audit_backfill(spark, d):
    c = catalog(spark, d)
    return audit.backfill(c.files, c.tags, c.rel, NOW).groupBy("entity_type", "action", "changed_at").agg(F.count(F.lit(1)).alias("n"), F.count("file_id").alias("n_files"), F.count("tag_id").alias("n_tags"))


@query
def audit_get(spark, d):
    c = catalog(spark, d)
    return audit.entries(audit.backfill(c.files, c.tags, c.rel, NOW), file_id=8).select("entity_type", "file_id", "tag_id")


@query
def hash_columns(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return content.hash_rows(docs, "doc_id", "text", ("MD5", "SHA1", "SHA256"))


@query
def hash_columns_all(spark, d):
    """All four digests of every document; DuckDB has no SHA512."""
    return content.hash_rows(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query
def missing_hashes(spark, d):
    c = catalog(spark, d)
    return settings.without_digests(c.files, c.file_hashes)


@query
def missing_sizes(spark, d):
    return settings.without_size(table(spark, d, "files"))


@query
def sharded_path(spark, d):
    return table(spark, d, "files").select("id", content.sharded_path(F.concat(F.lit("store"), F.col("storage_id")), F.col("hash"), F.col("extension")).alias("path")).distinct()


@query
def storage_check(spark, d):
    c = catalog(spark, d)
    storage = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, location string")
    path = F.regexp_replace(content.sharded_path(F.lit(""), F.col("hash"), F.col("extension")), "^/", "")
    listing = c.files.filter("id % 5 <> 0").select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.when(F.col("id") % 7 == 0, F.lit(1)).otherwise(F.col("storage_id"))).cast("int")).alias("location"), path.alias("path"))
    listing = listing.unionByName(spark.createDataFrame([("a", "st/ra/yy/strayyyy.bin")], "location string, path string"))
    return content.storage_check(c.files, storage, listing)


@query
def backup_path(spark, d):
    return table(spark, d, "post_item").select("id", content.dated_path("backup", F.col("added")).alias("path")).distinct()


@query
def download_verified(spark, d):
    f = table(spark, d, "files").filter("hash is not null").distinct()
    length, announced = F.col("size_bytes"), F.when(F.col("id") % 4 == 0, F.col("size_bytes") + 1).when(F.col("id") % 4 == 1, F.col("size_bytes"))
    return f.select("id", content.verified(length, announced, F.col("hash"), F.upper("hash")).alias("ok"))


@query
def retry_backoff(spark, d):
    return spark.range(0, 8).select(F.col("id").alias("attempt"), content.backoff_seconds(F.col("id")).alias("seconds"), content.retryable(F.lit(400) + F.col("id") * 8).alias("again"))


def _mirrors(spark, d):
    return table(spark, d, "comment_item").select(F.explode(F.regexp_extract_all("content", F.lit(r"files\.example\.org/p/\d+/\d+"), F.lit(0))).alias("url")).distinct()


@query
def extract_url_parts(spark, d):
    return _mirrors(spark, d).select("url", extract.url_host(F.col("url")).alias("host"), extract.url_segment(F.col("url"), 1).alias("kind"), extract.url_segment(F.col("url"), 2).alias("post"))


@query
def last_path_segment(spark, d):
    return _mirrors(spark, d).select("url", extract.last_path_number(F.col("url")).alias("number"))


@query
def url_query_params(spark, d):
    made = table(spark, d, "comment_item").select(F.concat(F.lit("https://a.example/p?post="), F.col("post_id"), F.lit("&by="), F.coalesce("commenter", F.lit("")), F.lit("#c")).alias("url")).filter("url is not null").distinct()
    q = extract.url_query(F.col("url"))
    return made.select("url", q["post"].alias("post"), q["by"].alias("by"))


@query
def absolute_urls(spark, d):
    """Addresses of posts' contents as they may stand on a page, made absolute."""
    p = table(spark, d, "post_item").select("id").filter("id is not null").distinct()
    href = F.when(F.length("id") % 4 == 0, F.concat(F.lit("/a/"), "id")).when(F.length("id") % 4 == 1, F.concat(F.lit("//cdn.example/"), "id")).when(F.length("id") % 4 == 2, F.concat(F.lit("https://o.example/"), "id")).otherwise(F.concat(F.lit("img/"), "id"))
    return p.select("id", extract.absolute_url("https://s.example", href).alias("url"))


@query
def html_links_explode(spark, d):
    rows = table(spark, d, "post_item").select("id", "content").unionByName(table(spark, d, "comment_item").select("id", "content"))
    return rows.select("id", F.explode(extract.html_links(F.col("content"))).alias("link")).distinct()


@query
def html_text(spark, d):
    return table(spark, d, "post_item").filter("content is not null").select("id", "content").distinct().select("id", extract.html_text(F.col("content")).alias("text"))


@query
def html_paragraphs(spark, d):
    """Paragraphs of posts, in order."""
    rows = table(spark, d, "post_item").filter("content is not null").select("id", "content").distinct()
    return rows.select("id", F.posexplode(F.regexp_extract_all("content", F.lit("<p>(.*?)</p>"), F.lit(1))).alias("position", "paragraph"))


@query
def iso_duration(spark, d):
    made = table(spark, d, "events").select("event_id", F.concat(F.lit("PT"), F.col("user_id"), F.when(F.col("event_id") % 3 == 0, "M").when(F.col("event_id") % 3 == 1, "H5S").otherwise("X")).alias("text"))
    return made.select("event_id", extract.iso_seconds(F.col("text")).alias("seconds"))


@query
def duration_words(spark, d):
    """Durations made of the events' numbers, some of them not to be read to their end."""
    k = F.col("user_id").cast("string")
    forms = [F.concat(k, F.lit("w2d"), k, F.lit("h")), F.concat(F.lit("h"), k, F.lit("m")), F.concat(F.lit("+"), k, F.lit("m")), F.lit("NOW"), F.concat(k, F.lit("m30s9s")), F.concat(F.lit("x"), k, F.lit("s")), F.concat(k, F.lit("y1mo")), F.concat(k, F.lit("d, 5s"))]
    made = table(spark, d, "events").select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int")).alias("text"))
    return made.select("event_id", extract.spoken_seconds(F.col("text")).alias("seconds"))


@query
def max_by_quality(spark, d):
    """Of each customer's orders the label of the best quality; of several the greatest label."""
    made = table(spark, d, "orders").select("o_custkey", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("360p", "720p", "1080p", "4k", "none")]), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit("-"), F.col("o_orderkey")).alias("label"))
    return made.groupBy("o_custkey").agg(F.max(F.struct(extract.quality_score(F.split_part("label", F.lit("-"), F.lit(1))).alias("score"), F.col("label"))).alias("m")).select("o_custkey", "m.score", "m.label")


@query
def base64_digest_hex(spark, d):
    return table(spark, d, "files").filter("hash is not null").distinct().select("id", extract.base64_hex(F.base64(F.unhex("hash"))).alias("hex"))


@query
def ts_parse(spark, d):
    made = table(spark, d, "post_item").select("id", "added", F.date_format(F.timestamp_seconds("added"), "yyyy-MM-dd'T'HH:mm:ss").alias("t")).distinct()
    text = F.when(F.col("added") % 3 == 0, F.col("t")).when(F.col("added") % 3 == 1, F.concat("t", F.lit(".250"))).otherwise(F.concat("t", F.lit("+02:00")))
    return made.select("id", "added", extract.epoch_seconds(text).alias("epoch"))


@query
def quoted_csv(spark, d):
    made = table(spark, d, "post_item").filter("tags is not null").select("id", F.concat(F.lit("{"), F.regexp_replace("tags", " *[,;] *", ","), F.lit("}")).alias("t")).distinct()
    return made.select("id", F.explode(extract.braced_csv(F.col("t"))).alias("field")).distinct()


@query
def whitespace_collapse(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(extract.collapsed(F.regexp_replace("text", " ", " "))).alias("digest"))


@query
def watermark_clean(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.length(extract.without_watermark(F.col("text"), "copied from a worksheet: *")).cast("long").alias("n"))


@query
def best_time(spark, d):
    """When a post was last touched: edited, else published, else added."""
    return posts.last_touched(table(spark, d, "post_item"))


@query
def post_tags_positions(spark, d):
    """Tags of posts with their places in the list."""
    return posts.listed_tags(table(spark, d, "post_item"))


@query
def comment_scopes(spark, d):
    """Comments joined to their posts: commenter as a tag in the scope of the post's user."""
    return posts.scoped_comments(table(spark, d, "comment_item"), table(spark, d, "post_item"))


@query
def page_fanout(spark, d):
    """Pages of every post, fifty comments a page, by the number of its comments."""
    n = table(spark, d, "comment_item").filter("post_id is not null").groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.pages(n, F.lit(0).cast("long"), F.col("n") - 1, 50, "offset")


@query
def chunk_by_10(spark, d):
    """Ids of tags with files, in lists of ten."""
    return ids.in_lists(catalog(spark, d).tags.filter("count > 0"), "id", 10)


@query
def chunk_by_10_all(spark, d):
    """All ids that aren't known yet, in lists of ten."""
    c = catalog(spark, d)
    return ids.in_lists(c.tags.join(c.parents.select(F.col("tag_id").alias("id")), "id", "left_anti"), "id", 10)


@query
def search_addresses(spark, d):
    rows = table(spark, d, "post_item").filter("tags is not null").select("id", F.split(F.regexp_replace("tags", " *[,;] *", ","), ",").alias("t")).distinct()
    return rows.select("id", extract.joined_query("https://s.example/posts", F.array_sort("t"), F.lit(1)).alias("url"))


@query
def policy_search(spark, d):
    c = catalog(spark, d)
    return policy.search(c, "brand2", policy.Policy([".F", "o"], ["small"], ["BRAND#2"], limit=500))


@query
def edge_membership(spark, d):
    """Of every file, is it linked to a tag?"""
    c = catalog(spark, d)
    (b2,) = tag_ids(c, B2)
    return search.has_edges(c.rel, c.files.select(F.col("id").alias("file_id"), F.lit(b2).alias("tag_id")))


@query
def put_tags(spark, d):
    """How many tags each file has after the tags are put."""
    return ingest.put_tags(catalog(spark, d), _actions(spark, d)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query
def put_tags_all(spark, d):
    """The whole edge table with the tags put."""
    return ingest.put_tags(catalog(spark, d), _actions(spark, d)).select("file_id", "tag_id")


@query
def settings_put(spark, d):
    have = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("description"), F.col("r_regionkey").cast("long").alias("num"), F.lit("a").alias("param"))
    new = have.filter("num % 2 = 0").withColumn("param", F.lit("b")).unionByName(spark.createDataFrame([("NEW", "d", None, None)], "name string, description string, num long, param string"))
    return settings.put(have, new, ["name"])


@query
def setting_get(spark, d):
    have = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("num"))
    return settings.get(have, "ASIA")


@query
def dead_url_add(spark, d):
    return settings.put(catalog(spark, d).dead_urls, _mirrors(spark, d).filter("url like '%1'"), ["url"])


@query
def storage_get_or_create(spark, d):
    have = table(spark, d, "nation").filter("n_nationkey < 5").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("location"))
    return settings.get_or_create(have, table(spark, d, "nation").select(F.col("n_name").alias("location")), "location")


@query
def file_hash_add(spark, d):
    c = catalog(spark, d)
    new = c.files.filter("id % 2 = 0").select(F.col("id").alias("file_id"), F.lit("MD5").alias("algorithm"), F.when(F.col("id") % 8 == 0, F.lit("")).otherwise(F.lower("hash")).alias("digest"))
    return settings.add_digests(c.file_hashes, new)


@query
def file_location(spark, d):
    c = catalog(spark, d)
    storage = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, location string")
    path = F.regexp_replace(content.sharded_path(F.lit(""), F.col("hash"), F.col("extension")), "^/", "")
    listing = c.files.filter("id % 5 <> 0").select(F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("c"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("location"), path.alias("path"))
    return settings.located(c.files, storage, listing)


@query
def json_post_tags(spark, d):
    """Posts as a site would deliver them, written as JSON and read again."""
    tags = F.transform(F.split("tags", "[,;]"), lambda x: F.trim(x))
    p = table(spark, d, "post_item").filter("tags is not null").select("id", "tags", "user_id", "service").distinct()
    one = F.struct(F.col("id").cast("long").alias("id"), F.lit("s").alias("rating"), F.array("service").alias("sources"), F.create_map(F.lit("general"), tags, F.lit("artist"), F.array("user_id")).alias("tags"))
    bodies = p.groupBy(F.pmod(F.col("id").cast("long"), F.lit(50)).alias("page")).agg(F.to_json(F.struct(F.collect_list(one).alias("posts"))).alias("body"))
    return posts.post_tags(posts.posts(bodies, "body"))


@query
def static_urls(spark, d):
    return table(spark, d, "files").select("id", posts.static_url("https://s.example", F.col("hash"), F.col("extension")).alias("url")).distinct()


@query
def parent_ids(spark, d):
    made = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "0").when(F.col("event_id") % 4 == 2, F.col("user_id").cast("string")).otherwise("x").alias("t"))
    return made.select("event_id", posts.parent_id(F.col("t")).alias("parent"))


@query
def pool_positions(spark, d):
    p = table(spark, d, "relationship_roaring_tagid").filter("tagid is not null and fileid_bitmap is not null").groupBy("tagid").agg(F.min(F.array_sort(F.filter("fileid_bitmap", lambda x: x.isNotNull()))).alias("m"))
    return posts.pool_positions(p, "tagid", "m")


@query
def catalog_hits(spark, d):
    return table(spark, d, "post_item").filter(posts.catalog_hit(F.col("title"), F.col("content"), "CASTLE")).select("id").distinct()


@query
def chapter_numbers(spark, d):
    p = table(spark, d, "post_item").filter("tags is not null").select("id", "tags").distinct().select("id", F.split("tags", "[,;]").alias("names"))
    return posts.chapter_order(p, "id", "names")


@query
def job_params(spark, d):
    made = table(spark, d, "events").select("event_id", F.concat(F.col("event_type"), F.lit(" https://a.example/"), F.col("user_id"), F.lit("  x")).alias("t"))
    return made.select("event_id", F.inline(extract.params(F.col("t"))))


@query
def thumbnail_paths(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", content.thumbnail_path("thumbs", F.col("text")).alias("path"))


@query
def search_groups_all(spark, d):
    """All six lists at once."""
    c = catalog(spark, d)
    red, b2, b17, small = tag_ids(c, RED, B2, B17, SMALL)
    return search.search_by_groups(c, [b2], ["widget"], [b17], ["red widget"], [small], ["gadget"], 200)


@query
def search_groups_ids(spark, d):
    """Alternatives by id alone, and an excluded name that finds nothing."""
    c = catalog(spark, d)
    red, b2, b17, small = tag_ids(c, RED, B2, B17, SMALL)
    return search.search_by_groups(c, or_ids=[red, b17], not_ids=[small], not_names=["qqqqzzzzxxxx"])


@query
def search_groups_unknown(spark, d):
    """A required name that finds nothing."""
    return search.search_by_groups(catalog(spark, d), and_names=["red widget", "qqqqzzzzxxxx"])


@query
def policy_file_tags(spark, d):
    return policy.file_tags(catalog(spark, d), FILES, policy.Policy(["o"], ["small"]))


@query
def policy_file_tag_ids(spark, d):
    return policy.file_tag_ids(catalog(spark, d), FILES, policy.Policy(require=["Brand#2"]))


def _words(spark, d):
    """The words of all documents, as names, in scripts of all kinds."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", "[ \\n]")).alias("name")).filter("name <> ''").distinct()
    return words.withColumn("norm", textsearch.normalized(F.col("name")))


@query
def names_greek_devanagari(spark, d):
    """Words that begin with a Greek or a Hindi query, whatever their case, or hold it."""
    asked = spark.createDataFrame([(q, textsearch.normalize_text(q), textsearch.allowed_distance(textsearch.normalize_text(q))) for q in ("ΑΡΧΕΊΟ", "της", "Σελ", "सूची", "के", "चित्र")], "query string, q string, d int")
    rows = _words(spark, d).join(F.broadcast(asked), F.col("norm").contains(F.col("q")))
    return rows.select("query", "name", textsearch.match_score(F.col("q"), F.col("norm"), F.col("d")).alias("score")).filter("score <= 1")


@query
def jobs_system(spark, d):
    """Jobs with some sites renamed, as the engine's own or not."""
    own = F.when(F.col("id") % 5 == 0, "SYSTEM_FILE_SIZE").when(F.col("id") % 5 == 1, "SYSTEM_OTHER").otherwise(F.col("site"))
    return jobs.is_system(catalog(spark, d).jobs.withColumn("site", own))


@query
def jobs_completed(spark, d):
    """The whole queue after every third job is done."""
    c = catalog(spark, d)
    left = jobs.completed(c.jobs, c.jobs.filter("id % 3 = 0").select("id"), NOW)
    return left.select("id", "time", "reptime", "is_running", F.from_json("recreation", "count long")["count"].alias("count"))


@query
def jobs_started(spark, d):
    return jobs.running(jobs.reset(catalog(spark, d).jobs), list(range(0, 50, 5))).select("id", "is_running")


@query
def file_update_batch(spark, d):
    c = catalog(spark, d)
    changes = c.files.filter("id % 4 = 0").select((F.col("id") + 0).alias("id"), F.lower("hash").alias("hash"), F.when(F.col("id") % 8 == 0, "new").alias("extension"), F.lit(9).cast("long").alias("storage_id"))
    return ingest.update_files(c.files, changes)


@query
def bitmap_changes(spark, d):
    """Sizes of all sets after some members are added to the bitmaps, and others removed, without making them anew."""
    rel = catalog(spark, d).rel.filter("file_id % 3 < 2")
    b = bitmaps.to_bitmaps(rel.filter("file_id % 3 = 0"))
    b = bitmaps.add_members(b, rel.filter("file_id % 3 = 1"))
    return bitmaps.cardinality(bitmaps.remove_members(b, rel.filter("file_id % 2 = 0")))


def _nodes(spark, d):
    """Suppliers in nations in regions, as files in folders in roots."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    node = lambda df, h, p, kind, name: df.select(h.alias("handle"), p.alias("parent"), F.lit(kind).alias("kind"), name.alias("name"))
    key = lambda c, x: F.concat(F.lit(x), F.col(c).cast("string"))
    sup = node(table(spark, d, "supplier"), key("s_suppkey", "s"), key("s_nationkey", "n"), "file", F.col("s_name"))
    return node(r, key("r_regionkey", "r"), F.lit(None).cast("string"), "root", F.col("r_name")).unionByName(node(n, key("n_nationkey", "n"), key("n_regionkey", "r"), "folder", F.col("n_name"))).unionByName(sup)


@query
def tree_files_below(spark, d):
    nodes = _nodes(spark, d)
    return trees.files_below(nodes, nodes.filter("handle in ('r1', 'n3', 's5')"))


@query
def tree_paths(spark, d):
    return trees.paths(_nodes(spark, d))


@query
def tree_metadata(spark, d):
    nodes = _nodes(spark, d).withColumns({"size": F.length("name").cast("long"), "created": F.lit(NOW).cast("long"), "modified": F.lit(None).cast("long")})
    return trees.metadata_tags(nodes, "2024-01-06")


def _pages(spark, d):
    """Pages made of documents' numbers, as the sites would write them."""
    k = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<html><head><title>T'), k, F.lit('</title><script type="application/ld+json">{"id": '), k, F.lit('}</script><script>const BOOK_ID = "b'), k, F.lit('"; x("%2F'), F.md5(k), F.lit('.webp"); self.__next_f.push([1,"a\\n\\u003cb\\u003e'), k,
        F.lit('"])</script></head><body><ul class="statlist"><li>Post: '), k, F.lit('</li><li><a href="https://o.example/'), k, F.lit('">src</a></li></ul><a class="mtypetag" href="/t">tag '), k, F.lit('</a><a class="x atypetag">artist&amp;'), k,
        F.lit('</a><a class="chapter" href="/c/'), k, F.lit('"><div class="title"> Chapter  '), k, F.lit(' </div>'), F.when(F.col("doc_id") % 2 == 0, '<span class="chapter-info"><b class="cost">5</b></span>').otherwise(""),
        F.lit('</a><div>one <script>no</script>two</div><div class="advertisment">ad</div><div id="yandex_rtb_1">ad</div><a href="?q=1&page='), (F.col("doc_id") % 7).cast("string"), F.lit('">next</a></body></html>'),
    )
    return table(spark, d, "documents").select("doc_id", html.alias("html"))


def _elements(spark, d):
    return _pages(spark, d).select("doc_id", extract.html_elements(F.col("html")).alias("e"))


@query
def page_values(spark, d):
    """Titles, embedded data, constants, pushed texts, digests and numbers of pages."""
    h = F.col("html")
    return _pages(spark, d).select("doc_id", extract.html_title(h).alias("title"), extract.json_ld(h).alias("data"), extract.script_constant(h, "BOOK_ID").alias("book"), extract.pushed_text(h).alias("pushed"), extract.media_hash(h).alias("media"), extract.page_numbers(h).alias("pages"))


@query
def page_tags_by_class(spark, d):
    tags = extract.tags_by_class(F.col("e"), {"mtypetag": "general", "atypetag": "artist"})
    return _elements(spark, d).select("doc_id", F.inline(tags))


@query
def page_stat_list(spark, d):
    rows = extract.children_of_first(F.col("e"), "ul", "statlist")
    return _elements(spark, d).select("doc_id", F.posexplode(F.transform(rows, lambda e: e["text"])).alias("position", "text"))


@query
def page_chapters(spark, d):
    return _elements(spark, d).select("doc_id", F.inline(extract.chapters(F.col("e"))))


@query
def page_body(spark, d):
    return _elements(spark, d).select("doc_id", extract.body_lines(F.col("e"), "copied from a worksheet: *").alias("body"))


@query
def html_plain(spark, d):
    """Text of contents that hold no markup: their lines without outer and repeated spaces."""
    rows = table(spark, d, "comment_item").filter("content is not null and content not like '%<%' and content not like '%&%'").select("id", "content").distinct()
    return rows.select("id", "content", extract.html_text(F.col("content")).alias("text"))


@query
def video_ids(spark, d):
    made = table(spark, d, "events").select("event_id", F.concat(F.lit("https://v.example/"), F.when(F.col("event_id") % 2 == 0, "video/").otherwise("v/"), F.col("user_id"), F.lit("/x?y=1")).alias("url"))
    return made.select("event_id", extract.video_id(F.col("url")).alias("video"), extract.slug(F.col("url")).alias("slug"), extract.file_stem(F.col("url")).alias("stem"))


@query
def error_kinds(spark, d):
    made = table(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in ("Quota reached", "OVER LIMIT", "Blocked", "access denied", "not found")]), (F.col("event_id") % 5 + 1).cast("int")).alias("message"))
    return made.select("event_id", extract.error_kind(F.col("message")).alias("kind"))


@query
def paired_params(spark, d):
    """Tags of posts two by two, in order."""
    p = table(spark, d, "post_item").filter("tags is not null").select("id", F.split("tags", "[,;]").alias("t")).distinct()
    return p.select("id", F.posexplode(extract.paired(F.col("t"))).alias("position", "pair")).select("id", "position", "pair.first", "pair.second").distinct()


@query
def json_list_or_single(spark, d):
    one = F.to_json(F.struct(F.col("event_id").alias("a")))
    body = F.when(F.col("event_id") % 3 == 0, one).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" ["), one, F.lit(","), one, F.lit("]"))).otherwise("no")
    return table(spark, d, "events").select("event_id", F.explode(posts.list_or_single(body, "a: bigint")).alias("x")).select("event_id", "x.a")


@query
def first_chapters(spark, d):
    made = table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "").otherwise("Vol "), F.col("event_id") % 4, F.when(F.col("event_id") % 5 == 0, " Chapter").otherwise(" x")).alias("title"))
    return made.filter(posts.first_chapter(F.col("title"))).select("event_id", "title")


@query
def post_attachments(spark, d):
    paths = F.array(F.concat(F.lit("/data/"), F.sha2(F.col("id"), 256), F.lit(".png")), F.concat(F.lit("/data/"), "id", F.lit(".zip")))
    return posts.attachments(table(spark, d, "post_item").filter("id is not null").select("id", paths.alias("p")).distinct(), "id", "p")


@query
def chapter_fanout(spark, d):
    """Chapters of brands that no part has as its size."""
    part = table(spark, d, "part")
    series = part.select(F.col("p_brand").alias("series"), F.concat(F.lit("https://s.example/"), "p_brand").alias("url")).distinct()
    return posts.chapter_jobs(series, part.select(F.col("p_brand").alias("series"), F.col("p_size").alias("chapter")).distinct(), 60)


@query
def model_hits(spark, d):
    """Posts as a model site would deliver them, written as JSON and read again."""
    p = table(spark, d, "post_item").filter("tags is not null and added is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("tags").alias("tags"), F.min("added").alias("added"))
    hit = F.struct("id", F.struct((F.col("id") % 7).alias("id"), F.concat(F.lit("u"), F.col("id") % 7).alias("username")).alias("user"), F.date_format(F.timestamp_seconds("added"), "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("publishedAt"), F.transform(F.split("tags", "[,;]"), lambda x: F.trim(x)).alias("tagNames"))
    bodies = p.groupBy(F.pmod("id", F.lit(20)).alias("page")).agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(hit).alias("hits"))).alias("results"))).alias("body"))
    return posts.hit_tags(posts.hits(bodies, "body"))


@query
def sniffed_formats(spark, d):
    """Formats told by the first bytes of contents."""
    head = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("FFD8FFE0", "89504E470D0A1A0A00", "47494638", "255044462D", "00000018667479706D703432", "524946460000000057454250", "FFFF")]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", content.sniffed_extension(head).alias("extension"))


@query
def registry_steps(spark, d):
    """Steps by the name of a job's site: addresses of views, doubled ones of purchases, and what starts before them."""
    r = Registry()
    url = lambda mark: lambda rows: rows.select("id", F.concat(F.lit(f"https://{mark}.example/"), F.col("id")).alias("url"))
    r.add("fan_out", "view", url("a"))
    r.add("fan_out", "purchase", lambda rows: url("b")(rows).unionByName(url("c")(rows)))
    r.add("on_start", "first", lambda rows: rows.filter("id < 10"))
    r.offer("least", 1, (int,), lambda n: n * 2)
    jobs_table = catalog(spark, d).jobs
    made = r.run("fan_out", jobs_table, "site")
    return made.unionByName(url("start")(r.start(jobs_table)["first"]).filter(F.col("id") >= r.call("least", 1, 2)).withColumn("site", F.lit("start")))


@query
def migrated_columns(spark, d):
    """A table of an older shape read in a newer one: a column it lacks is null, others are cast or left out."""
    return readers.existing_columns(table(spark, d, "nation"), "n_nationkey long, n_name string, n_comment string")


@query
def file_tree_roundtrip(spark, d):
    """Regions written as text files with sidecars in JSON, read again as a tree."""
    rows = [(r.r_regionkey, r.r_name) for r in table(spark, d, "region").collect()]
    root = f"tree-{uuid.uuid4().hex}"
    for k, name in rows:
        write_shared(spark, f"{root}/{k}/{name}.bin", name.encode())
        write_shared(spark, f"{root}/{k}/{name}.bin.json", f'{{"k": {k}}}'.encode())
    tree = readers.with_sidecars(readers.file_tree(spark, f"{shared_folder(spark)}/{root}"))
    return tree.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "json")


@query
def stream_edges(spark, d):
    """Edges of two tags that arrive as a stream of files, kept once each in a table."""
    c = catalog(spark, d)
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ids_ = tag_ids(c, RED, SMALL)
    c.rel.filter(F.col("tag_id").isin(ids_)).select("file_id", "tag_id", "namespace").write.parquet(f"{root}/in")
    edges = spark.readStream.schema("file_id long, tag_id long, namespace long").parquet(f"{root}/in")
    streams.edges_to_table(edges, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("file_id", "tag_id")


@query
def stream_activity(spark, d):
    """Events per hour and kind, counted as they arrive; windows that may still grow aren't put out."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(f"{root}/in")
    seen = streams.activity(spark.readStream.schema(events.schema).parquet(f"{root}/in"), "ts", "event_type")
    seen.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{root}/out")


@query
def swapped_table(spark, d):
    """A table replaced twice, read afterwards."""
    path = f"{shared_folder(spark)}/swap-{uuid.uuid4().hex}"
    nation = table(spark, d, "nation")
    sinks.swap_in(nation, path)
    sinks.swap_in(nation.filter("n_regionkey = 1"), path)
    return spark.read.parquet(path)


@query
def replaced_namespaces(spark, d):
    """The graph's edges after actions, of which only the folders of the touched namespaces were written anew."""
    c = catalog(spark, d)
    root = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    c.write_edges(root)
    actions = _actions(spark, d)
    c.replace_namespaces(root, ingest.apply_actions(c, actions, all_namespaces=False), ingest.named_tags(c, actions))
    return spark.read.parquet(f"{root}/rel").select("file_id", "tag_id")


@query
def tag_matches_queued(spark, d):
    """Numbers in tag names as jobs, with the tags they come from."""
    queue, links = textsearch.queued_matches(_named_tags(spark, d), "[0-9]{2,}", "numbers")
    return queue.join(links, "param").select("site", "param", "priority", "tag_id")


@query
def content_ids(spark, d):
    """Content identifiers of all documents; DuckDB has neither base 58 nor base 32."""
    text = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", content.cid_v0(text).alias("v0"), content.cid_v1(text).alias("v1"))
