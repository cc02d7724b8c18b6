import pytest
from pyspark.sql import functions as F

from tagloom.catalog import TagCatalog
from tagloom.operators import audit, bitmaps, hierarchy, ingest, jobs, lookup, policy, search, snapshots, textsearch, trees
from tagloom.operators.ids import dense_ids, page_after, page_at
from tagloom.operators.search import SearchQuery, SearchSpec, search_files

REL = "file_id long, tag_id long, namespace long"


@pytest.fixture(scope="module")
def c(spark):
    out = TagCatalog.empty(spark)
    out.namespace = spark.createDataFrame([(1, "color", "d"), (2, "shape", None)], "id long, name string, description string")
    out.tags = spark.createDataFrame([(1, "red", 1, 2), (2, "blue", 1, 1), (3, "round", 2, 2), (4, "square", 2, 1)], "id long, name string, namespace long, count long")
    out.rel = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 2, 1), (2, 3, 2), (3, 1, 1), (3, 4, 2)], REL)
    out.files = spark.createDataFrame([(1, "aaaaaaaa", "jpg", 1, 9), (2, "bbbbbbbb", "png", 1, None), (3, "cccccccc", "gif", 1, 5), (4, None, None, None, None)], "id long, hash string, extension string, storage_id long, size_bytes long")
    out.parents = spark.createDataFrame([(1, 3, None), (1, 3, 4), (3, 4, None)], "tag_id long, relate_tag_id long, limit_to long")
    return out


def found(df):
    return [r.file_id for r in df.collect()]


@pytest.mark.parametrize("spec, want", [
    (SearchSpec([1, 3]), [1]), (SearchSpec(any_of=[[2, 4]]), [3, 2]), (SearchSpec([1], [], [4]), [1]), (SearchSpec(), []), (SearchSpec(none_of=[99]), [3, 2, 1]),
    (SearchSpec(none_of=[1]), [2]), (SearchSpec([99]), []), (SearchSpec([1, 99]), []), (SearchSpec(any_of=[[1, 2], [3]]), [2, 1]), (SearchSpec(any_of=[[], [99, 4]]), [3]), (SearchSpec([2], [[3, 4]], [1]), [2]),
])
def test_search(c, spec, want, monkeypatch):
    assert found(search_files(c.rel, spec)) == want
    monkeypatch.setattr(search, "INLINE_IDS", 0)
    assert found(search_files(c.rel, spec)) == want


def test_search_limits_nulls_and_nothing(c, spark):
    assert found(search_files(c.rel, SearchSpec(any_of=[[1, 2, 3, 4]]), limit=2)) == [3, 2]
    assert found(search_files(c.rel, SearchSpec([1]), limit=2**64 - 1)) == [3, 1]
    assert found(SearchQuery().any_of(1, 2).page(1, 1).run(c.rel)) == [2]
    assert found(SearchQuery().all_of(1, 99).run(c.rel)) == [3, 1]
    assert found(SearchQuery(ignore_unknown=False).all_of(1, 99).run(c.rel)) == []
    odd = c.rel.unionByName(spark.createDataFrame([(None, 1, 1), (9, None, 1), (1, 1, 1)], REL)).withColumn("_bad", F.lit(1))
    assert found(search_files(odd, SearchSpec([1]))) == [3, 1]
    assert found(search_files(c.rel.limit(0), SearchSpec(none_of=[1]))) == []


def test_bitmaps_over_several_buckets(spark):
    rel = spark.createDataFrame([(i * 40_000, t, 1) for i in range(5) for t in (7, 11) if (i + t) % 3] + [(None, 7, 1)], REL)
    sets = {t: {r.file_id for r in rel.filter(f"tag_id = {t} and file_id is not null").collect()} for t in (7, 11)}
    b = bitmaps.to_bitmaps(rel)
    assert {r.tag_id: r.n for r in bitmaps.cardinality(b).collect()} == {t: len(s) for t, s in sets.items()}
    assert bitmaps.intersection_count(b, [7, 11]).first().n == len(sets[7] & sets[11])
    assert bitmaps.union_count(b, [7, 11]).first().n == len(sets[7] | sets[11])
    assert bitmaps.difference_count(b, 7, 11).first().n == len(sets[7] - sets[11])


def test_lookups(c, spark, rows):
    assert rows(lookup.tags_of_files(c, [1, 4, 4])) == [(1, [1, 3]), (4, [])]
    assert rows(lookup.files_of_tags(c, [1, 99])) == [(1, 1), (1, 3)]
    assert rows(lookup.tag_objects(c, [2, 99])) == [(2, "blue", "color", "d")]
    assert rows(lookup.file_tag_objects(c, [2])) == [(2, 2, "blue", "color"), (2, 3, "round", "shape")]
    assert rows(lookup.untagged_files(c)) == [(4,)]
    assert lookup.first_file_of_tag(c, "red", "color").first().id == 1
    assert rows(lookup.first_file_of_tag(c, "red", "shape")) == []
    c2 = TagCatalog(**c.__dict__)
    c2.dead_urls = spark.createDataFrame([("u",), ("u",)], "url string")
    assert rows(lookup.dead_urls(c2, spark.createDataFrame([("u",), ("v",), ("v",), (None,)], "x string"))) == [("u", True), ("v", False)]


def test_hierarchy(c, spark, rows):
    assert hierarchy.one_parent(c, 1, 3).first().limit_to is None
    assert found(hierarchy.files_with_parents(c, 2)) == [2]
    assert sorted(found(hierarchy.files_with_parents(c, 1))) == [1, 2, 3]
    assert hierarchy.structure_exists(c, 1, 3, None).first().found and not hierarchy.structure_exists(c, 3, 4, 4).first().found
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "a long, b long")
    assert rows(hierarchy.closure(loop, "a", "b")) == sorted([(a, (a - 1 + d) % 3 + 1, d) for a in (1, 2, 3) for d in (1, 2, 3)], key=repr)


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(33)], "a long, b long").coalesce(1)
    far = hierarchy.closure(chain, "a", "b").filter("a = 0").agg(F.count(F.lit(1)), F.max("depth")).first()
    assert tuple(far) == (33, 33)


def test_scores_as_documented(spark):
    cases = [("kitten", "sitten", 3), ("kitten", "xxxxxx-long-name", None), ("猫", "猫", 0), ("猫", "犬犬犬", None), ("fem", "female", 0), ("male", "female", 1), ("猫", "黒猫", 1)]
    df = spark.createDataFrame([(q, n, textsearch.allowed_distance(q), s) for q, n, s in cases], "q string, n string, d int, want int")
    assert all(r.got == r.want for r in df.withColumn("got", textsearch.match_score(F.col("q"), F.col("n"), F.col("d"))).collect())


def test_text_search(spark):
    tags = spark.createDataFrame([(1, "female", 2), (2, "females", 10), (3, "feminine", 5), (4, "other", 100), (5, "red fox", 5), (6, "rare creature", 1), (7, None, 9), (8, "!!", 9)], "id long, name string, count long")
    ids = lambda q, n=10: [r.tag_id for r in textsearch.search_tags(tags, q, n).collect()]
    assert ids("fem", 2) == [2, 3]
    assert ids("red fxo") == [5] and ids("raer creatur", 1) == [6]
    assert ids("") == ids("?!") == ids("fem", 0) == []
    assert textsearch.fts_terms("fmaale").count("fmaale") == 1 and textsearch.fts_terms("a b") == []


def test_prefilter_only_drops_what_cannot_match(spark):
    import itertools

    names = ["".join(x) for x in itertools.product("abc", repeat=5)]
    tags = spark.createDataFrame([(i, n, i % 7) for i, n in enumerate(names)], "id long, name string, count long")
    for q in ("abcab", "aaaaa", "cabca"):
        a, b = (textsearch.search_tags(tags, q, 400, prefilter=p).collect() for p in (True, False))
        assert {r for r in b if r.score <= 2} <= set(a)


def test_ids_and_pages(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "name string")
    assert rows(dense_ids(df, ["name"], start=5)) == [("a", 6), ("b", 7), ("c", 8), (None, 5)]
    assert rows(dense_ids(df.limit(0), ["name"])) == []
    two = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "a int, b int")
    assert rows(page_after(two, ["a", "b"], [1, 2], 1)) == [(2, 1)]
    assert rows(page_after(two, ["a", "b"], [], 1)) == [(1, 1)]
    assert rows(page_at(two, ["a", "b"], 1, 2)) == [(1, 2), (2, 1)]


def test_latest_rows(spark, rows):
    df = spark.sql("select * from values (1, 2, array(1L)), (1, 3, cast(null as array<bigint>)), (1, null, array(9L)), (2, 1, array(1L)), (2, 1, array(2L)), (null, 5, array(1L)) as t(k, v, m)")
    assert rows(snapshots.latest(df, "k", "v", "m")) == [(1, None), (2, [2])]


def test_jobs(spark, rows):
    j = spark.createDataFrame([(1, 10, 5, 1, False, None, "a", "p", "u"), (2, 10, 5, 9, False, None, "a", "q", "u"), (3, 10, 500, 9, False, None, "a", "q", "u"), (4, 1, 1, 1, True, '{"kind":"AlwaysTime","interval":7,"count":1}', "b", "p", "u"), (5, 1, 1, 1, False, '{"kind":"AlwaysTime","interval":7,"count":0}', "b", "p2", "u")], "id long, time long, reptime long, priority long, is_running boolean, recreation string, site string, param string, user_data string")
    assert rows(jobs.runnable(j, 100, 1).select("id", "rank")) == [(2, 1), (5, 1)]
    assert rows(jobs.runnable(j, 100, 0)) == []
    assert rows(jobs.recreated(j, 50).select("id", "time", "reptime", "count")) == [(4, 50, 7, 0)]
    new = j.filter("id = 1").withColumn("priority", F.lit(7).cast("long")).withColumn("seq", F.lit(1)).unionByName(j.filter("id = 1").withColumn("param", F.lit("new")).withColumn("seq", F.lit(2)))
    assert rows(jobs.upsert(j, new, "seq").select("id", "param", "priority").filter("id in (1, 6)")) == [(1, "p", 7), (6, "new", 1)]
    assert rows(jobs.retry_later(j, [4], 9, 3).filter("id = 4").select("time", "reptime", "is_running")) == [(9, 3, False)]


def action(spark, data):
    from tagloom.schema import TAG_ACTION

    return spark.createDataFrame([(f, op, [(n, ns, None, kind, None) for n, ns, kind in tags]) for f, op, tags in data], TAG_ACTION)


def test_actions(c, spark, rows):
    a = action(spark, [(1, "Add", [("blue", "color", "Normal")]), (1, "Set", [("square", "shape", "Normal")]), (2, "Del", [("round", "shape", "Normal")]), (3, "Add", [("round", "shape", "Special")])])
    assert rows(ingest.apply_actions(c, a).select("file_id", "tag_id")) == [(1, 1), (1, 2), (1, 4), (2, 2), (3, 1), (3, 4)]
    both = action(spark, [(1, "Add", [("blue", "color", "Normal")]), (1, "Del", [("blue", "color", "Normal")])])
    assert (1, 2) not in rows(ingest.apply_actions(c, both).select("file_id", "tag_id"))
    assert rows(ingest.apply_actions(c, action(spark, [])).select("file_id", "tag_id")) == rows(c.rel.select("file_id", "tag_id"))


def test_new_tags_get_new_ids(c, spark, rows):
    from tagloom.schema import TAG_ACTION

    a = spark.createDataFrame([(1, "Add", [("rust", "lang", "languages", "Normal", ("programming", "topic", "backend", "scope")), ("", "lang", None, "Normal", None), ("red", "color", None, "NormalNoRegex", None), ("x", "lang", None, "Special", None)])] * 2, TAG_ACTION)
    namespace, tags, parents = ingest.add_tags(c, a)
    assert rows(namespace.select("id", "name"))[2:] == [(3, "lang"), (4, "scope"), (5, "topic")]
    assert rows(tags.filter("id > 4").select("id", "name", "namespace")) == [(5, "rust", 3), (6, "backend", 4), (7, "programming", 5)]
    assert (5, 7, 6) in rows(parents) and parents.count() == 4


def test_upserts_and_cascades(c, spark, rows):
    f = ingest.upsert_files(c.files, spark.createDataFrame([("aaaaaaaa", "png", 2, 1), ("dddddddd", "jpg", 1, 3), ("dddddddd", "jpg", 1, 3), (None, None, 1, 1)], "hash string, extension string, storage_id long, size_bytes long"))
    assert rows(f.filter("id in (1, 5)")) == [(1, "aaaaaaaa", "png", 2, 9), (5, "dddddddd", "jpg", 1, 3)] and f.count() == 5
    assert rows(ingest.add_parents(c.parents, c.parents.unionByName(spark.createDataFrame([(2, 2, None)], c.parents.schema)))) == rows(c.parents)
    assert rows(ingest.add_edges(c, spark.createDataFrame([(1, 1), (1, 99), (4, 2)], "file_id long, tag_id long")).filter("file_id in (1, 4)")) == [(1, 1, 1), (1, 3, 2), (4, 2, 1)]
    left = ingest.drop_tags(c, spark.createDataFrame([(4,)], "id long"))
    assert rows(left.parents) == [(1, 3, None)] and left.rel.count() == 5
    assert ingest.drop_namespace(c, 2).rel.count() == 3
    assert rows(ingest.upsert_namespaces(c.namespace, spark.createDataFrame([("color", "new"), ("shape", None), ("x", None)], "name string, description string"))) == [(1, "color", "new"), (2, "shape", None), (3, "x", None)]


def test_merge(c, spark, rows):
    other = TagCatalog.empty(spark)
    other.namespace = spark.createDataFrame([(8, "source", None), (9, "color", None)], c.namespace.schema)
    other.tags = spark.createDataFrame([(1, "female", 8, 1), (2, "large", 8, 1), (3, "red", 9, 1)], c.tags.schema)
    other.files = spark.createDataFrame([(1, "eeeeeeee", "jpg", 1, 3), (2, "aaaaaaaa", "jpg", 1, 3)], c.files.schema)
    other.rel = spark.createDataFrame([(1, 1, 8), (1, 2, 8), (2, 3, 9), (2, 1, 8)], REL)
    other.parents = spark.createDataFrame([(1, 2, None)], c.parents.schema)
    m = ingest.merge(c, other)
    assert rows(m.tags.filter("id > 4").select("id", "name", "count")) == [(5, "female", 2), (6, "large", 1)]
    assert (5, 6, None) in rows(m.parents) and m.rel.count() == 6 + 3 and m.files.count() == 5


def test_audit_and_policy(c, spark, rows):
    old, new = (spark.createDataFrame(x, "id long, v string") for x in ([(1, "a"), (2, None), (3, "x")], [(1, "b"), (2, None), (4, None)]))
    assert rows(audit.diff(old, new, ["id"], ["v"])) == [(1, "update"), (3, "delete"), (4, "create")]
    assert audit.backfill(c.files, c.tags, c.rel, 5).count() == 4 + 4 + 6
    hits = spark.createDataFrame([(1,), (2,), (3,), (9,)], "file_id long")
    assert found(policy.permitted(c, hits, [".JPG", "png"], ["SQUARE"], ["round", "Red"])) == [1]
    assert sorted(found(policy.permitted(c, hits))) == [1, 2, 3]


def test_snapshot_round_trip(c, spark, rows, tmp_path):
    c.write(str(tmp_path))
    back = TagCatalog.from_parquet(spark, str(tmp_path))
    assert rows(back.rel) == rows(c.rel) and rows(back.files) == rows(c.files)
    plan = back.rel.filter("namespace = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan


def test_queries_on_edges_give_whole_tables(spark, rows, monkeypatch):
    from tagloom.plans import graph_queries as g

    whole = TagCatalog.empty(spark)
    whole.namespace = spark.createDataFrame([(1, "color", None)], "id long, name string, description string")
    whole.tags = spark.createDataFrame([(i, f"t{i}", 1, 1) for i in [*range(1, 13), 150, 151]], "id long, name string, namespace long, count long")
    whole.rel = spark.createDataFrame([(1, 3, 1), (7, 3, 1), (19, 4, 1), (50, 1, 1)], REL)
    whole.files = spark.createDataFrame([(i, f"h{i}", "x", 1, 1) for i in (1, 7, 19, 50)], "id long, hash string, extension string, storage_id long, size_bytes long")
    whole.parents = spark.createDataFrame([(2, 3, None)], "tag_id long, relate_tag_id long, limit_to long")
    monkeypatch.setattr(g, "catalog", lambda spark, d: whole)
    monkeypatch.setattr(g, "_actions", lambda spark, d: action(spark, [(1, "Add", [("t4", "color", "Normal")]), (19, "Del", [("t4", "color", "Normal")])]))
    assert rows(g.QUERIES["apply_actions_all"](spark, "")) == [(1, 3), (1, 4), (50, 1), (7, 3)]
    assert rows(g.QUERIES["put_tags_all"](spark, "")) == [(1, 3), (1, 4), (19, 4), (50, 1), (7, 3)]
    assert rows(g.QUERIES["rel_add_all"](spark, "")) == sorted({(1, 3), (7, 3), (19, 4)} | {(f, t) for f in (1, 7, 19, 50) for t in (1, 2)}, key=repr)
    assert rows(g.QUERIES["chunk_by_10_all"](spark, "")) == [(0, "1,3,4,5,6,7,8,9,10,11"), (1, "12,150,151")]


def test_groups_of_names_and_ids(spark):
    """Required, alternative and excluded tags by id and by name, of which one name is held in two namespaces."""
    out = TagCatalog.empty(spark)
    out.namespace = spark.createDataFrame([(1, "n", None), (2, "e6", None), (3, "e6ai", None)], "id long, name string, description string")
    out.tags = spark.createDataFrame([(1, "required", 1, 3), (2, "female", 2, 1), (3, "female", 3, 2), (4, "excluded", 1, 1), (5, "ΟΔΟΣ", 1, 1)], "id long, name string, namespace long, count long")
    out.rel = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 3, 3), (3, 4, 1), (4, 3, 3), (4, 5, 1)], REL)
    by = lambda **k: found(search.search_by_groups(out, **k))
    assert by(and_ids=[1], and_names=["female"], not_ids=[4]) == [2]
    assert by(and_names=["female"]) == [4, 3, 2] and by(and_names=["female"], limit=1) == [4]
    assert by(and_names=["female", "nothing like it"]) == by(and_names=["?!"]) == by() == by(or_names=["nothing like it"]) == []
    assert by(or_ids=[5], or_names=["nothing like it"]) == [4] and by(or_ids=[2, 5]) == [4, 2]
    assert by(or_names=["female"], not_names=["excluded", "nothing like it"]) == [4, 2]
    assert by(and_names=["οδος"]) == by(and_names=["ΟΔΟΣ"]) == [4]
    files = spark.createDataFrame([(i, f"h{i}", "jpg" if i < 4 else "png", 1, 1) for i in (1, 2, 3, 4)], "id long, hash string, extension string, storage_id long, size_bytes long")
    out.files = files
    assert found(policy.search(out, "female", policy.Policy([".JPG"], deny=["Excluded"]))) == [2]
    assert found(policy.search(out, "female", policy.Policy(["jpg"], deny=["excluded"], limit=2))) == []
    assert sorted((r.file_id, r.tag_id) for r in policy.file_tag_ids(out, [2, 3], policy.Policy(deny=["excluded"])).collect()) == [(2, 1), (2, 2)]
    assert {(r.file_id, r["name"], r.ns) for r in policy.file_tags(out, [2, 3, 9], policy.Policy(require=["female"], deny=["excluded"])).collect()} == {(2, "required", "n"), (2, "female", "e6")}


def test_names_beyond_ascii_find_themselves(spark):
    tags = spark.createDataFrame([(1, "ΟΔΟΣ", 1), (2, "हिन्दी", 1), (3, "İzmir", 1), (4, "ภาษาไทย", 1), (5, None, 1)], "id long, name string, count long")
    for i, q in ((1, "ΟΔΟΣ"), (1, "οδο"), (2, "हिन्दी"), (2, "हिन"), (3, "İzm"), (4, "ภาษา")):
        assert [(r.tag_id, r.score) for r in textsearch.search_tags(tags, q).collect()] == [(i, 0)], q


def test_closure_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(100, 0)], "a long, b long").coalesce(1)
    assert hierarchy.closure(df.filter("a < 40"), "a", "b").count() == 40 * 41 // 2


def test_trees(spark, rows):
    nodes = spark.createDataFrame([("r", None, "root", "top"), ("a", "r", "folder", "a"), ("f", "a", "file", "x"), ("g", "r", "file", "y"), ("h", "f", "file", "z"), ("o", "gone", "file", "o"), ("c", "d", "folder", "c"), ("d", "c", "folder", "d")], "handle string, parent string, kind string, name string")
    top = lambda *h: spark.createDataFrame([(x,) for x in h], "handle string")
    assert rows(trees.files_below(nodes, top("r", "g", "c", "zz"))) == [("g", "g"), ("r", "f"), ("r", "g")]
    assert rows(trees.paths(nodes)) == [("a", "top/a"), ("f", "top/a/x"), ("g", "top/y"), ("h", "top/a/x/z"), ("o", "o"), ("r", "top")]
    full = nodes.withColumns({"size": F.lit(1), "created": F.lit(None).cast("long"), "modified": F.lit(5)})
    assert rows(trees.metadata_tags(full, "s").filter("handle = 'g'").select("ns", "name")) == [("handle", "g"), ("modified", "5"), ("name", "y"), ("parent", "r"), ("path", "top/y"), ("size", "1"), ("snapshot", "s")]


def test_queue_of_system_jobs(spark, rows):
    j = spark.createDataFrame([(1, 1, 1, 1, True, '{"kind":"AlwaysTime","interval":7,"count":1}', "SYSTEM_X", "p", "u"), (2, 1, 1, 1, True, '{"kind":"AlwaysTime","interval":7,"count":0}', "a", "p", "u"), (3, 1, 1, 1, True, '{"kind":"AlwaysTime","interval":9}', "a", "p", "u"), (4, 1, 1, 1, True, None, "SYSTEM_FILE_HASH", "p", "u"), (5, 1, 1, 1, True, None, "SYSTEM_X", None, "u"), (6, 1, 1, 1, True, None, None, "x", "u")], "id long, time long, reptime long, priority long, is_running boolean, recreation string, site string, param string, user_data string")
    assert [r[0] for r in rows(jobs.is_system(j).filter("system"))] == [1, 4]
    done = j.filter("id < 5").select("id")
    assert rows(jobs.completed(j, done, 50).select("id", "time", "reptime", "is_running")) == [(1, 50, 7, False), (3, 50, 9, False), (5, 1, 1, True), (6, 1, 1, True)]
    assert rows(jobs.completed(jobs.completed(j, done, 50), done, 60).select("id")) == [(3,), (5,), (6,)]
    assert rows(jobs.running(jobs.reset(j), [4]).filter("is_running").select("id")) == [(4,)]
    assert rows(jobs.sites(j)) == [("SYSTEM_FILE_HASH",), ("SYSTEM_X",), ("a",)]


def test_bitmaps_that_change(spark):
    row = lambda *ids: spark.createDataFrame([(i, 1, 1) for i in ids], REL)
    b = bitmaps.add_members(bitmaps.to_bitmaps(row(1, 2, 70_000)), row(2, 3, 200_000))
    assert bitmaps.cardinality(b).first().n == 5
    left = bitmaps.remove_members(b, row(70_000, 3, 4, 900_000))
    assert bitmaps.cardinality(left).first().n == 3 and left.count() == 2


def test_files_are_updated(spark, rows):
    files = spark.createDataFrame([(1, "a", "x", 1, 5), (2, "b", "x", 1, None)], "id long, hash string, extension string, storage_id long, size_bytes long")
    new = spark.createDataFrame([(2, None, "y", 3), (9, "c", "z", 1), (None, "c", "z", 1)], "id long, hash string, extension string, storage_id long")
    assert rows(ingest.update_files(files, new)) == [(1, "a", "x", 1, 5), (2, None, "y", 3, None)]


def test_only_touched_namespaces_are_written(c, spark, rows, tmp_path):
    import os
    import time

    root = str(tmp_path / "g")
    c.write_edges(root)
    seen = lambda: {f"{p}/{f}": os.path.getmtime(f"{p}/{f}") for p, _, fs in os.walk(f"{root}/rel") for f in fs if f.startswith("part-")}
    before = seen()
    time.sleep(0.02)
    ns = c.rel.select("namespace").orderBy("namespace").first().namespace
    edges = spark.read.parquet(f"{root}/rel")
    gone = edges.filter((F.col("namespace") == ns) & (F.col("file_id") > 1))
    c.replace_namespaces(root, gone, gone.select("namespace"))
    want = rows(c.rel.filter(f"namespace <> {ns} or file_id > 1").select("file_id", "tag_id"))
    assert rows(spark.read.parquet(f"{root}/rel").select("file_id", "tag_id")) == want
    kept = {p: t for p, t in before.items() if f"namespace={ns}/" not in p}
    assert kept and all(seen().get(p) == t for p, t in kept.items())
