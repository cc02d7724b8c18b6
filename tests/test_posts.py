import json

import pytest
from pyspark.sql import functions as F

from tagloom.functions import content, extract, posts
from tagloom.operators import search, settings
from tagloom.plans.registry import Registry

BODY = {"posts": [
    {"id": 1, "rating": "s", "description": "", "sources": ["u", None], "pools": [7], "relationships": {"parent_id": 5, "children": [8, 9]}, "tags": {"general": ["a", "b", "a"], "artist": []}, "file": {"md5": "abcd", "url": None, "ext": "png"}},
    {"id": 2},
]}


def test_post_tags(spark, rows):
    df = spark.createDataFrame([(json.dumps(BODY),), ("not json",), (None,), ("{}",), ('{"posts": []}',)], "body string")
    p = posts.posts(df, "body")
    assert p.count() == 2
    assert rows(posts.post_tags(p)) == [(1, "child", "8"), (1, "child", "9"), (1, "general", "a"), (1, "general", "b"), (1, "md5", "abcd"), (1, "parent", "5"), (1, "pool", "7"), (1, "rating", "s"), (1, "source", "u")]
    assert rows(posts.post_tags(p.limit(0))) == []


def test_small_helpers(spark, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["12", "0", "", "x", None])], "i int, x string")
    assert [r.p for r in df.orderBy("i").select(posts.parent_id(F.col("x")).alias("p")).collect()] == [12, None, None, None, None]
    one = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"a":3}',), ("x",), (None,)], "b string")
    assert [len(r.l) if r.l is not None else None for r in one.select(posts.list_or_single(F.col("b"), "a: int").alias("l")).collect()] == [2, 1, None, None]
    hit = lambda q: [r.h for r in spark.createDataFrame([("Old Castle", None), (None, "x"), (None, None)], "s string, c string").select(posts.catalog_hit(F.col("s"), F.col("c"), q).alias("h")).collect()]
    assert hit("castle") == [True, False, False] and hit("*") == [True] * 3
    titles = spark.createDataFrame([("1 a",), ("Vol 1 b",), ("1 Chapter",), ("11 a",)], "t string")
    assert [r.f for r in titles.select(posts.first_chapter(F.col("t")).alias("f")).collect()] == [True, True, True, False]
    ch = spark.createDataFrame([(1, ["c", "b", "a"]), (2, [])], "id long, n array<string>")
    assert rows(posts.chapter_order(ch, "id", "n")) == [(1, "a", 1), (1, "b", 2), (1, "c", 3)]
    assert [tuple(x) for x in spark.createDataFrame([("a https://b.c/d  http://",)], "t string").select(extract.params(F.col("t")).alias("p")).first().p] == [("Normal", "a"), ("Url", "https://b.c/d"), ("Normal", "http://")]
    assert spark.range(1).select(content.thumbnail_path("t", F.lit("x").cast("binary"))).first()[0].startswith("t/2D/71/16/2D711642B726")


def test_settings(spark, rows):
    have = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "z")], "name string, num long, param string")
    new = spark.createDataFrame([("a", None, "y"), ("a", None, "y"), (None, 9, "w"), ("c", 1, None)], have.schema)
    assert rows(settings.put(have, new, ["name"])) == [("a", None, "y"), ("b", 2, None), ("c", 1, None), (None, 9, "w")]
    assert rows(settings.put(have, new.limit(0), ["name"])) == rows(have)
    urls = spark.createDataFrame([("u",)], "url string")
    assert rows(settings.put(urls, urls.unionByName(spark.createDataFrame([("v",), ("v",)], urls.schema)), ["url"])) == [("u",), ("v",)]
    loc = spark.createDataFrame([(3, "x")], "id long, location string")
    assert rows(settings.get_or_create(loc, spark.createDataFrame([("z",), ("x",), ("y",), (None,), ("y",)], "location string"), "location")) == [(3, "x"), (4, "y"), (5, "z")]
    h = spark.createDataFrame([(1, "MD5", "a")], "file_id long, algorithm string, digest string")
    assert rows(settings.add_digests(h, spark.createDataFrame([(1, "MD5", "b"), (2, "MD5", ""), (3, "MD5", "c"), (3, "MD5", "c")], h.schema))) == [(1, "MD5", "a"), (3, "MD5", "c")]


def test_membership(spark, rows):
    rel = spark.createDataFrame([(1, 1, 1), (1, 1, 1)], "file_id long, tag_id long, namespace long")
    assert rows(search.has_edges(rel, spark.createDataFrame([(1, 1), (1, 2), (1, 1), (None, 1)], "file_id long, tag_id long"))) == [(1, 1, True), (1, 2, False)]


def test_registry(spark, rows):
    r = Registry()
    r.add("fan_out", "pages", lambda df: df.select("job", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("page")))
    r.add("fan_out", "single", lambda df: df.select("job"))
    jobs = spark.createDataFrame([(1, "pages"), (2, "single"), (3, "other")], "job long, site string")
    assert rows(r.run("fan_out", jobs, "site").select("job", "page", "site")) == [(1, 1, "pages"), (1, 2, "pages"), (2, None, "single")]
    assert r.run_all("fan_out", jobs).count() == 9
    with pytest.raises(ValueError):
        r.add("fan_out", "pages", lambda df: df)
    with pytest.raises(ValueError):
        r.run("parse", jobs, "site")


def test_attachments_hits_and_chapters(spark, rows):
    d = "ab" * 32
    df = spark.createDataFrame([(1, [f"/x/{d}.png", "/x/y.zip"]), (2, None)], "id long, p array<string>")
    assert rows(posts.attachments(df, "id", "p").select("id", "position", "sha256")) == [(1, 0, d.upper()), (1, 1, None)]
    body = '{"results":[{"hits":[{"id":5,"user":{"id":7},"publishedAt":"2024-01-01T00:00:00.000Z","tagNames":["a",""]},{"user":{"id":8}}]}]}'
    got = posts.hit_tags(posts.hits(spark.createDataFrame([(body,), ("no",), (None,)], "b string"), "b"))
    assert rows(got.select("ns", "name")) == [("image", "5"), ("published", "1704067200"), ("tag", "a"), ("user", "7")]
    series = spark.createDataFrame([("s", "https://x/s"), ("t", "https://x/t/chapter/2")], "series string, url string")
    known = spark.createDataFrame([("s", 2)], "series string, chapter int")
    assert rows(posts.chapter_jobs(series, known, 3).select("chapter", "url")) == [(1, "https://x/s/chapter/1"), (3, "https://x/s/chapter/3")]
