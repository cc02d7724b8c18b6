"""Tags out of posts and threads as sites deliver them in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTS = (
    "posts ARRAY<STRUCT<id: BIGINT, rating: STRING, description: STRING, sources: ARRAY<STRING>, pools: ARRAY<BIGINT>, relationships: STRUCT<parent_id: BIGINT, children: ARRAY<BIGINT>>, "
    "tags: MAP<STRING, ARRAY<STRING>>, file: STRUCT<md5: STRING, url: STRING, ext: STRING>>>"
)


def posts(df: DataFrame, body: str) -> DataFrame:
    """One row per post of each document's ``posts``; what can't be read as JSON has none."""
    return df.select(F.explode(F.from_json(body, POSTS)["posts"]).alias("p")).select("p.*")


def post_tags(posts: DataFrame) -> DataFrame:
    """(id, ns, name) of all that a post says as tags: its categories, rating, sources, pools and relations; empty ones are left out."""
    one = lambda ns, c: F.array(F.struct(F.lit(ns).alias("ns"), c.cast("string").alias("name")))
    many = lambda ns, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(ns).alias("ns"), x.cast("string").alias("name")))
    categories = F.flatten(F.transform(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), lambda x: F.struct(e["key"].alias("ns"), x.alias("name")))))
    everything = F.concat(
        categories, one("rating", F.col("rating")), one("description", F.col("description")), many("source", F.col("sources")), many("pool", F.col("pools").cast("array<string>")),
        one("parent", F.col("relationships.parent_id")), many("child", F.col("relationships.children").cast("array<string>")), one("md5", F.col("file.md5")),
    )
    return posts.select("id", F.inline(everything)).filter("name is not null and name <> ''").distinct()


def pool_positions(pools: DataFrame, key: str, members: str) -> DataFrame:
    """(``key``, position from 0, post_id) of a pool's posts."""
    return pools.select(key, F.posexplode(members).alias("position", "post_id"))


def static_url(base: str, md5: Column, ext: Column) -> Column:
    """Where a file lies by its digest; null unless that is at least four hex digits."""
    return F.when(md5.rlike("^[0-9a-fA-F]{4,}$"), F.concat(F.lit(base + "/"), F.substring(md5, 1, 2), F.lit("/"), F.substring(md5, 3, 2), F.lit("/"), md5, F.lit("."), ext))


def parent_id(text: Column) -> Column:
    """A parent's id, given as number or text; empty and 0 are none."""
    return F.nullif(text.try_cast("long"), F.lit(0).cast("long"))


def list_or_single(body: Column, schema: str) -> Column:
    """A JSON array of objects, or one object as an array of one; null if it is neither."""
    many = F.from_json(body, f"array<struct<{schema}>>")
    return F.when(F.ltrim(body).startswith("["), many).when(F.ltrim(body).startswith("{"), F.array(F.from_json(body, f"struct<{schema}>")))


def catalog_hit(subject: Column, comment: Column, asked: str) -> Column:
    """Does a thread's subject or comment contain the text, whatever its case? `*` takes all."""
    if asked == "*":
        return F.lit(True)
    low = asked.lower()
    return F.coalesce(F.lower(subject).contains(low), F.lit(False)) | F.coalesce(F.lower(comment).contains(low), F.lit(False))


def chapter_order(chapters: DataFrame, key: str, names: str) -> DataFrame:
    """(``key``, chapter, number) of a list with the newest first: numbers count from 1 at its end."""
    return chapters.select(key, F.size(names).alias("_n"), F.posexplode(names).alias("_i", "chapter")).select(key, "chapter", (F.col("_n") - F.col("_i")).alias("number"))


def first_chapter(title: Column) -> Column:
    """Does a title name the first chapter?"""
    low = F.lower(title)
    return low.startswith("1 ") | low.contains(" 1 ") | (low == "1 chapter")


def last_touched(posts: DataFrame) -> DataFrame:
    """(id, at): when a post was edited, else published, else added, the latest of its rows; posts without any time are left out."""
    at = F.coalesce("edited", "published", "added")
    return posts.select("id", at.alias("at")).filter("at is not null").groupBy("id").agg(F.max("at").alias("at"))


def listed_tags(posts: DataFrame, tags: str = "tags") -> DataFrame:
    """(id, tags, position, tag): a post's tags, written between commas or semicolons, with their places."""
    rows = posts.filter(F.col(tags).isNotNull()).select("id", F.col(tags).alias("tags")).distinct()
    return rows.select("id", "tags", F.posexplode(F.split("tags", "[,;]")).alias("position", "tag")).select("id", "tags", "position", F.trim("tag").alias("tag"))


def scoped_comments(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, post_id, commenter, scope): who commented, in the scope of the post's service and user; comments without one are left out."""
    scope = posts.select(F.col("id").alias("post_id"), F.concat_ws("/", "service", "user_id").alias("scope")).distinct()
    return comments.filter("commenter is not null").select("id", "post_id", "commenter").distinct().join(scope, "post_id").select("id", "post_id", "commenter", "scope")


def attachments(rows: DataFrame, key: str, paths: str) -> DataFrame:
    """(``key``, position, path, sha256) of a post's attached files; a name of 64 hex digits is a digest, kept in upper case."""
    each = rows.select(key, F.posexplode(paths).alias("position", "path"))
    digest = F.nullif(F.regexp_extract("path", r"(?i)([0-9a-f]{64})(?:\.[^./]*)?$", 1), F.lit(""))
    return each.select(key, "position", "path", F.upper(digest).alias("sha256"))


def chapter_jobs(series: DataFrame, known: DataFrame, last: int) -> DataFrame:
    """(series, chapter, url) for chapters 1 to ``last`` of each series (series, url) that aren't ``known`` (series, chapter).

    An address of a chapter itself is no series and gives none.
    """
    wanted = series.filter(~F.col("url").contains("/chapter/")).select("series", "url", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(last).cast("long"))).alias("chapter"))
    fresh = wanted.join(known.select("series", F.col("chapter").cast("long").alias("chapter")), ["series", "chapter"], "left_anti")
    return fresh.select("series", "chapter", F.concat_ws("/chapter/", "url", F.col("chapter").cast("string")).alias("url"))


HITS = "results ARRAY<STRUCT<hits: ARRAY<STRUCT<id: BIGINT, user: STRUCT<id: BIGINT, username: STRING, image: STRING>, prompt: STRING, publishedAt: STRING, tagNames: ARRAY<STRING>, baseModel: STRING>>>>"


def hits(df: DataFrame, body: str) -> DataFrame:
    """One row per hit of each document's results; what can't be read as JSON has none."""
    return df.select(F.explode(F.from_json(body, HITS)["results"]).alias("r")).select(F.explode("r.hits").alias("h")).select("h.*")


def hit_tags(hits: DataFrame) -> DataFrame:
    """(id, ns, name) of all that a hit says as tags, its time as epoch seconds; hits without an id have none."""
    one = lambda ns, c: F.array(F.struct(F.lit(ns).alias("ns"), c.cast("string").alias("name")))
    named = F.transform(F.coalesce("tagNames", F.array().cast("array<string>")), lambda x: F.struct(F.lit("tag").alias("ns"), x.alias("name")))
    every = F.concat(
        one("image", F.col("id")), one("user", F.col("user.id")), one("user_name", F.col("user.username")), one("prompt", F.col("prompt")), one("model", F.col("baseModel")),
        one("published", F.unix_seconds(F.try_to_timestamp("publishedAt"))), named,
    )
    return hits.filter("id is not null").select("id", F.inline(every)).filter("name is not null and name <> ''").distinct()
