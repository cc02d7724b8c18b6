"""Boolean search for files by their tags."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.catalog import TagCatalog
from tagloom.operators import textsearch

#: Up to so many ids a search is part of the scan's own filter; beyond, a table of ids is joined.
INLINE_IDS = 500


@dataclass
class SearchSpec:
    """All of ``all_of``, at least one of each group of ``any_of``, and none of ``none_of``."""

    all_of: Sequence[int] = ()
    any_of: Sequence[Iterable[int]] = field(default_factory=list)
    none_of: Sequence[int] = ()

    def groups(self) -> list[list[int]]:
        return [[t] for t in sorted(set(self.all_of))] + [sorted(set(g)) for g in self.any_of if list(g)]


def search_files(rel: DataFrame, spec: SearchSpec, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Files that match: (file_id), the greatest ids first.

    One pass: edges of the ids searched for are grouped by file, each group of ids becoming one flag that is combined on the
    map side. An empty search gives nothing, an empty group asks for nothing, an id without edges makes its group fail. A
    search that only excludes gives files that have some tag. Edges with a null on either side don't count.
    """
    groups, none = spec.groups(), sorted(set(spec.none_of))
    edges = rel.filter("file_id is not null and tag_id is not null")
    spark = rel.sparkSession
    if not groups and not none:
        found = edges.select("file_id").limit(0)
    elif not groups:
        banned = edges.filter(F.col("tag_id").isin(none)).select("file_id").distinct()
        found = edges.select("file_id").distinct().join(banned, "file_id", "left_anti")
    elif sum(map(len, groups)) + len(none) <= INLINE_IDS:
        ids = sorted({t for g in groups for t in g} | set(none))
        flags = [F.bool_or(F.col("tag_id").isin(g)).alias(f"_g{i}") for i, g in enumerate(groups)]
        flags.append((F.bool_or(F.col("tag_id").isin(none)) if none else F.bool_or(F.lit(False))).alias("_bad"))
        wanted = ~F.col("_bad")
        for i in range(len(groups)):
            wanted = wanted & F.col(f"_g{i}")
        found = edges.filter(F.col("tag_id").isin(ids)).groupBy("file_id").agg(*flags).filter(wanted).select("file_id")
    else:
        rows = [(i, t) for i, g in enumerate(groups) for t in g] + [(-1, t) for t in none]
        hits = edges.join(spark.createDataFrame(rows, "_g int, tag_id long"), "tag_id")
        per_file = hits.groupBy("file_id").agg(F.count_distinct(F.when(F.col("_g") >= 0, F.col("_g"))).alias("_n"), F.bool_or(F.col("_g") < 0).alias("_bad"))
        found = per_file.filter((F.col("_n") == len(groups)) & ~F.col("_bad")).select("file_id")
    ordered = found.orderBy(F.desc("file_id"))
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(min(limit, 2**31 - 1))


def search_by_groups(
    c: TagCatalog, and_ids: Sequence[int] = (), and_names: Sequence[str] = (), or_ids: Sequence[int] = (), or_names: Sequence[str] = (),
    not_ids: Sequence[int] = (), not_names: Sequence[str] = (), limit: int | None = None,
) -> DataFrame:
    """Files with all of the first ids and names, one of the second, and none of the third: (file_id), the greatest ids first.

    A name stands for all tags that it finds, and is met by any of them. A required name that finds nothing gives no file, so
    do alternatives with names if neither they nor the ids beside them are any; an excluded name that finds nothing is
    left out. A search for nothing gives nothing.
    """
    found = iter(textsearch.resolve_names(c.tags, [*and_names, *or_names, *not_names]))
    must, some, never = ([next(found) for _ in names] for names in (and_names, or_names, not_names))
    either = [*or_ids, *(i for ids in some for i in ids)]
    if not all(must) or or_names and not either:
        return search_files(c.rel, SearchSpec())
    groups = [*must, either] if either else must
    return search_files(c.rel, SearchSpec(and_ids, groups, [*not_ids, *(i for ids in never for i in ids)]), limit)


def has_edges(rel: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (file_id, tag_id) with ``present``: is there such an edge? Of the edges only those asked for go on from the scan."""
    asked = pairs.select("file_id", "tag_id").filter("file_id is not null and tag_id is not null").distinct()
    known = rel.select("file_id", "tag_id").join(asked, ["file_id", "tag_id"], "left_semi").distinct().withColumn("_e", F.lit(True))
    return asked.join(known, ["file_id", "tag_id"], "left").select("file_id", "tag_id", F.col("_e").isNotNull().alias("present"))


def file_count_by_tag(rel: DataFrame) -> DataFrame:
    """Distinct files of each tag: (tag_id, count)."""
    return rel.groupBy("tag_id", "file_id").agg(F.lit(1)).groupBy("tag_id").agg(F.count("file_id").alias("count"))


def rarest_first(tags: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The tags asked for, rarest first: (id, count, rank)."""
    from pyspark.sql import Window

    return tags.filter(F.col("id").isin(list(ids))).select("id", "count", F.row_number().over(Window.orderBy("count", "id")).alias("rank"))


class SearchQuery:
    """A search put together step by step, with pages: unknown tags can be ignored, an AND goes before an OR."""

    def __init__(self, ignore_unknown: bool = True):
        self._and: list[int] = []
        self._or: list[int] = []
        self._offset, self._limit, self._ignore = 0, None, ignore_unknown

    def all_of(self, *ids: int) -> SearchQuery:
        self._and += ids
        return self

    def any_of(self, *ids: int) -> SearchQuery:
        self._or += ids
        return self

    def page(self, offset: int = 0, limit: int | None = None) -> SearchQuery:
        self._offset, self._limit = offset, limit
        return self

    def run(self, rel: DataFrame) -> DataFrame:
        ids = self._and
        if self._and and self._ignore:
            known = {r.tag_id for r in rel.filter(F.col("tag_id").isin(self._and)).select("tag_id").distinct().collect()}
            ids = [t for t in self._and if t in known]
        spec = SearchSpec(all_of=ids) if self._and else SearchSpec(any_of=[self._or])
        return search_files(rel, spec, self._limit, self._offset)
