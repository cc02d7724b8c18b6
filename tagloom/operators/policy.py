"""Which files may be shown."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.catalog import TagCatalog
from tagloom.operators import lookup
from tagloom.operators.search import search_by_groups

#: How many files a search looks at, unless it says so, and at most.
DEFAULT_LIMIT, MOST = 100, 1000


@dataclass
class Policy:
    """Extensions that are allowed (any if there are none), tags that are denied and required, and files a search looks at."""

    extensions: Sequence[str] = ()
    deny: Sequence[str] = ()
    require: Sequence[str] = ()
    limit: int | None = None

    def show(self, c: TagCatalog, files: DataFrame) -> DataFrame:
        return permitted(c, files, self.extensions, self.deny, self.require)


def search(c: TagCatalog, text: str, policy: Policy, limit: int | None = None) -> DataFrame:
    """Files (file_id) with all tags that ``text`` names, word by word, that may be shown.

    The search is cut off first and the rest sieved after, so fewer may be shown than there are: at ``limit``, else at the
    policy's, else at DEFAULT_LIMIT, at MOST in any case.
    """
    cut_off = min(next((n for n in (limit, policy.limit) if n is not None), DEFAULT_LIMIT), MOST)
    return policy.show(c, search_by_groups(c, and_names=text.split(), limit=cut_off))


def file_tag_ids(c: TagCatalog, files: DataFrame | Sequence[int], policy: Policy) -> DataFrame:
    """(file_id, tag_id) of those files asked for that may be shown."""
    shown = policy.show(c, lookup._ids(c.rel, files, "file_id"))
    return c.rel.join(shown, "file_id", "left_semi").select("file_id", "tag_id").distinct()


def file_tags(c: TagCatalog, files: DataFrame | Sequence[int], policy: Policy) -> DataFrame:
    """(file_id, tag_id, name, ns) of those files asked for that may be shown."""
    return lookup.file_tag_objects(c, policy.show(c, lookup._ids(c.rel, files, "file_id")))


def permitted(c: TagCatalog, files: DataFrame, extensions: Sequence[str] = (), deny: Sequence[str] = (), require: Sequence[str] = ()) -> DataFrame:
    """Those of ``files`` (file_id) that exist, have an extension on the list (any if it is empty), no denied tag and all required ones.

    Extensions compare without a leading dot, and like tag names without case.
    """
    exts = [e.lstrip(".").lower() for e in extensions]
    known = c.files.select(F.col("id").alias("file_id"), F.lower("extension").alias("extension"))
    ok = files.join(known.filter(F.col("extension").isin(exts)) if exts else known, "file_id", "left_semi")
    named = c.tags.select(F.col("id").alias("tag_id"), F.lower("name").alias("name"))
    if deny:
        bad = c.rel.join(named.filter(F.col("name").isin([d.lower() for d in deny])), "tag_id", "left_semi").select("file_id")
        ok = ok.join(bad.distinct(), "file_id", "left_anti")
    if require:
        want = sorted({r.lower() for r in require})
        has = c.rel.join(named.filter(F.col("name").isin(want)), "tag_id").groupBy("file_id").agg(F.count_distinct("name").alias("_n")).filter(F.col("_n") == len(want))
        ok = ok.join(has, "file_id", "left_semi")
    return ok
