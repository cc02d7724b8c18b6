"""Search for tags by text, forgiving typing errors."""

from __future__ import annotations

from collections.abc import Sequence

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids that a name stands for in a search.
NAME_MATCHES = 100


_REST = regex.compile(r"[^\p{Alphabetic}\p{N}]")


def normalize_text(text: str) -> str:
    """Alphabetic characters (vowel signs of Indic scripts among them) and numbers only, each lowered by itself."""
    return "".join(ch.lower() for ch in _REST.sub("", text))


def normalized(c: Column) -> Column:
    """The same of a column; a capital sigma is lowered by hand, as ``lower`` looks at where it stands in the word."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", ""), "Σ", "σ"))


def allowed_distance(query: str) -> int:
    """Edits that a query may be away, by its length in bytes."""
    n = len(query.encode())
    return 1 if n <= 4 else 2 if n <= 8 else 3


def allowed_for(query: Column) -> Column:
    """The same of a column of queries."""
    n = F.octet_length(query)
    return F.when(n <= 4, 1).when(n <= 8, 2).otherwise(3)


def match_score(query: Column, name: Column, distance: Column | int) -> Column:
    """0 if the name starts with the query, 1 if it contains it, edits + 2 within ``distance``, else null."""
    d = F.lit(distance) if isinstance(distance, int) else distance
    edits = F.levenshtein(query, name)
    near = (F.abs(F.char_length(query) - F.char_length(name)) <= d) & (edits <= d)
    return F.when(name.startswith(query), 0).when(name.contains(query), 1).when(near, edits + 2)


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    n = F.char_length(c)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def shared_bigrams_needed(query: str) -> int:
    """How many distinct bigrams a name within reach of the query shares with it at least; 0 if none need be."""
    d = allowed_distance(query)
    return max(1, len(query) - 1 - 2 * d) if query.isascii() and len(query) > 2 * d else 0


def bigram_candidates(tags: DataFrame, query: str) -> DataFrame:
    """Tags that can be a match, with the number of bigrams shared: (id, name, shared).

    A name is one if it isn't shorter than the query in bytes and shares enough distinct bigrams, or contains the query.
    """
    q = normalize_text(query)
    name = normalized(F.col("name"))
    mine = F.array(*[F.lit(x) for x in sorted({q[i:i + 2] for i in range(len(q) - 1)})]) if len(q) > 1 else F.array().cast("array<string>")
    shared = F.size(F.array_intersect(bigrams(name), mine))
    rows = tags.filter(F.col("name").isNotNull()).select("id", name.alias("name"), shared.alias("shared"))
    return rows.filter((F.octet_length("name") >= len(q.encode())) & ((F.col("shared") >= shared_bigrams_needed(q)) | F.col("name").contains(q)))


def search_tags(tags: DataFrame, query: str, limit: int = 10, prefilter: bool = True) -> DataFrame:
    """The best matches of a text: (tag_id, count, score), by score, then the greater count, then the smaller id.

    A query without letters or digits, or a limit of 0, gives nothing; tags without a name match nothing. Only ``limit`` rows
    leave each task.
    """
    q = normalize_text(query)
    if not q or limit <= 0:
        return tags.select(F.col("id").alias("tag_id"), "count", F.lit(0).alias("score")).limit(0)
    rows = tags.filter(F.col("name").isNotNull()).select("id", "count", normalized(F.col("name")).alias("_n"))
    if prefilter:
        rows = rows.filter(_reachable(q))
    scored = rows.select(F.col("id").alias("tag_id"), "count", match_score(F.lit(q), F.col("_n"), allowed_distance(q)).alias("score"))
    return scored.filter("score is not null").orderBy("score", F.desc("count"), "tag_id").limit(limit)


def _reachable(q: str) -> Column:
    mine = F.array(*[F.lit(x) for x in sorted({q[i:i + 2] for i in range(len(q) - 1)})]) if len(q) > 1 else F.array().cast("array<string>")
    need = shared_bigrams_needed(q)
    enough = F.size(F.array_intersect(bigrams(F.col("_n")), mine)) >= need if need else F.lit(True)
    return (F.octet_length("_n") >= len(q.encode())) & (F.col("_n").contains(q) | enough)


def fts_terms(query: str) -> list[str]:
    """Terms that a trigram index is asked for: the whole text, its words, and each word with two neighbours swapped."""
    terms = set()
    joined = normalize_text(query)
    if len(joined) >= 3:
        terms.add(joined)
    for w in query.split():
        w = normalize_text(w)
        if len(w) >= 3:
            terms.add(w)
            terms |= {w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)}
    return sorted(terms)


def fts_candidates(tags: DataFrame, query: str) -> DataFrame:
    """Tags whose name contains one of the query's terms: (id, name, count)."""
    terms = fts_terms(query)
    if not terms:
        return tags.select("id", "name", "count").limit(0)
    low = F.lower("name")
    hit = F.lit(False)
    for t in terms:
        hit = hit | low.contains(t)
    return tags.filter(hit).select("id", "name", "count")


def resolve_names(tags: DataFrame, names: Sequence[str]) -> list[list[int]]:
    """For each name the ids it may stand for, NAME_MATCHES at most, all in one pass; a name without letters or digits stands for none."""
    asked = {i: q for i, q in enumerate(map(normalize_text, names)) if q}
    if not asked:
        return [[] for _ in names]
    rows = tags.filter(F.col("name").isNotNull()).select("id", "count", normalized(F.col("name")).alias("_n"))
    scores = [F.struct(F.lit(i).alias("i"), F.when(_reachable(q), match_score(F.lit(q), F.col("_n"), allowed_distance(q))).alias("score")) for i, q in asked.items()]
    scored = rows.select("id", "count", F.inline(F.array(*scores))).filter("score is not null")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("score", F.desc("count"), "id"))
    found: list[list[int]] = [[] for _ in names]
    for r in scored.withColumn("_rank", rank).filter(F.col("_rank") <= NAME_MATCHES).orderBy("i", "_rank").select("i", "id").collect():
        found[r.i].append(r.id)
    return found


def same_names(tags: DataFrame) -> DataFrame:
    """Names that several ids hold under one spelling: (name, n_ids, first_id)."""
    names = tags.filter(F.col("name").isNotNull()).select("id", normalized(F.col("name")).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("first_id")).filter("n_ids > 1")


def popular(tags: DataFrame, least: int = 5) -> DataFrame:
    """Tags with ``least`` files or more: (id, name, count)."""
    return tags.filter(F.col("count") >= least).select("id", "name", "count")


def scan_tags(tags: DataFrame, pattern: str | None = None, text: str | None = None, allow: Sequence[int] = (), deny: Sequence[int] = ()) -> DataFrame:
    """Every match in tag names: (tag_id, name, match), all of a pattern, or the first of a plain text.

    Tags of a namespace in ``deny`` are left out, then those outside ``allow`` unless it is empty.
    """
    rows = tags.filter(F.col("name").isNotNull())
    if deny:
        rows = rows.filter(~F.col("namespace").isin(list(deny)))
    if allow:
        rows = rows.filter(F.col("namespace").isin(list(allow)))
    if text is not None:
        return rows.filter(F.col("name").contains(text)).select(F.col("id").alias("tag_id"), "name", F.lit(text).alias("match"))
    return rows.select(F.col("id").alias("tag_id"), "name", F.explode(F.regexp_extract_all("name", F.lit(pattern), F.lit(0))).alias("match"))


def queued_matches(tags: DataFrame, pattern: str, site: str, priority: int = 5) -> tuple[DataFrame, DataFrame]:
    """Jobs for all that a pattern finds in tag names (site, param, priority), each once, and which tag each comes from (tag_id, param)."""
    found = scan_tags(tags, pattern=pattern).select("tag_id", F.col("match").alias("param")).filter("param <> ''").distinct()
    return found.select(F.lit(site).alias("site"), "param", F.lit(priority).cast("long").alias("priority")).distinct(), found
