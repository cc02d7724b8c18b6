"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.llm import cooccurrence, leakage, mixing, pii, similar_sets, vocabulary
from tagloom.llm import sentences as sentence
from tagloom.llm.oracle import SQL  # noqa: F401
from tagloom.operators.snapshots import latest
from tagloom.util import cut, table

#: Fixed values of the queries' definitions.
MIN_TOGETHER, MIN_LIFT = 30, 8
SIMILARITY, MIN_MEMBERS = 0.8, 5
RARE_BELOW, COMMON_SHARE = 5, 0.004


def file_sets(spark, d):
    """Each file's current set of tags."""
    return latest(table(spark, d, "relationship_roaring_fileid"), "fileid", "written_at", "tagid_bitmap")


def p1_found(spark, d):
    pairs = cooccurrence.cooccurrences(file_sets(spark, d), "fileid", "tagid_bitmap", MIN_TOGETHER, MIN_LIFT)
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p1_lift(spark, d):
    """Every pair that files carry together, with its lift as it is and its mutual information to six places."""
    pairs = cooccurrence.cooccurrences(file_sets(spark, d), "fileid", "tagid_bitmap")
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_a", "n_b", "n_ab", "n_baskets", "lift", F.round("pmi", 6).alias("pmi"))


def p1_pairs(spark, d):
    """Every pair that files carry together, be it in one file only, with its count and lift as they are, not rounded."""
    pairs = cooccurrence.cooccurrences(file_sets(spark, d), "fileid", "tagid_bitmap")
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_a", "n_b", "n_ab", "n_baskets", "lift")


def p2_found(spark, d):
    pairs = similar_sets.similar_pairs(file_sets(spark, d), "fileid", "tagid_bitmap", SIMILARITY, MIN_MEMBERS)
    return pairs.select(F.col("a").alias("fileid_a"), F.col("b").alias("fileid_b"))


def p2_between(spark, d):
    """Similar files of two tables: those whose id is divisible by 20 as one, and all others as the other; one row per pair."""
    sets = cut(file_sets(spark, d))
    asked, rest = sets.filter("fileid % 20 = 0"), sets.filter("fileid % 20 <> 0")
    pairs = similar_sets.similar_pairs_between(asked, rest, "fileid", "tagid_bitmap", SIMILARITY, MIN_MEMBERS)
    return pairs.select(F.col("a").alias("fileid"), F.col("b").alias("other"), "n_common", "n_union")


def p2_classes(spark, d):
    """One row per file: its class of equal sets, the class's size, and the number of other classes similar to it."""
    member, classes = similar_sets.set_classes(file_sets(spark, d), "fileid", "tagid_bitmap", MIN_MEMBERS)
    links = similar_sets.similar_classes(classes, SIMILARITY)
    degree = links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    size = member.groupBy("cid").agg(F.count(F.lit(1)).alias("n_copies"))
    return member.join(size.join(degree, "cid", "left"), "cid").select(F.col("record").alias("fileid"), F.col("cid").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _terms(spark, d):
    tags = cut(latest(table(spark, d, "tag_entry"), "tag_id", "loaded_at", "normalized_name", "count"))
    total = tags.agg(F.sum("count")).first()[0] or 0
    return vocabulary.mark_terms(vocabulary.term_counts(tags, vocabulary.normal_form(F.col("normalized_name")), F.col("tag_id"), F.col("count")), total, RARE_BELOW, COMMON_SHARE)


def p4_found(spark, d):
    return _terms(spark, d).filter("mark is not null").select(F.col("term").alias("normalized_name"), "mark")


def p4_terms(spark, d):
    """Every name with its total count, the tags that bear it, and its mark."""
    return _terms(spark, d).select(F.col("term").alias("normalized_name"), "total", F.col("n_records").alias("n_tags"), "mark")


def p5_redacted(spark, d):
    """Every post and comment with its items, and with placeholders in their place."""
    rows = [table(spark, d, t).select(F.lit(t).alias("tbl"), "id", "content") for t in ("post_item", "comment_item")]
    return pii.find_pii(rows[0].unionByName(rows[1]), "content", ["tbl", "id"])


def p5_found(spark, d):
    return p5_redacted(spark, d).select("tbl", "id", F.explode(F.transform("items", lambda x: x["kind"])).alias("kind")).distinct()


def _passages(spark, d, max_edits):
    return leakage.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", max_edits)


def p6_found(spark, d):
    """Unchanged passages only: at no edits one embedding finds them all."""
    return leakage.leaks(_passages(spark, d, 0)).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_leaks(spark, d):
    """Every document and item with a passage in common, changed by up to two edits or not."""
    return leakage.leaks(_passages(spark, d, 2)).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_places", "edits")


def _mixed(spark, d):
    docs = mixing.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"), "text")
    return mixing.mixture(docs, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"))


def p7_mixture(spark, d):
    return _mixed(spark, d)[0]


def p7_shares(spark, d):
    return _mixed(spark, d)[1]


def p7_sources(spark, d):
    """The report of the mixture without what hangs on the tokenizer: targets by their own spelling, limits, and documents of each."""
    rows = _mixed(spark, d)[1].join(F.broadcast(_with_text(spark, d)), "source", "left")
    return rows.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", (F.col("n_docs") - F.coalesce("n", F.lit(0))).alias("docs_missing"), (F.col("mixed_tokens") > 0).alias("mixed"))


def _with_text(spark, d):
    docs = table(spark, d, "documents").filter("text <> '' and doc_id is not null")
    return docs.groupBy(mixing.source_key(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def p8_coverage(spark, d):
    """How many characters that aren't white space each document's sentences hold, together: all of the text's, none of them twice."""
    rows = sentence.sentences(table(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", r"(?U)\s", ""))).alias("n_chars"), F.bool_and(F.col("sentence") == F.regexp_replace("sentence", r"(?U)^\s+|\s+$", "")).alias("bare"))


def p8_found(spark, d):
    return sentence.sentences(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "start_char", "end_char")


def p8_sentences(spark, d):
    """Every sentence itself."""
    return sentence.sentences(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_lift, p1_pairs, p2_found, p2_classes, p2_between, p4_found, p4_terms, p5_found, p5_redacted, p6_found, p6_leaks, p7_mixture, p7_shares, p7_sources, p8_found, p8_sentences, p8_coverage)}
