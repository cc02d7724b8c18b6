"""Queries on keys that hold most of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators.skew import distinct_members, exact_quantiles, heavy_keys
from tagloom.util import table

#: A tag is heavy from this share of all rows on.
HEAVY_SHARE = 0.02
PROBS = (0.1, 0.5, 0.9)


def p3_found(spark, d):
    return heavy_keys(table(spark, d, "relationship_roaring_tagid"), "tagid", HEAVY_SHARE).select("tagid")


def p3_files_per_tag(spark, d):
    return distinct_members(table(spark, d, "relationship_roaring_tagid"), "tagid", "fileid_bitmap", HEAVY_SHARE).withColumnRenamed("n_members", "n_files")


def p3_file_quantiles(spark, d):
    files = table(spark, d, "relationship_roaring_tagid").select("tagid", F.explode("fileid_bitmap").alias("fileid")).filter("tagid is not null")
    return exact_quantiles(files, ["tagid"], "fileid", PROBS)


QUERIES = {"p3_found": p3_found, "p3_files_per_tag": p3_files_per_tag, "p3_file_quantiles": p3_file_quantiles}

SQL = {
    "p3_found": "SELECT tagid FROM relationship_roaring_tagid GROUP BY tagid HAVING tagid IS NOT NULL AND count(*) * 50 >= (SELECT count(*) FROM relationship_roaring_tagid)",
    "p3_files_per_tag": """
WITH r AS (SELECT tagid, count(*) AS n_rows FROM relationship_roaring_tagid WHERE tagid IS NOT NULL GROUP BY tagid),
f AS (SELECT tagid, count(DISTINCT m) AS n FROM (SELECT tagid, unnest(fileid_bitmap) AS m FROM relationship_roaring_tagid) GROUP BY tagid)
SELECT r.tagid, r.n_rows, coalesce(f.n, 0) AS n_files, r.n_rows * 50 >= (SELECT count(*) FROM relationship_roaring_tagid) AS heavy
FROM r LEFT JOIN f ON r.tagid = f.tagid""",
    "p3_file_quantiles": """
WITH m AS (SELECT tagid, unnest(fileid_bitmap) AS fileid FROM relationship_roaring_tagid WHERE tagid IS NOT NULL),
o AS (SELECT tagid, fileid, row_number() OVER (PARTITION BY tagid ORDER BY fileid) AS rk, count(*) OVER (PARTITION BY tagid) AS n FROM m WHERE fileid IS NOT NULL),
p AS (SELECT unnest([1, 5, 9]) AS tenths)
SELECT o.tagid, p.tenths / 10.0::DOUBLE AS prob, o.n, o.fileid FROM o JOIN p ON o.rk = greatest(1, (o.n * p.tenths + 9) // 10)""",
}
