"""The queries of this subpackage in SQL for DuckDB, where SQL can express them."""

_SETS = """
WITH last AS (SELECT fileid, max(written_at) AS w FROM relationship_roaring_fileid GROUP BY fileid),
m AS (SELECT DISTINCT r.fileid, unnest(r.tagid_bitmap) AS tag FROM relationship_roaring_fileid r JOIN last ON r.fileid = last.fileid AND r.written_at = last.w),
s AS (SELECT fileid, tag FROM m WHERE tag IS NOT NULL)"""

_PAIRS = f"""{_SETS},
t AS (SELECT count(DISTINCT fileid) AS n FROM s),
c AS (SELECT tag, count(*) AS n FROM s GROUP BY tag),
p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM s a JOIN s b ON a.fileid = b.fileid AND a.tag < b.tag GROUP BY ALL HAVING count(*) >= 30)"""

_SIMILAR = f"""{_SETS},
f AS (SELECT fileid, list_sort(list(tag)) AS tags FROM s GROUP BY fileid HAVING count(*) >= 5),
k AS (SELECT min(fileid) AS cid, tags FROM f GROUP BY tags),
e AS (SELECT cid, len(tags) AS n, unnest(tags) AS tag FROM k),
o AS (SELECT a.cid AS a, b.cid AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.tag = b.tag AND a.cid < b.cid GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE c * 5 >= (na + nb - c) * 4),
g AS (SELECT f.fileid, k.cid FROM f JOIN k ON f.tags = k.tags)"""

_NAMES = """
WITH last AS (SELECT tag_id, max(loaded_at) AS w FROM tag_entry GROUP BY tag_id),
cur AS (SELECT DISTINCT e.tag_id, e.normalized_name, e.count FROM tag_entry e JOIN last ON e.tag_id = last.tag_id AND e.loaded_at = last.w),
n AS (SELECT lower(regexp_replace(normalized_name, '[^\\p{L}\\p{N}]', '', 'g')) AS normalized_name, tag_id, coalesce(count, 0) AS c FROM cur),
g AS (SELECT normalized_name, CAST(sum(c) AS BIGINT) AS total, count(DISTINCT tag_id) AS n_tags FROM n WHERE normalized_name <> '' GROUP BY normalized_name),
r AS (SELECT *, CASE WHEN total < 5 THEN 'rare' WHEN total * 250 >= (SELECT sum(c) FROM n) THEN 'common' END AS mark FROM g)"""

_WINDOWS = """
SELECT {id} AS id, array_to_string(w[i:i + {n} - 1], '{sep}') AS win FROM
(SELECT {id}, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT {id}, {units} AS w FROM {t} WHERE text IS NOT NULL AND {cond}))"""
_PLAIN = "lower(strip_accents(text))"
_WORDS = f"regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{N}}]+')"
_CHARS = f"regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{N}}]')"
_CJK = "2 * len(regexp_extract_all(text, '[\\p{Han}\\p{Hiragana}\\p{Katakana}]')) > len(regexp_extract_all(text, '\\p{L}'))"
_LEAKS = " UNION ".join(
    f"SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM ({_WINDOWS.format(id='doc_id', t='documents', units=u, n=n, sep=s, cond='true')}) d JOIN ({_WINDOWS.format(id='item_id', t='benchmark', units=u, n=n, sep=s, cond=c)}) b ON d.win = b.win"
    for u, n, s, c in ((_WORDS, 12, " ", f"NOT ({_CJK})"), (_CHARS, 25, "", _CJK))
)

_ALL_PAIRS = _PAIRS.replace(" HAVING count(*) >= 30", "")

SQL = {
    "p6_found": _LEAKS,
    "p1_found": f"{_PAIRS} SELECT tag_a, tag_b FROM p JOIN c x ON x.tag = tag_a JOIN c y ON y.tag = tag_b, t WHERE n_ab * t.n >= 8 * x.n * y.n",
    "p1_lift": f"{_ALL_PAIRS} SELECT tag_a, tag_b, x.n AS n_a, y.n AS n_b, n_ab, t.n AS n_baskets, n_ab::DOUBLE * t.n / (x.n::DOUBLE * y.n) AS lift, round(log2(n_ab::DOUBLE * t.n / (x.n::DOUBLE * y.n)), 6) AS pmi FROM p JOIN c x ON x.tag = tag_a JOIN c y ON y.tag = tag_b, t",
    "p1_pairs": f"{_ALL_PAIRS} SELECT tag_a, tag_b, x.n AS n_a, y.n AS n_b, n_ab, t.n AS n_baskets, n_ab::DOUBLE * t.n / (x.n::DOUBLE * y.n) AS lift FROM p JOIN c x ON x.tag = tag_a JOIN c y ON y.tag = tag_b, t",
    "p2_found": f"{_SIMILAR} SELECT least(x.fileid, y.fileid) AS fileid_a, greatest(x.fileid, y.fileid) AS fileid_b FROM (SELECT a, b FROM l UNION ALL SELECT cid, cid FROM k) q JOIN g x ON x.cid = q.a JOIN g y ON y.cid = q.b WHERE q.a < q.b OR x.fileid < y.fileid",
    "p2_between": f"""{_SIMILAR}, q AS (SELECT x.fileid AS a, y.fileid AS b FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT cid, cid FROM k) q JOIN g x ON x.cid = q.a JOIN g y ON y.cid = q.b WHERE x.fileid % 20 = 0 AND y.fileid % 20 <> 0)
SELECT q.a AS fileid, q.b AS other, len(list_intersect(x.tags, y.tags)) AS n_common, len(x.tags) + len(y.tags) - len(list_intersect(x.tags, y.tags)) AS n_union FROM q JOIN f x ON x.fileid = q.a JOIN f y ON y.fileid = q.b""",
    "p2_classes": f"{_SIMILAR}, d AS (SELECT cid, count(*) AS n FROM (SELECT a AS cid FROM l UNION ALL SELECT b FROM l) GROUP BY cid) SELECT g.fileid, g.cid AS class_id, count(*) OVER (PARTITION BY g.cid) AS n_copies, coalesce(d.n, 0) AS n_links FROM g LEFT JOIN d ON g.cid = d.cid",
    "p7_sources": """WITH k AS (SELECT regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') AS source, sum(greatest(CAST(target_share AS DECIMAL(20, 12)), 0)) AS w, min(max_repeats) AS m FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
h AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') AS source FROM documents WHERE text <> '')
SELECT source, round(CAST(w AS DOUBLE), 9) AS target_share, m AS max_repeats, 0 AS docs_missing, w > 0 AND m > 0 AND source IN (SELECT source FROM h WHERE source IS NOT NULL) AS mixed FROM k""",
    "p8_coverage": "SELECT doc_id, length(regexp_replace(text, '[\\s\\v\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) AS n_chars, true AS bare FROM documents WHERE regexp_matches(text, '[^\\s\\v\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')",
    "p4_found": f"{_NAMES} SELECT normalized_name, mark FROM r WHERE mark IS NOT NULL",
    "p4_terms": f"{_NAMES} SELECT normalized_name, total, n_tags, mark FROM r",
}
