"""The queries on the tag graph in SQL for DuckDB."""

_GRAPH = """
WITH ptag(partkey, ns, name) AS (
  SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part
  UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part),
allt(ns, name) AS (SELECT ns, name FROM ptag UNION SELECT 'color', split_part(p_name, ' ', 1) FROM part UNION SELECT 'noun', split_part(p_name, ' ', 2) FROM part),
namespace AS (SELECT row_number() OVER (ORDER BY ns) AS id, ns AS name, CAST(NULL AS VARCHAR) AS description FROM (SELECT DISTINCT ns FROM allt)),
tag0 AS (SELECT row_number() OVER (ORDER BY a.ns, a.name) AS id, a.name, n.id AS namespace, a.ns FROM allt a JOIN namespace n ON n.name = a.ns),
rel AS (SELECT DISTINCT l.l_orderkey AS file_id, t.id AS tag_id, t.namespace FROM lineitem l JOIN ptag p ON p.partkey = l.l_partkey JOIN tag0 t ON t.ns = p.ns AND t.name = p.name),
gtags AS (SELECT t.id, t.name, t.namespace, t.ns, coalesce(c.n, 0) AS count FROM tag0 t LEFT JOIN (SELECT tag_id, count(*) AS n FROM rel GROUP BY 1) c ON c.tag_id = t.id),
parents AS (
  SELECT DISTINCT a.id AS tag_id, b.id AS relate_tag_id, l.id AS limit_to FROM part
   JOIN tag0 a ON a.ns = 'name' AND a.name = p_name JOIN tag0 b ON b.ns = 'brand' AND b.name = p_brand JOIN tag0 l ON l.ns = 'type' AND l.name = p_type
  UNION SELECT a.id, b.id, NULL FROM part JOIN tag0 a ON a.ns = 'name' AND a.name = p_name JOIN tag0 b ON b.ns = 'color' AND b.name = split_part(p_name, ' ', 1)),
gfiles AS (SELECT o_orderkey AS id, upper(md5(CAST(o_orderkey AS VARCHAR))) AS hash, lower(o_orderstatus) AS extension, o_orderkey % 3 + 1 AS storage_id,
   CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS size_bytes FROM orders),
jobs AS (SELECT event_id AS id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS time, 60 * CAST(props ->> '$.k' AS BIGINT) AS reptime, CAST(floor(value) AS BIGINT) AS priority, event_id % 7 = 0 AS is_running,
   CAST(props ->> '$.k' AS BIGINT) AS k, event_type AS site, props AS param FROM events),
mirrors AS (SELECT DISTINCT unnest(regexp_extract_all(content, 'files\\.example\\.org/p/\\d+/\\d+')) AS url FROM comment_item),
dead AS (SELECT url FROM mirrors WHERE CAST(split_part(url, '/', 4) AS BIGINT) % 10 = 0)"""


def _g(sql: str, more: str = "") -> str:
    return f"{_GRAPH}{', ' + more if more else ''} {sql}"


def _t(ns: str, name: str) -> str:
    return f"(SELECT id FROM tag0 WHERE ns = '{ns}' AND name = '{name}')"


_RED, _B2, _B17, _SMALL = _t("name", "red widget"), _t("brand", "Brand#2"), _t("brand", "Brand#17"), _t("type", "SMALL")
_FILES = ", ".join(str(i) for i in range(1, 400, 7))
_NOW = 1704067200 + 5 * 86400

_NAMED = """WITH nt AS (SELECT id, min(name) AS name, max(count) AS count, min(namespace_id) AS namespace FROM tags WHERE name IS NOT NULL GROUP BY id),
n AS (SELECT *, lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS norm FROM nt)"""


def _fuzzy(q: str, limit: int, table: str = "n") -> str:
    """Best matches of a plain ASCII query, without the prefilter by bigrams: it only drops what can't match."""
    d = 1 if len(q) <= 4 else 2 if len(q) <= 8 else 3
    need = max(1, len(q) - 1 - 2 * d) if len(q) > 2 * d else 0
    grams = ", ".join(f"'{g}'" for g in sorted({q[i:i + 2] for i in range(len(q) - 1)}))
    return f"""SELECT id AS tag_id, count, score FROM (SELECT id, count, CASE WHEN starts_with(norm, '{q}') THEN 0 WHEN contains(norm, '{q}') THEN 1
 WHEN abs(length(norm) - {len(q)}) <= {d} AND levenshtein(norm, '{q}') <= {d} AND (SELECT count(*) FROM unnest([{grams}]) u(g) WHERE contains(norm, g)) >= {need} THEN levenshtein(norm, '{q}') + 2 END AS score
 FROM {table} WHERE strlen(norm) >= {len(q)}) WHERE score IS NOT NULL ORDER BY score, count DESC, id LIMIT {limit}"""


_GNORM = "gn AS (SELECT id, count, lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS norm FROM gtags)"
_LATEST = """WITH last AS (SELECT fileid, max(written_at) AS w FROM relationship_roaring_fileid GROUP BY fileid),
s AS (SELECT DISTINCT r.fileid, unnest(r.tagid_bitmap) AS tagid FROM relationship_roaring_fileid r JOIN last ON r.fileid = last.fileid AND r.written_at = last.w)"""
_SHARD = "{root} || '/' || substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || substr(hash, 5, 2) || '/' || hash || '.' || extension"

_ACTIONS = f"""act AS (SELECT DISTINCT l_orderkey AS file_id, CASE WHEN l_orderkey % 20 < 2 THEN 'Add' WHEN l_orderkey % 20 < 4 THEN 'Del' ELSE 'Set' END AS op,
  t.id AS tag_id, t.namespace FROM lineitem JOIN part ON l_partkey = p_partkey JOIN tag0 t ON t.ns = 'brand' AND t.name = CASE WHEN l_orderkey % 2 = 0 THEN 'Brand#2' ELSE p_brand END WHERE l_orderkey % 20 < 6),
added AS (SELECT file_id, tag_id FROM act WHERE op <> 'Del'),
gone AS (SELECT file_id, tag_id FROM act WHERE op = 'Del' UNION
  SELECT r.file_id, r.tag_id FROM rel r WHERE (r.file_id, r.namespace) IN (SELECT (file_id, namespace) FROM act WHERE op = 'Set') AND (r.file_id, r.tag_id) NOT IN (SELECT (file_id, tag_id) FROM added))"""

SQL = {
    "search_and_or_not": _g(f"SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id = {_RED}) AND bool_or(tag_id IN ({_B2}, {_B17})) AND NOT bool_or(tag_id = {_SMALL})"),
    "search_and": _g(f"SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id = {_RED}) AND bool_or(tag_id = {_B2})"),
    "search_or": _g(f"SELECT DISTINCT file_id FROM rel WHERE tag_id IN ({_RED}, {_B17})"),
    "search_not_only": _g(f"SELECT file_id FROM rel GROUP BY file_id HAVING NOT bool_or(tag_id IN ({_SMALL}, {_B2}))"),
    "search_or_groups2": _g(f"SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id IN ({_RED}, {_SMALL})) AND bool_or(tag_id IN ({_B2}, {_B17}))"),
    "search_limit": _g(f"SELECT DISTINCT file_id FROM rel WHERE tag_id IN ({_RED}, {_B2}) ORDER BY file_id DESC LIMIT 25"),
    "search_offset_limit": _g(f"SELECT DISTINCT file_id FROM rel WHERE tag_id = {_B2} ORDER BY file_id DESC LIMIT 20 OFFSET 10"),
    "search_unknown_and": _g(f"SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id = {_B2}) AND bool_or(tag_id = 1000000000000)"),
    "search_unknown_or": _g(f"SELECT DISTINCT file_id FROM rel WHERE tag_id IN ({_B2}, 1000000000000)"),
    "search_many_ids": _g(f"SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id = {_B2}) AND bool_or(tag_id BETWEEN 1 AND 999)"),
    "search_by_names": _g("SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id IN (SELECT tag_id FROM m1)) AND bool_or(tag_id IN (SELECT tag_id FROM m2))", f"{_GNORM}, m1 AS ({_fuzzy('redwidget', 100, 'gn')}), m2 AS ({_fuzzy('brand2', 100, 'gn')})"),
    "search_by_name_groups": _g("SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id IN (SELECT tag_id FROM m1)) AND bool_or(tag_id IN (SELECT tag_id FROM m2)) AND NOT bool_or(tag_id IN (SELECT tag_id FROM m3))", f"{_GNORM}, m1 AS ({_fuzzy('widget', 100, 'gn')}), m2 AS ({_fuzzy('brand1', 100, 'gn')}), m3 AS ({_fuzzy('small', 100, 'gn')})"),
    "search_project_sets": f"{_LATEST}, t AS (SELECT tagid, row_number() OVER (ORDER BY count(*) DESC, tagid) AS rk FROM s WHERE tagid IS NOT NULL GROUP BY tagid) SELECT fileid AS file_id FROM s GROUP BY fileid HAVING bool_or(tagid = (SELECT tagid FROM t WHERE rk = 1)) AND bool_or(tagid = (SELECT tagid FROM t WHERE rk = 2)) AND NOT bool_or(tagid = (SELECT tagid FROM t WHERE rk = 3))",
    "current_sets": f"{_LATEST} SELECT fileid, tagid FROM s WHERE tagid IS NOT NULL",
    "tag_file_sets": "SELECT DISTINCT tagid, fileid FROM (SELECT tagid, unnest(fileid_bitmap) AS fileid FROM relationship_roaring_tagid) WHERE tagid IS NOT NULL AND fileid IS NOT NULL",
    "search_bitmap_and": _g(f"SELECT count(*) AS n FROM (SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id = {_RED}) AND bool_or(tag_id = {_B2}))"),
    "search_bitmap_or": _g(f"SELECT count(DISTINCT file_id) AS n FROM rel WHERE tag_id IN ({_RED}, {_B2})"),
    "search_bitmap_andnot": _g(f"SELECT count(*) AS n FROM (SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id = {_RED}) AND NOT bool_or(tag_id = {_B2}))"),
    "bitmap_cardinality": _g("SELECT tag_id, count(*) AS n FROM rel GROUP BY tag_id"),
    "rel_tags_of_files_many": _g(f"SELECT f.file_id, coalesce(string_agg(CAST(r.tag_id AS VARCHAR), ',' ORDER BY r.tag_id), '') AS tag_ids FROM (SELECT unnest([{_FILES}]) AS file_id) f LEFT JOIN rel r ON r.file_id = f.file_id GROUP BY f.file_id"),
    "rel_tags_of_file": _g("SELECT tag_id FROM rel WHERE file_id = 8"),
    "rel_files_of_tag": _g(f"SELECT file_id FROM rel WHERE tag_id = {_B2}"),
    "rel_files_of_tags_many": _g(f"SELECT tag_id, file_id FROM rel WHERE tag_id IN ({_RED}, {_B2}, {_SMALL}, {_t('color', 'red')})"),
    "namespace_get": _g("SELECT id FROM namespace WHERE name = 'brand'"),
    "files_in_namespace": _g("SELECT DISTINCT file_id FROM rel JOIN namespace n ON rel.namespace = n.id WHERE n.name = 'type'"),
    "tags_in_namespace": _g("SELECT id FROM tag0 WHERE ns = 'brand'"),
    "tags_filtered": _g("SELECT tag_id FROM rel JOIN namespace n ON rel.namespace = n.id WHERE n.name = 'size' AND file_id = 8"),
    "files_all": _g("SELECT id FROM gfiles"),
    "tags_all": _g("SELECT id FROM gtags"),
    "tag_objects": _g("SELECT t.id, t.name, t.ns, n.description FROM tag0 t JOIN namespace n ON n.id = t.namespace WHERE t.id IN (1, 2, 3, 50, 60)"),
    "file_tags_objects": _g(f"SELECT r.file_id, r.tag_id, t.name, t.ns FROM rel r JOIN tag0 t ON t.id = r.tag_id WHERE r.file_id IN ({_FILES})"),
    "tag_get_file": _g(f"SELECT * FROM gfiles WHERE id = (SELECT min(file_id) FROM rel WHERE tag_id = {_B2})"),
    "min_file_per_tag": _g("SELECT tag_id, min(file_id) AS file_id FROM rel GROUP BY tag_id"),
    "untagged_files": _g("SELECT id FROM gfiles WHERE id NOT IN (SELECT file_id FROM rel)"),
    "hash_lookup": "SELECT md5(CAST(o_orderkey AS VARCHAR)) AS digest, o_orderkey AS file_id FROM orders WHERE o_orderkey IN (1, 2, 3, 5)",
    "dead_url_get": _g("SELECT url, url IN (SELECT url FROM dead) AS dead FROM mirrors"),
    "parent_rel": _g(f"SELECT * FROM parents WHERE tag_id = {_RED}"),
    "parent_rel_many": _g("SELECT * FROM parents WHERE tag_id BETWEEN 1 AND 119"),
    "child_rel": _g(f"SELECT * FROM parents WHERE relate_tag_id = {_B2}"),
    "child_rel_many": _g("SELECT * FROM parents WHERE relate_tag_id BETWEEN 1 AND 59"),
    "parent_one": _g(f"SELECT * FROM parents WHERE tag_id = {_RED} AND relate_tag_id = {_B2} ORDER BY limit_to NULLS FIRST LIMIT 1"),
    "parent_files": _g(f"SELECT DISTINCT file_id FROM rel WHERE tag_id = {_RED} OR tag_id IN (SELECT relate_tag_id FROM parents WHERE tag_id = {_RED})"),
    "parent_structure_exists": _g(f"SELECT count(*) > 0 AS found FROM parents WHERE tag_id = {_RED} AND relate_tag_id = {_t('color', 'red')} AND limit_to IS NOT DISTINCT FROM NULL"),
    "parent_limit_exists": _g(f"SELECT count(*) > 0 AS found FROM parents WHERE relate_tag_id = {_B2} AND limit_to = {_SMALL}"),
    "parent_closure": _g("SELECT tag_id, ancestor, min(depth) AS depth FROM c GROUP BY 1, 2", "e AS (SELECT tag_id, relate_tag_id AS p FROM parents UNION SELECT relate_tag_id, limit_to FROM parents WHERE limit_to IS NOT NULL), c AS (SELECT tag_id, p AS ancestor, 1 AS depth FROM e UNION ALL SELECT a.tag_id, b.p, 2 FROM e a JOIN e b ON b.tag_id = a.p UNION ALL SELECT a.tag_id, z.p, 3 FROM e a JOIN e b ON b.tag_id = a.p JOIN e z ON z.tag_id = b.p)"),
    "tag_counts": _g("SELECT id, count FROM gtags"),
    "popular_tags": _g("SELECT id, name, count FROM gtags WHERE count >= 5"),
    "structural_tags": _g("SELECT id, name FROM gtags WHERE count = 0"),
    "tags_topk": _g("SELECT id, count FROM gtags ORDER BY count DESC, id LIMIT 20"),
    "rarest_first_rank": _g("SELECT id, count, row_number() OVER (ORDER BY count, id) AS rank FROM gtags WHERE id BETWEEN 1 AND 39"),
    "tags_keyset_page": _g("SELECT namespace, id FROM gtags WHERE namespace > 2 OR (namespace = 2 AND id > 30) ORDER BY namespace, id LIMIT 25"),
    "files_offset_page": _g("SELECT id FROM gfiles ORDER BY id LIMIT 50 OFFSET 100"),
    "tag_search_prefix": f"{_NAMED} {_fuzzy('glass', 10)}",
    "tag_search_substring": f"{_NAMED} {_fuzzy('fountain', 25)}",
    "tag_search_typo": f"{_NAMED} {_fuzzy('unttiled', 15)}",
    "tag_search_topk": f"{_NAMED} {_fuzzy('mo', 50)}",
    "tag_search_bigram_candidates": f"{_NAMED}, b AS (SELECT id, norm AS name, (SELECT count(*) FROM unnest(['ai', 'cu', 'in', 'rt', 'ta', 'ur']) u(g) WHERE contains(norm, g)) AS shared FROM n) SELECT id, name, shared FROM b WHERE strlen(name) >= 7 AND (shared >= 2 OR contains(name, 'curtain'))",
    "tag_search_fts": f"{_NAMED}, t AS (SELECT unnest(['acstle', 'agdren', 'caslte', 'castel', 'castle', 'castlegadren', 'catsle', 'csatle', 'gadern', 'gadren', 'gadrne', 'garden', 'gdaren']) AS w) SELECT DISTINCT id, name, count FROM nt JOIN t ON contains(lower(name), w)",
    "normalize_names": "SELECT DISTINCT name, lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS normalized FROM tags WHERE name IS NOT NULL",
    "allowed_distance_cases": f"{_NAMED} SELECT DISTINCT name AS query, CASE WHEN strlen(name) <= 4 THEN 1 WHEN strlen(name) <= 8 THEN 2 ELSE 3 END AS distance FROM nt",
    "fts_terms": "SELECT unnest(['redfox', 'red', 'erd', 'rde', 'fox', 'ofx', 'fxo']) AS term",
    "match_scores": f"{_NAMED}, q AS (SELECT * FROM (VALUES ('sketch', 2), ('untitled', 2), ('harbor', 2)) v(q, d)) SELECT * FROM (SELECT q, norm AS name, CASE WHEN starts_with(norm, q) THEN 0 WHEN contains(norm, q) THEN 1 WHEN abs(length(norm) - length(q)) <= d AND levenshtein(norm, q) <= d THEN levenshtein(norm, q) + 2 END AS score FROM (SELECT DISTINCT norm FROM n), q) WHERE score IS NOT NULL",
    "tag_regex_scan": f"{_NAMED} SELECT id AS tag_id, name, unnest(regexp_extract_all(name, '[0-9]+')) AS match FROM nt",
    "tag_substring_scan": f"{_NAMED} SELECT id AS tag_id, name, 'castle' AS match FROM nt WHERE contains(name, 'castle') AND namespace <> 2 AND namespace IN (1, 3, 7, 8, 9, 10, 11, 12)",
    "tag_name_groups": f"{_NAMED} SELECT norm AS name, count(*) AS n_ids, min(id) AS first_id FROM n GROUP BY norm HAVING count(*) > 1",
    "jobs_runnable_topk_per_site": _g(f"SELECT id, site, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority DESC, time, id) AS rank FROM jobs WHERE NOT is_running AND time + reptime <= {_NOW}) WHERE rank <= 20"),
    "jobs_by_site": _g("SELECT id, time, reptime FROM jobs WHERE site = 'purchase'"),
    "job_sites": "SELECT DISTINCT event_type AS site FROM events",
    "jobs_dedup_upsert": _g(
        """SELECT j.id, j.time, j.reptime, j.site, j.param, coalesce(l.priority, j.priority) AS priority FROM jobs j LEFT JOIN l ON (j.time, j.reptime, j.site, j.param) = (l.time, l.reptime, l.site, l.param)
UNION ALL SELECT (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY time, reptime, site, param), time, reptime, site, param, priority FROM f""",
        """n AS (SELECT time, CASE WHEN id % 10 = 0 THEN reptime ELSE reptime + 1 END AS reptime, site, param, priority + 100 AS priority, id AS seq FROM jobs WHERE id % 10 < 2),
l AS (SELECT time, reptime, site, param, arg_max(priority, seq) AS priority FROM n GROUP BY ALL),
f AS (SELECT * FROM l WHERE (time, reptime, site, param) NOT IN (SELECT (time, reptime, site, param) FROM jobs))""",
    ),
    "jobs_recreate": _g(f"SELECT id, CAST({_NOW} AS BIGINT) AS time, CASE WHEN k % 3 = 0 THEN 3600 ELSE 600 END AS reptime, false AS is_running, CASE WHEN k % 3 = 0 THEN 1 END AS count, site, param FROM jobs WHERE is_running AND k % 3 < 2"),
    "jobs_retry_later": _g(f"SELECT id, CASE WHEN id < 70 AND id % 7 = 0 THEN {_NOW} ELSE time END AS time, CASE WHEN id < 70 AND id % 7 = 0 THEN 300 ELSE reptime END AS reptime, is_running AND NOT (id < 70 AND id % 7 = 0) AS is_running FROM jobs"),
    "jobs_removed": "SELECT event_id AS id FROM events WHERE event_id >= 50",
    "jobs_by_plugin": "SELECT CASE WHEN event_type = 'purchase' THEN 'shop' ELSE 'viewer' END AS plugin, count(*) AS n_jobs, min(event_id) AS first_job FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1",
    "job_param_json": "SELECT event_id AS id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events",
    "skip_if_file_tag": _g("SELECT id FROM jobs WHERE k NOT IN (SELECT tag_id FROM rel)"),
    "should_download_urls": _g("SELECT url FROM mirrors WHERE url NOT IN (SELECT url FROM dead)"),
    "apply_actions_all": _g("SELECT file_id, tag_id FROM (SELECT file_id, tag_id FROM rel UNION SELECT file_id, tag_id FROM added) WHERE (file_id, tag_id) NOT IN (SELECT (file_id, tag_id) FROM gone)", _ACTIONS),
    "apply_actions_edges": _g("SELECT file_id, tag_id FROM (SELECT file_id, tag_id FROM rel WHERE namespace IN (SELECT namespace FROM act) UNION SELECT file_id, tag_id FROM added) WHERE (file_id, tag_id) NOT IN (SELECT (file_id, tag_id) FROM gone)", _ACTIONS),
    "ingest_tags_new_ids": _g(
        """SELECT id, ns, name, CASE WHEN ns = 'post' THEN 1 ELSE coalesce((SELECT count(*) FROM parents p WHERE p.tag_id = t.id), 0) END AS n_parents FROM (SELECT id, ns, name FROM tag0 UNION ALL
SELECT (SELECT max(id) FROM tag0) + row_number() OVER (ORDER BY CASE ns WHEN 'post' THEN 1 ELSE 2 END, name), ns, name FROM w) t""",
        "w AS (SELECT DISTINCT 'post' AS ns, trim(x) AS name FROM (SELECT unnest(regexp_split_to_array(tags, '[,;]')) AS x FROM post_item) WHERE trim(x) <> '' UNION ALL SELECT 'root', 'archive')",
    ),
    "namespace_upsert": _g(
        """SELECT n.id, n.name, coalesce(w.description, n.description) AS description FROM namespace n LEFT JOIN w ON n.name = w.name
UNION ALL SELECT (SELECT max(id) FROM namespace) + row_number() OVER (ORDER BY name), name, description FROM w WHERE name NOT IN (SELECT name FROM namespace)""",
        "w AS (SELECT name, max(description) AS description FROM (SELECT name, description FROM tag_namespace UNION ALL SELECT 'brand', 'Makers' UNION ALL SELECT 'size', NULL) WHERE name IS NOT NULL GROUP BY name)",
    ),
    "file_upsert": _g(
        """SELECT g.id, g.hash, coalesce(w.m.extension, g.extension) AS extension, coalesce(w.m.storage_id, g.storage_id) AS storage_id, g.size_bytes FROM gfiles g LEFT JOIN w ON g.hash = w.hash
UNION ALL SELECT (SELECT max(id) FROM gfiles) + row_number() OVER (ORDER BY hash), hash, m.extension, m.storage_id, m.size_bytes FROM w WHERE hash NOT IN (SELECT hash FROM gfiles)""",
        "w AS (SELECT hash, arg_max({'extension': extension, 'storage_id': storage_id, 'size_bytes': size_bytes}, (extension, storage_id, coalesce(size_bytes, -1))) AS m FROM files WHERE hash IS NOT NULL AND extension IS NOT NULL GROUP BY hash)",
    ),
    "parents_dedupe_nullsafe": _g("SELECT * FROM parents UNION SELECT tag_id, relate_tag_id, NULL FROM parents"),
    "rel_add": _g("SELECT file_id, tag_id FROM rel UNION SELECT f.id, t.id FROM gfiles f, (SELECT unnest([1, 2]) AS id) t WHERE f.id % 2 = 0"),
    "rel_add_all": _g("SELECT file_id, tag_id FROM rel UNION SELECT f.id, t.id FROM gfiles f, (SELECT unnest([1, 2]) AS id) t"),
    "rel_delete": _g("SELECT file_id, tag_id FROM rel WHERE file_id % 10 = 0"),
    "tag_cascade_delete": _g("SELECT DISTINCT tag_id, relate_tag_id, CASE WHEN limit_to % 3 <> 0 THEN limit_to END AS limit_to FROM parents WHERE tag_id % 3 <> 0 AND relate_tag_id % 3 <> 0"),
    "namespace_cascade_delete": _g("SELECT namespace, count(*) AS n FROM rel WHERE namespace <> (SELECT id FROM namespace WHERE name = 'type') GROUP BY namespace"),
    "merge_databases": _g("SELECT t.ns, t.name, t.count, (SELECT count(*) FROM parents p WHERE p.tag_id = t.id) AS n_parents FROM gtags t"),
    "audit_diff": _g("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'create' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.size_bytes IS DISTINCT FROM b.size_bytes", "a AS (SELECT id, size_bytes FROM gfiles WHERE id % 17 <> 0), b AS (SELECT id, CASE WHEN id % 13 <> 0 THEN size_bytes END AS size_bytes FROM gfiles WHERE id % 11 <> 0)"),
    "audit_backfill": _g(f"SELECT 'file' AS entity_type, 'create' AS action, CAST({_NOW} AS BIGINT) AS changed_at, count(*) AS n, count(*) AS n_files, 0 AS n_tags FROM gfiles UNION ALL SELECT 'tag', 'create', {_NOW}, count(*), 0, count(*) FROM gtags UNION ALL SELECT 'relationship', 'create', {_NOW}, count(*), count(*), count(*) FROM rel"),
    "audit_get": _g("SELECT 'file' AS entity_type, id AS file_id, NULL AS tag_id FROM gfiles WHERE id = 8 UNION ALL SELECT 'relationship', file_id, tag_id FROM rel WHERE file_id = 8"),
    "hash_columns": "SELECT doc_id, 'MD5' AS algorithm, md5(text) AS digest FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'SHA1', upper(sha1(text)) FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'SHA256', upper(sha256(text)) FROM documents WHERE text IS NOT NULL",
    "missing_hashes": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0",
    "missing_sizes": "SELECT DISTINCT id FROM files WHERE size_bytes IS NULL AND hash IS NOT NULL",
    "sharded_path": f"SELECT DISTINCT id, CASE WHEN length(hash) > 6 THEN {_SHARD.format(root="'store' || storage_id")} END AS path FROM files",
    "storage_check": _g(
        "SELECT path, id, CASE WHEN loc IS NULL THEN 'missing' WHEN loc = want THEN 'ok' ELSE 'misplaced' END AS status FROM w UNION ALL SELECT 'st/ra/yy/strayyyy.bin', NULL, 'unknown'",
        f"w AS (SELECT substr({_SHARD.format(root="''")}, 2) AS path, id, storage_id AS want, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 7 = 0 THEN 1 ELSE storage_id END END AS loc FROM gfiles)",
    ),
    "backup_path": "SELECT DISTINCT id, 'backup/' || strftime(to_timestamp(added) AT TIME ZONE 'UTC', '%Y/%m/%d') AS path FROM post_item",
    "download_verified": "SELECT id, CASE WHEN size_bytes IS NULL THEN CASE WHEN id % 4 < 2 THEN true ELSE true END ELSE id % 4 <> 0 END AS ok FROM (SELECT DISTINCT * FROM files WHERE hash IS NOT NULL)",
    "retry_backoff": "SELECT i AS attempt, CAST(pow(2, least(i, 4)) AS BIGINT) AS seconds, 400 + i * 8 IN (408, 425, 429, 500, 502, 503, 504) AS again FROM range(0, 8) t(i)",
    "extract_url_parts": _g("SELECT url, split_part(url, '/', 1) AS host, split_part(url, '/', 2) AS kind, split_part(url, '/', 3) AS post FROM mirrors"),
    "last_path_segment": _g("SELECT url, split_part(url, '/', 4) AS number FROM mirrors"),
    "url_query_params": "SELECT DISTINCT 'https://a.example/p?post=' || post_id || '&by=' || coalesce(commenter, '') || '#c' AS url, post_id AS post, coalesce(commenter, '') AS by FROM comment_item WHERE post_id IS NOT NULL",
    "absolute_urls": "SELECT DISTINCT id, CASE length(id) % 4 WHEN 0 THEN 'https://s.example/a/' || id WHEN 1 THEN 'https://cdn.example/' || id WHEN 2 THEN 'https://o.example/' || id ELSE 'https://s.example/img/' || id END AS url FROM post_item WHERE id IS NOT NULL",
    "html_links_explode": "SELECT DISTINCT id, unnest(regexp_extract_all(content, '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS link FROM (SELECT id, content FROM post_item UNION ALL SELECT id, content FROM comment_item)",
    "html_paragraphs": "SELECT id, CAST(i - 1 AS INTEGER) AS position, l[i] AS paragraph FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, regexp_extract_all(content, '<p>(.*?)</p>', 1) AS l FROM (SELECT DISTINCT id, content FROM post_item WHERE content IS NOT NULL)))",
    "iso_duration": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id * 60 WHEN 1 THEN user_id * 3600 + 5 END AS seconds FROM events",
    "duration_words": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN user_id * 604800 + 2 * 86400 + user_id * 3600 WHEN 1 THEN 0 WHEN 2 THEN user_id * 60 WHEN 3 THEN 0 WHEN 4 THEN user_id * 60 + 30 WHEN 5 THEN 0 WHEN 6 THEN user_id * 31557600 + 2629800 ELSE user_id * 86400 END AS seconds FROM events",
    "max_by_quality": "SELECT o_custkey, m.score, m.label FROM (SELECT o_custkey, max({'score': CASE o_orderkey % 5 WHEN 0 THEN 360 WHEN 1 THEN 720 WHEN 2 THEN 1080 WHEN 3 THEN 2160 ELSE 1 END, 'label': ['360p', '720p', '1080p', '4k', 'none'][o_orderkey % 5 + 1] || '-' || o_orderkey}) AS m FROM orders GROUP BY o_custkey)",
    "base64_digest_hex": "SELECT DISTINCT id, hash AS hex FROM files WHERE hash IS NOT NULL",
    "ts_parse": "SELECT DISTINCT id, added, added - CASE WHEN added % 3 = 2 THEN 7200 ELSE 0 END AS epoch FROM post_item",
    "quoted_csv": "SELECT DISTINCT id, unnest(regexp_split_to_array(tags, ' *[,;] *')) AS field FROM post_item WHERE tags IS NOT NULL",
    "whitespace_collapse": "SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL",
    "watermark_clean": "SELECT doc_id, length(regexp_replace(text, 'copied from a worksheet: *', '', 'gi')) AS n FROM documents WHERE text IS NOT NULL",
    "best_time": "SELECT id, max(coalesce(edited, published, added)) AS at FROM post_item GROUP BY id HAVING max(coalesce(edited, published, added)) IS NOT NULL",
    "post_tags_positions": "SELECT id, tags, CAST(i - 1 AS INTEGER) AS position, trim(l[i]) AS tag FROM (SELECT id, tags, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT id, tags, regexp_split_to_array(tags, '[,;]') AS l FROM post_item WHERE tags IS NOT NULL))",
    "comment_scopes": "SELECT c.id, c.post_id, c.commenter, concat_ws('/', p.service, p.user_id) AS scope FROM (SELECT DISTINCT id, post_id, commenter FROM comment_item WHERE commenter IS NOT NULL) c JOIN (SELECT DISTINCT id, user_id, service FROM post_item) p ON c.post_id = p.id",
    "page_fanout": "SELECT post_id, n, unnest(range(0, n, 50)) AS offset FROM (SELECT post_id, count(*) AS n FROM comment_item WHERE post_id IS NOT NULL GROUP BY post_id)",
    "chunk_by_10": _g("SELECT (n - 1) // 10 AS chunk, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM gtags WHERE count > 0) GROUP BY 1"),
    "chunk_by_10_all": _g("SELECT (n - 1) // 10 AS chunk, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM gtags WHERE id NOT IN (SELECT tag_id FROM parents)) GROUP BY 1"),
    "search_addresses": "SELECT DISTINCT id, 'https://s.example/posts?tags=' || array_to_string(list_sort(regexp_split_to_array(tags, ' *[,;] *')), '+') || '&page=1' AS url FROM post_item WHERE tags IS NOT NULL",
    "policy_search": _g(
        f"SELECT h.file_id FROM h JOIN gfiles f ON f.id = h.file_id WHERE f.extension IN ('f', 'o') AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.file_id = h.file_id) AND EXISTS (SELECT 1 FROM good WHERE good.file_id = h.file_id)",
        f"""{_GNORM}, m AS MATERIALIZED ({_fuzzy('brand2', 100, 'gn')}), h AS MATERIALIZED (SELECT DISTINCT file_id FROM rel WHERE tag_id IN (SELECT tag_id FROM m) ORDER BY file_id DESC LIMIT 500),
bad AS MATERIALIZED (SELECT DISTINCT file_id FROM rel JOIN tag0 ON tag_id = id WHERE lower(name) = 'small'), good AS MATERIALIZED (SELECT DISTINCT file_id FROM rel WHERE tag_id = {_B2})""",
    ),
    "edge_membership": _g(f"SELECT f.id AS file_id, {_B2} AS tag_id, f.id IN (SELECT file_id FROM rel WHERE tag_id = {_B2}) AS present FROM gfiles f"),
    "put_tags": _g("SELECT file_id, count(*) AS n FROM (SELECT file_id, tag_id FROM rel UNION SELECT file_id, tag_id FROM act) GROUP BY file_id", _ACTIONS),
    "put_tags_all": _g("SELECT file_id, tag_id FROM rel UNION SELECT file_id, tag_id FROM act", _ACTIONS),
    "settings_put": "SELECT r_name AS name, NULL AS description, r_regionkey AS num, CASE WHEN r_regionkey % 2 = 0 THEN 'b' ELSE 'a' END AS param FROM region UNION ALL SELECT 'NEW', 'd', NULL, NULL",
    "setting_get": "SELECT r_name AS name, r_regionkey AS num FROM region WHERE r_name = 'ASIA'",
    "dead_url_add": _g("SELECT url FROM dead UNION SELECT url FROM mirrors WHERE url LIKE '%1'"),
    "storage_get_or_create": "SELECT n_nationkey + 1 AS id, n_name AS location FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 5 + row_number() OVER (ORDER BY n_name), n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 5)",
    "file_hash_add": "SELECT o_orderkey AS file_id, a AS algorithm, CASE a WHEN 'MD5' THEN md5(CAST(o_orderkey AS VARCHAR)) WHEN 'SHA1' THEN upper(sha1(CAST(o_orderkey AS VARCHAR))) ELSE upper(sha256(CAST(o_orderkey AS VARCHAR))) END AS digest FROM orders, (SELECT unnest(['MD5', 'SHA1', 'SHA256']) AS a) WHERE o_orderkey % 4 <> 0 OR (a = 'MD5' AND o_orderkey % 8 <> 0)",
    "file_location": _g(f"SELECT id, CASE WHEN id % 2 = 0 THEN 'b' ELSE 'a' END || {_SHARD.format(root=repr(''))} AS path FROM gfiles WHERE id % 5 <> 0"),
    "json_post_tags": """WITH p AS (SELECT DISTINCT CAST(id AS BIGINT) AS id, tags, user_id, service FROM post_item WHERE tags IS NOT NULL)
SELECT DISTINCT * FROM (SELECT id, 'general' AS ns, trim(unnest(regexp_split_to_array(tags, '[,;]'))) AS name FROM p UNION ALL SELECT id, 'artist', user_id FROM p UNION ALL SELECT id, 'rating', 's' FROM p UNION ALL SELECT id, 'source', service FROM p) WHERE name <> ''""",
    "static_urls": "SELECT DISTINCT id, CASE WHEN regexp_matches(hash, '^[0-9a-fA-F]{4,}$') THEN 'https://s.example/' || substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash || '.' || extension END AS url FROM files",
    "parent_ids": "SELECT event_id, CASE WHEN event_id % 4 = 2 AND user_id <> 0 THEN user_id END AS parent FROM events",
    "pool_positions": "WITH m AS (SELECT tagid, min(list_sort(list_filter(fileid_bitmap, lambda x: x IS NOT NULL))) AS l FROM relationship_roaring_tagid WHERE tagid IS NOT NULL AND fileid_bitmap IS NOT NULL GROUP BY tagid) SELECT tagid, CAST(i - 1 AS INTEGER) AS position, l[i] AS post_id FROM (SELECT tagid, l, unnest(range(1, len(l) + 1)) AS i FROM m)",
    "catalog_hits": "SELECT DISTINCT id FROM post_item WHERE contains(lower(coalesce(title, '')), 'castle') OR contains(lower(coalesce(content, '')), 'castle')",
    "chapter_numbers": "SELECT id, l[i] AS chapter, CAST(len(l) - i + 1 AS INTEGER) AS number FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, regexp_split_to_array(tags, '[,;]') AS l FROM (SELECT DISTINCT id, tags FROM post_item WHERE tags IS NOT NULL)))",
    "job_params": "SELECT event_id, 'Normal' AS kind, event_type AS value FROM events UNION ALL SELECT event_id, 'Url', 'https://a.example/' || user_id FROM events UNION ALL SELECT event_id, 'Normal', 'x' FROM events",
    "thumbnail_paths": f"SELECT doc_id, {_SHARD.format(root="'thumbs'").replace('hash', 'h').replace('extension', "'webp'")} AS path FROM (SELECT doc_id, upper(sha256(text)) AS h FROM documents WHERE text IS NOT NULL)",
}

_GREEK_HINDI = "\\x{0900}-\\x{0903}\\x{093A}\\x{093B}\\x{093E}-\\x{094C}\\x{094E}\\x{094F}\\x{0955}-\\x{0957}\\x{0962}\\x{0963}"
_WORDS = f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]')) AS name FROM documents), n AS (SELECT name, lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}{_GREEK_HINDI}]', '', 'g')) AS norm FROM w WHERE name <> ''),
q(query, q, d) AS (VALUES ('ΑΡΧΕΊΟ', 'αρχείο', 3), ('της', 'της', 2), ('Σελ', 'σελ', 2), ('सूची', 'सूची', 3), ('के', 'के', 2), ('चित्र', 'चितर', 3))"""
_NODES = """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS handle, NULL AS parent, 'root' AS kind, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'folder', n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'file', s_name FROM supplier),
paths AS (SELECT handle, name AS path FROM nodes WHERE parent IS NULL OR parent NOT IN (SELECT handle FROM nodes) UNION ALL SELECT n.handle, p.path || '/' || n.name FROM nodes n JOIN paths p ON n.parent = p.handle)"""
_GROUPS = f"{_GNORM}, widget AS MATERIALIZED ({_fuzzy('widget', 100, 'gn')}), gadget AS MATERIALIZED ({_fuzzy('gadget', 100, 'gn')}), redw AS MATERIALIZED ({_fuzzy('redwidget', 100, 'gn')})"
_SHOWN = """ext AS (SELECT id FROM gfiles WHERE extension = 'o' AND id NOT IN (SELECT file_id FROM rel JOIN tag0 ON tag_id = tag0.id WHERE lower(tag0.name) = 'small'))"""

SQL |= {
    "search_groups_all": _g(f"SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id = {_B2}) AND bool_or(tag_id IN (SELECT tag_id FROM widget)) AND bool_or(tag_id = {_B17} OR tag_id IN (SELECT tag_id FROM redw)) AND NOT bool_or(tag_id = {_SMALL} OR tag_id IN (SELECT tag_id FROM gadget)) ORDER BY file_id DESC LIMIT 200", _GROUPS),
    "tag_matches_queued": f"{_NAMED} SELECT DISTINCT 'numbers' AS site, unnest(regexp_extract_all(name, '[0-9]{{2,}}')) AS param, 5 AS priority, id AS tag_id FROM nt",
    "search_groups_ids": _g(f"SELECT file_id FROM rel GROUP BY file_id HAVING bool_or(tag_id IN ({_RED}, {_B17})) AND NOT bool_or(tag_id = {_SMALL})"),
    "search_groups_unknown": "SELECT o_orderkey AS file_id FROM orders WHERE false",
    "policy_file_tags": _g(f"SELECT r.file_id, r.tag_id, t.name, t.ns FROM rel r JOIN tag0 t ON t.id = r.tag_id WHERE r.file_id IN ({_FILES}) AND r.file_id IN (SELECT id FROM ext)", _SHOWN),
    "policy_file_tag_ids": _g(f"SELECT file_id, tag_id FROM rel WHERE file_id IN ({_FILES}) AND file_id IN (SELECT file_id FROM rel WHERE tag_id = {_B2}) AND file_id IN (SELECT id FROM gfiles)"),
    "names_greek_devanagari": f"{_WORDS} SELECT query, name, CASE WHEN starts_with(norm, q) THEN 0 ELSE 1 END AS score FROM n JOIN q ON contains(norm, q)",
    "jobs_system": _g("SELECT id, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN k % 3 < 2 ELSE false END AS system FROM jobs"),
    "jobs_completed": _g(f"SELECT id, CASE WHEN id % 3 = 0 THEN {_NOW} ELSE time END AS time, CASE WHEN id % 3 = 0 THEN CASE WHEN k % 3 = 0 THEN 3600 ELSE 600 END ELSE reptime END AS reptime, is_running AND id % 3 <> 0 AS is_running, CASE WHEN k % 3 = 0 THEN CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END END AS count FROM jobs WHERE id % 3 <> 0 OR k % 3 < 2"),
    "jobs_started": _g("SELECT id, id < 50 AND id % 5 = 0 AS is_running FROM jobs"),
    "file_update_batch": _g("SELECT id, CASE WHEN id % 4 = 0 THEN lower(hash) ELSE hash END AS hash, CASE WHEN id % 8 = 0 THEN 'new' WHEN id % 4 <> 0 THEN extension END AS extension, CASE WHEN id % 4 = 0 THEN 9 ELSE storage_id END AS storage_id, size_bytes FROM gfiles"),
    "bitmap_changes": _g("SELECT tag_id, count(*) AS n FROM rel WHERE file_id % 3 < 2 AND file_id % 2 <> 0 GROUP BY tag_id"),
    "tree_files_below": f"{_NODES} SELECT t.top, n.handle FROM (VALUES ('r1', 'n1'), ('r1', ''), ('n3', ''), ('s5', '')) t(top, x) JOIN (SELECT s.handle, s.parent, n.parent AS root FROM nodes s JOIN nodes n ON s.parent = n.handle WHERE s.kind = 'file') n ON t.x = '' AND t.top IN (n.handle, n.parent, n.root)",
    "tree_paths": f"{_NODES} SELECT handle, path FROM paths",
    "tree_metadata": f"{_NODES}, f AS (SELECT n.*, p.path FROM nodes n JOIN paths p ON n.handle = p.handle WHERE kind = 'file') SELECT handle, 'handle' AS ns, handle AS name FROM f UNION ALL SELECT handle, 'name', name FROM f UNION ALL SELECT handle, 'size', CAST(length(name) AS VARCHAR) FROM f UNION ALL SELECT handle, 'path', path FROM f UNION ALL SELECT handle, 'snapshot', '2024-01-06' FROM f UNION ALL SELECT handle, 'created', '{_NOW}' FROM f UNION ALL SELECT handle, 'parent', parent FROM f",
    "page_values": "SELECT doc_id, 'T' || doc_id AS title, '{\"id\": ' || doc_id || '}' AS data, 'b' || doc_id AS book, 'a' || chr(10) || '<b>' || doc_id AS pushed, md5(CAST(doc_id AS VARCHAR)) AS media, greatest(1, doc_id % 7) AS pages FROM documents",
    "page_tags_by_class": "SELECT doc_id, 'general' AS ns, 'tag ' || doc_id AS name FROM documents UNION ALL SELECT doc_id, 'artist', 'artist&' || doc_id FROM documents",
    "page_stat_list": "SELECT doc_id, 0 AS position, 'Post: ' || doc_id AS text FROM documents UNION ALL SELECT doc_id, 1, 'src' FROM documents",
    "page_chapters": "SELECT doc_id, '/c/' || doc_id AS url, 'Chapter ' || doc_id AS title, doc_id % 2 = 0 AS paid FROM documents",
    "page_body": "SELECT doc_id, 'Chapter  ' || doc_id || chr(10) || 'one two' AS body FROM documents",
    "html_plain": "SELECT DISTINCT id, content, array_to_string(list_filter(list_transform(regexp_split_to_array(content, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM comment_item WHERE content IS NOT NULL AND NOT contains(content, '<') AND NOT contains(content, '&')",
    "video_ids": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS video, 'x' AS slug, 'x?y=1' AS stem FROM events",
    "error_kinds": "SELECT event_id, ['quota', 'quota', 'blocked', 'blocked', 'other'][event_id % 5 + 1] AS kind FROM events",
    "paired_params": "SELECT DISTINCT id, CAST(i AS INTEGER) AS position, l[2 * i + 1] AS first, CASE WHEN 2 * i + 2 <= len(l) THEN l[2 * i + 2] END AS second FROM (SELECT id, l, unnest(range(0, (len(l) + 1) // 2)) AS i FROM (SELECT DISTINCT id, regexp_split_to_array(tags, '[,;]') AS l FROM post_item WHERE tags IS NOT NULL))",
    "json_list_or_single": "SELECT event_id, event_id AS a FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, event_id FROM events, range(2) WHERE event_id % 3 = 1",
    "first_chapters": "SELECT * FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Vol ' END || event_id % 4 || CASE WHEN event_id % 5 = 0 THEN ' Chapter' ELSE ' x' END AS title FROM events) WHERE starts_with(lower(title), '1 ') OR contains(lower(title), ' 1 ')",
    "post_attachments": "SELECT DISTINCT id, 0 AS position, '/data/' || sha256(id) || '.png' AS path, upper(sha256(id)) AS sha256 FROM post_item WHERE id IS NOT NULL UNION ALL SELECT DISTINCT id, 1, '/data/' || id || '.zip', NULL FROM post_item WHERE id IS NOT NULL",
    "chapter_fanout": "SELECT b.p_brand AS series, c AS chapter, 'https://s.example/' || b.p_brand || '/chapter/' || c AS url FROM (SELECT DISTINCT p_brand FROM part) b, range(1, 61) t(c) WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.p_brand AND p.p_size = c)",
    "model_hits": """WITH p AS (SELECT CAST(id AS BIGINT) AS id, min(tags) AS tags, min(added) AS added FROM post_item WHERE tags IS NOT NULL AND added IS NOT NULL GROUP BY 1)
SELECT DISTINCT * FROM (SELECT id, 'image' AS ns, CAST(id AS VARCHAR) AS name FROM p UNION ALL SELECT id, 'user', CAST(id % 7 AS VARCHAR) FROM p UNION ALL SELECT id, 'user_name', 'u' || id % 7 FROM p UNION ALL SELECT id, 'published', CAST(added AS VARCHAR) FROM p UNION ALL SELECT id, 'tag', trim(unnest(regexp_split_to_array(tags, '[,;]'))) FROM p) WHERE name <> ''""",
    "sniffed_formats": "SELECT event_id, ['jpg', 'png', 'gif', 'pdf', 'mp4', 'webp', NULL][event_id % 7 + 1] AS extension FROM events",
    "registry_steps": _g("SELECT id, 'https://a.example/' || id AS url, site FROM jobs WHERE site = 'view' UNION ALL SELECT id, 'https://' || m || '.example/' || id, site FROM jobs, (SELECT unnest(['b', 'c']) AS m) WHERE site = 'purchase' UNION ALL SELECT id, 'https://start.example/' || id, 'start' FROM jobs WHERE id BETWEEN 4 AND 9"),
    "migrated_columns": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS n_comment FROM nation",
    "file_tree_roundtrip": "SELECT r_name || '.bin' AS name, strlen(r_name) AS length, '{\"k\": ' || r_regionkey || '}' AS json FROM region",
    "stream_edges": _g(f"SELECT file_id, tag_id FROM rel WHERE tag_id IN ({_RED}, {_SMALL})"),
    "stream_activity": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "swapped_table": "SELECT * FROM nation WHERE n_regionkey = 1",
    "replaced_namespaces": _g("SELECT file_id, tag_id FROM (SELECT file_id, tag_id FROM rel UNION SELECT file_id, tag_id FROM added) WHERE (file_id, tag_id) NOT IN (SELECT (file_id, tag_id) FROM gone)", _ACTIONS),
}
