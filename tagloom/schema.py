"""Schemas of the tables a tag graph is kept in."""

from __future__ import annotations

NAMESPACE = "id BIGINT, name STRING, description STRING"
TAGS = "id BIGINT, name STRING, namespace BIGINT, count BIGINT"
REL = "file_id BIGINT, tag_id BIGINT, namespace BIGINT"
PARENTS = "tag_id BIGINT, relate_tag_id BIGINT, limit_to BIGINT"
FILES = "id BIGINT, hash STRING, extension STRING, storage_id BIGINT, size_bytes BIGINT"
FILE_HASHES = "file_id BIGINT, algorithm STRING, digest STRING"
STORAGE = "id BIGINT, location STRING"
JOBS = "id BIGINT, time BIGINT, reptime BIGINT, priority BIGINT, is_running BOOLEAN, recreation STRING, site STRING, param STRING, user_data STRING"
SETTINGS = "name STRING, description STRING, num BIGINT, param STRING"
DEAD_URLS = "url STRING"
AUDIT = "changed_at BIGINT, entity_type STRING, action STRING, file_id BIGINT, tag_id BIGINT, reason STRING"
JOB_PARAM = "ARRAY<STRUCT<kind: STRING, value: STRING>>"
USER_DATA = "MAP<STRING, STRING>"
TAG_ACTION = (
    "file_id BIGINT, operation STRING, tags ARRAY<STRUCT<name: STRING, ns: STRING, ns_desc: STRING, tag_type: STRING, "
    "relates_to: STRUCT<name: STRING, ns: STRING, limit_name: STRING, limit_ns: STRING>>>"
)
