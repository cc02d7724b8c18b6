"""Hashes, paths and formats of file contents, as column expressions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First bytes of file formats, in hex, and the extension they stand for.
MAGIC = {"FFD8FF": "jpg", "89504E470D0A1A0A": "png", "47494638": "gif", "25504446": "pdf", "504B0304": "zip", "1F8B": "gz", "1A45DFA3": "webm", "4F676753": "ogg", "664C6143": "flac", "494433": "mp3", "425A68": "bz2", "377ABCAF271C": "7z", "526172211A07": "rar", "424D": "bmp"}
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def digests(c: Column) -> dict[str, Column]:
    """MD5 in lower case, the SHA family in upper case, as they are kept."""
    return {"MD5": F.md5(c), "SHA1": F.upper(F.sha1(c)), "SHA256": F.upper(F.sha2(c, 256)), "SHA512": F.upper(F.sha2(c, 512))}


def hash_rows(df: DataFrame, key: str, content: str, algorithms: Sequence[str] = ("MD5", "SHA1", "SHA256", "SHA512")) -> DataFrame:
    """(``key``, algorithm, digest), a row for each algorithm asked for; null contents have none."""
    known = digests(F.col(content))
    rows = F.array(*[F.struct(F.lit(a).alias("algorithm"), known[a].alias("digest")) for a in algorithms])
    return df.filter(F.col(content).isNotNull()).select(key, F.inline(rows))


#: Larger contents are trees of blocks, which have no identifier here.
CID_BLOCK = 262_144
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _cid_v0(content: bytes) -> str | None:
    if len(content) > CID_BLOCK:
        return None
    size = _varint(len(content))
    file = b"\x08\x02" + (b"\x12" + size + content if content else b"") + b"\x18" + size
    digest = b"\x12\x20" + hashlib.sha256(b"\x0a" + _varint(len(file)) + file).digest()
    n, out = int.from_bytes(digest, "big"), ""
    while n:
        n, k = divmod(n, 58)
        out = _BASE58[k] + out
    return out


def _cid_v1(content: bytes) -> str | None:
    if len(content) > CID_BLOCK:
        return None
    raw = b"\x01\x55\x12\x20" + hashlib.sha256(content).digest()
    return "b" + base64.b32encode(raw).decode().rstrip("=").lower()


@F.pandas_udf(T.StringType())
def cid_v0(s: pd.Series) -> pd.Series:
    """The content identifier of version 0 of bytes that fit into one block: a file node's digest in base 58; else null."""
    return s.map(_cid_v0, na_action="ignore")


@F.pandas_udf(T.StringType())
def cid_v1(s: pd.Series) -> pd.Series:
    """The content identifier of version 1: the digest of the bytes themselves, a raw block, in base 32; null for more than a block."""
    return s.map(_cid_v1, na_action="ignore")


def sharded_path(root: Column, digest: Column, extension: Column) -> Column:
    """root/ab/cd/ef/digest.extension; null for digests of six characters or fewer."""
    part = lambda i: F.substring(digest, i, 2)
    return F.when(F.length(digest) > 6, F.concat_ws("/", root, part(1), part(3), part(5), F.concat(digest, F.lit("."), extension)))


def thumbnail_path(root: str, content: Column) -> Column:
    """Where a file's thumbnail lies, by the digest of its contents."""
    return sharded_path(F.lit(root), F.upper(F.sha2(content, 256)), F.lit("webp"))


def dated_path(root: str, epoch: Column) -> Column:
    """root/year/month/day of a time in epoch seconds."""
    return F.concat(F.lit(root + "/"), F.date_format(F.timestamp_seconds(epoch), "yyyy/MM/dd"))


def sniffed_extension(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(F.substring(head, 9, 8) == "66747970", "mp4")
    for magic, ext in MAGIC.items():
        out = out.when(head.startswith(magic), ext)
    return out


def verified(length: Column, expected_length: Column, digest: Column, expected_digest: Column) -> Column:
    """Do length and digest agree with what was announced? What wasn't announced agrees."""
    return (expected_length.isNull() | (length == expected_length)) & (expected_digest.isNull() | (F.lower(digest) == F.lower(expected_digest)))


def backoff_seconds(attempt: Column) -> Column:
    return F.pow(F.lit(2), F.least(attempt, F.lit(4))).cast("long")


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def storage_check(files: DataFrame, storage: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, id, status) of every recorded or listed file: ok, misplaced, missing or unknown.

    ``listing`` has (location, path) with paths below a location; a recorded file is expected in its own storage location.
    """
    want = files.filter("hash is not null").join(storage.select(F.col("id").alias("storage_id"), "location"), "storage_id")
    want = want.select("id", F.col("location").alias("expected"), F.regexp_replace(sharded_path(F.lit(""), F.col("hash"), F.col("extension")), "^/", "").alias("path")).filter("path is not null")
    both = want.join(listing, "path", "full")
    status = F.when(F.col("id").isNull(), "unknown").when(F.col("location").isNull(), "missing").when(F.col("location") == F.col("expected"), "ok").otherwise("misplaced")
    return both.select("path", "id", status.alias("status"))
