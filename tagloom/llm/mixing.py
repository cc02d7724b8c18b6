"""Mixtures of sources with target shares of all tokens."""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import spread
from tagloom.util import cut

#: A public tokenizer: ranks of byte pairs, and the pattern that parts words (a fixed value that belongs to them).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slots that are scheduled together.
PERIOD = 1 << 16
#: A table of targets with more sources is refused, as it is held on the driver.
MAX_SOURCES = 10_000


@functools.lru_cache(maxsize=2)
def _tokenizer(name: str):
    """A tokenizer, read once in each Python worker from the file that the driver sent along."""
    import tiktoken

    with open(SparkFiles.get(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, tokenizer: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` and with the number of its tokens; a null text has 0.

    ``tokenizer`` is a file of ranks on the driver, which ships it to the executors.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    df.sparkSession.sparkContext.addFile(tokenizer)
    file = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(file).encode_ordinary
        for b in batches:
            sizes = [len(encode(x)) if x else 0 for x in b.column(b.schema.get_field_index("_text")).to_pylist()]
            cols = [b.column(b.schema.get_field_index(f"_c{i}")) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64())], names=[*[f"_c{i}" for i in range(len(kept))], "_n"])

    inner = spread(df.select(*[F.col(f.name).alias(f"_c{i}") for i, f in enumerate(kept)], F.col(text).alias("_text")))
    schema = ", ".join([*[f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)], "_n long"])
    return inner.mapInArrow(count, schema).select(*[F.col(f"_c{i}").alias(f.name) for i, f in enumerate(kept)], F.col("_n").alias(name))


def source_key(c: Column) -> Column:
    """One spelling for a source's spellings: lower case, trimmed, runs of space, dash and underscore as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_")


def pfair_slots(blocks: Sequence[int]) -> list[int]:
    """Which source each slot goes to, where source i has ``blocks[i]`` blocks and there are as many slots as blocks.

    With weight w = blocks[i] / slots, block k of a source is released at floor(k / w) and due at ceil((k + 1) / w); each slot
    goes to the released block that is due first. The weights together are 1, so every deadline is met, every slot is
    filled, and no source is ever a whole block away from its weight.
    """
    n = sum(blocks)
    waiting = [(0, i) for i, b in enumerate(blocks) if b > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    taken = [0] * len(blocks)
    out = []
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(taken[i] + 1) * n // blocks[i]), i))
        i = heapq.heappop(ready)[1]
        out.append(i)
        taken[i] += 1
        if taken[i] < blocks[i]:
            heapq.heappush(waiting, (taken[i] * n // blocks[i], i))
    return out


def period_starts(blocks: Sequence[int], period: int) -> Iterator[list[int]]:
    """How many blocks each source has had at slot 0, ``period``, 2 * ``period`` ... and at the end.

    At slot t source i has had floor(t * w) or ceil(t * w) of its blocks, never fewer than before; of those that may have one
    more, the ones whose next block is due first have it.
    """
    n = sum(blocks)
    have = [0] * len(blocks)
    yield have
    for t in [*range(period, n, period), n]:
        low = [max(h, b * t // n) for h, b in zip(have, blocks)]
        more = sorted((-(-(low[i] + 1) * n // b), i) for i, b in enumerate(blocks) if low[i] * n < b * t)
        for _, i in more[:t - sum(low)]:
            low[i] += 1
        have = low
        yield have


def _schedule(blocks: Sequence[int], period: int):
    """A function for mapInArrow: (id of a period) -> (source's number, its block, slot). A period's slots depend on its number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = set(b.column(0).to_pylist())
            before: list[int] = []
            for p, now in enumerate(period_starts(blocks, period)):
                if p - 1 in wanted:
                    order = np.array(pfair_slots([y - x for x, y in zip(before, now)]), dtype="int64")
                    block = np.zeros(len(order), dtype="int64")
                    for i in np.unique(order):
                        at = np.flatnonzero(order == i)
                        block[at] = before[i] + np.arange(len(at))
                    slots = np.arange(len(order)) + (p - 1) * period
                    yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(block), pa.array(slots)], names=["_i", "_k", "slot"])
                before = now
                if p > max(wanted):
                    break

    return run


def mixture(docs: DataFrame, doc_id: str, source: str, tokens: str, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 4096, rows_per_task: int = 200_000, period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """A mixture of whole documents, and the shares it reaches.

    ``targets`` has (source, target_share, max_repeats) with MAX_SOURCES sources at most. Returns

    * (doc_id, source, repeat, n_tokens, slot, place): the mixture in the order of (slot, place); ``repeat`` counts a
      document's uses from 0;
    * (source, target_share, max_repeats, available_tokens, n_docs, block_tokens, mixed_tokens, reached_share), one row per target.

    The mixture is the largest in which no document is used more than max_repeats times: its size is the least of
    max_repeats * tokens / share over the sources that have tokens. With ``total_tokens`` the mixture has that size instead, and
    a source that can't fill its share within max_repeats gives all it may, its shortfall shown by the report. The shares of
    sources without any are spread over the others; documents of sources without a target, without id or without tokens
    take no part. A source's documents follow each other in an order drawn by hash; its last one is the one that reaches its
    share, so it is over by less than a document. Ids that occur twice are two documents. Spellings of a source in ``targets``
    are taken together, the shares summed and the least max_repeats kept; null or non-positive shares and repeats take nothing.

    A source's part is scheduled in blocks of half of ``block_tokens``, whatever the mixture's size: blocks have release
    times and deadlines, the earliest deadline goes first. Slots are dealt out in periods: how many blocks each source has
    had when a period begins is found by arithmetic alone, so periods are scheduled side by side on the executors. A source
    strays from its weight by less than one half block at a period's ends and by less than another inside: by less
    than ``block_tokens``, beside the length of a document that is placed where it begins.

    Positions inside a source are sums over ranges of its documents' hashes, then sums within a range, so no task orders a
    whole source. Neither ``rows_per_task`` nor ``period`` changes which documents are used; ``rows_per_task`` changes no row.
    """
    spark = docs.sparkSession
    want = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("decimal(20,12)").alias("w"), F.col("max_repeats").cast("long").alias("m"))
    want = want.filter("source is not null").groupBy("source").agg(F.sum(F.greatest("w", F.lit(0))).alias("w"), F.min("m").alias("m"))
    wanted = {r.source: (Fraction(r.w or 0), max(0, r.m or 0)) for r in want.limit(MAX_SOURCES + 1).collect()}
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = docs.select(F.col(doc_id).alias("_id"), source_key(F.col(source)).alias("_s"), F.col(tokens).cast("long").alias("_n"))
    rows = cut(rows.filter("_id is not null and _n > 0").join(F.broadcast(want.select(F.col("source").alias("_s"))), "_s", "left_semi"))
    have = {r._s: (r.t, r.c) for r in rows.groupBy("_s").agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("c")).collect()}
    live = {s: w for s, (w, m) in wanted.items() if w > 0 and m > 0 and s in have}
    share = {s: w / sum(live.values()) for s, w in live.items()}
    size = min((wanted[s][1] * have[s][0] / share[s] for s in share), default=Fraction(0))
    if total_tokens is not None:
        size = Fraction(total_tokens)
    quota = {s: max(1, min(int(share[s] * size), wanted[s][1] * have[s][0])) for s in share}
    block = max(1, block_tokens // 2)
    out_schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, source string, repeat long, n_tokens long, slot long, place long"
    report = [(s, float(w), m, have.get(s, (0, 0))[0], have.get(s, (0, 0))[1], block_tokens) for s, (w, m) in sorted(wanted.items())]
    report = spark.createDataFrame(report, "source string, target_share double, max_repeats long, available_tokens long, n_docs long, block_tokens long")
    if not share:
        mixed = spark.createDataFrame([], out_schema)
    else:
        most = max(c for _, c in have.values())
        buckets = max(1, -(-most // rows_per_task))
        names = sorted(share)
        n_blocks = [-(-quota[s] // block) for s in names]
        plan = spark.createDataFrame([(i, s, quota[s], have[s][0]) for i, s in enumerate(names)], "_i long, _s string, _quota long, _have long")
        # Ranges of the hash, so that documents are in its order for any number of them.
        top = F.shiftright(F.col("_h"), 32) + F.lit(2**31)
        placed = rows.join(F.broadcast(plan), "_s").withColumn("_h", F.xxhash64(F.col("_id"), F.lit(17)))
        placed = placed.withColumn("_b", F.shiftright(top * F.lit(buckets).cast("long"), 32))
        sums = placed.groupBy("_s", "_b").agg(F.sum("_n").alias("_t"))
        before = sums.select("_s", "_b", (F.sum("_t").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_t")).alias("_base"))
        inside = Window.partitionBy("_s", "_b").orderBy("_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, 0)
        starts = placed.withColumn("_cum", F.sum("_n").over(inside) - F.col("_n")).join(before, ["_s", "_b"])
        starts = starts.withColumn("_start", F.col("_base") + F.col("_cum"))
        # Pass r begins r * have tokens later; a document is in it if it begins before the quota is reached.
        passes = F.ceil((F.col("_quota") - F.col("_start")) / F.col("_have")).cast("long")
        used = starts.filter(F.col("_start") < F.col("_quota")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("_r"))
        used = used.withColumn("_at", F.col("_start") + F.col("_r") * F.col("_have")).withColumn("_k", F.floor(F.col("_at") / block).cast("long"))
        slotted = spark.range(0, -(-sum(n_blocks) // period)).mapInArrow(_schedule(n_blocks, period), "_i long, _k long, slot long")
        mixed = used.join(slotted, ["_i", "_k"]).select(
            F.col("_id").alias(doc_id), F.col("_s").alias("source"), F.col("_r").alias("repeat"), F.col("_n").alias("n_tokens"), "slot", F.col("_at").alias("place"),
        )
    mixed = cut(mixed)
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    total = got.agg(F.sum("mixed_tokens")).first()[0] or 0
    shares = report.join(F.broadcast(got), "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("long"))
    return mixed, shares.withColumn("reached_share", F.when(F.lit(total) > 0, F.col("mixed_tokens") / F.lit(total)))
