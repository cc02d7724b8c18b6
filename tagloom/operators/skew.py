"""Per-key results where a few keys hold most of the rows.

Nothing here gathers the rows of one key. A rank is resolved by histograms that are refined level by level: each level
counts, map side first, the bins inside the one that the rank is in, no more than ``2 ** FAN_BITS`` of them for a key and
target, whatever the key holds. For quantiles per key the levels are sums of one table of counts by key and value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.util import cut, ratio, whole

#: Children a histogram bin is split into at each refinement, as a power of two.
FAN_BITS = 10
#: Keys are heavy from one row in so many on, at the least.
MAX_RANKS = 10_000

_FLIP = np.int64(0x7FFF_FFFF_FFFF_FFFF)


@F.pandas_udf(T.LongType())
def _ordered_bits(s: pd.Series) -> pd.Series:
    bits = (s.astype("float64") + 0.0).to_numpy().view("int64")
    return pd.Series(np.where(bits < 0, bits ^ _FLIP, bits)).where(s.notna().to_numpy())


@F.pandas_udf(T.DoubleType())
def _from_ordered_bits(s: pd.Series) -> pd.Series:
    bits = s.to_numpy("int64")
    return pd.Series(np.where(bits < 0, bits ^ _FLIP, bits).astype("int64").view("float64"))


def _to_long(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _ordered_bits(c.cast("double"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    raise TypeError(f"ranks need numbers, dates or timestamps, not {kind.simpleString()}")


def _from_long(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _from_ordered_bits(c).cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(c)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(c.cast("int"))
    return c.cast(kind)


def select_ranks(counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value at each wanted rank, by refining histograms.

    ``counts`` has (``keys``, ``_v`` long, ``_n`` long), one row per key and value; ``targets`` has (``keys``, ``_t``,
    ``_rank`` long from 1). Returns (``keys``, ``_t``, ``_v``). It reads ``counts`` once a level, so hand it a written table.
    """
    keys = list(keys)
    span = counts.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    if span.lo is None:
        return targets.select(*keys, "_t", F.lit(0).cast("long").alias("_v")).filter(F.lit(False))
    pyramid = [counts.select(*keys, "_v", "_n")]
    lo, hi = span.lo, span.hi
    while hi - lo >= 1 << FAN_BITS:
        lo, hi = lo >> FAN_BITS, hi >> FAN_BITS
        pyramid.append(pyramid[-1].groupBy(*keys, F.shiftright("_v", FAN_BITS).alias("_v")).agg(F.sum("_n").alias("_n")))
    picked = targets.select(*keys, "_t", "_rank", F.lit(0).cast("long").alias("_up"))
    for depth, level in enumerate(reversed(pyramid)):
        up = F.lit(0).cast("long") if depth == 0 else F.shiftright("_v", FAN_BITS)
        bins = level.withColumn("_up", up).join(picked.select(*keys, "_up").distinct(), [*keys, "_up"])
        below = F.sum("_n").over(Window.partitionBy(*keys, "_up").orderBy("_v"))
        picked = (
            bins.withColumn("_below", below).join(picked, [*keys, "_up"])
            .filter((F.col("_below") >= F.col("_rank")) & (F.col("_below") - F.col("_n") < F.col("_rank")))
            .select(*keys, "_t", (F.col("_rank") - F.col("_below") + F.col("_n")).alias("_rank"), F.col("_v").alias("_up"))
        )
    return picked.select(*keys, "_t", F.col("_up").alias("_v"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: Column | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys``: (``keys``, prob double, n long, ``value``).

    The value at prob p is the one at rank ceil(p * n), 1 at least. Null values are not counted; a null key is a key like
    any other; a key without values has no row, an empty table gives none. Ties and repeated rows count as often as they
    occur. Not-a-number ranks above all numbers.
    """
    keys, kind = list(keys), df.schema[value].dataType
    rows = df.select(*[F.coalesce(F.to_json(F.struct(F.col(k).alias("k"))), F.lit("{}")).alias(f"_k{i}") for i, k in enumerate(keys)],
                     *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)],
                     _to_long(F.col(value), kind).alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    safe = [f"_k{i}" for i in range(len(keys))] or ["_k"]
    if not keys:
        rows = rows.withColumn("_k", F.lit(""))
    firsts = [F.first(f"_o{i}").alias(f"_o{i}") for i in range(len(keys))]
    counts = cut(rows.filter(F.col("_v").isNotNull()).groupBy(*safe, "_v").agg(F.sum("_w").alias("_n"), *firsts))
    sizes = counts.groupBy(*safe).agg(F.sum("_n").alias("n"), *firsts)
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(ratio(p)[0]).cast("long").alias("a"), F.lit(ratio(p)[1]).cast("long").alias("b")) for p in probs]))
    targets = (
        sizes.select("*", wanted.alias("_p"))
        .withColumn("_rank", F.greatest(F.lit(1).cast("long"), F.ceil(whole(F.col("n")) * F.col("_p.a") / F.col("_p.b")).cast("long")))
        .select(*safe, "_rank", F.struct("_p.p", "n", *[f"_o{i}" for i in range(len(keys))]).alias("_t"))
    )
    found = select_ranks(counts, targets, safe)
    return found.select(*[F.col(f"_t._o{i}").alias(k) for i, k in enumerate(keys)], F.col("_t.p").alias("prob"), F.col("_t.n").alias("n"), _from_long(F.col("_v"), kind).alias(value))


def heavy_keys(df: DataFrame, key: str, min_share: float) -> DataFrame:
    """Keys that hold at least ``min_share`` of all rows: (``key``, n_rows long).

    A key with s rows or more fills s neighbouring ranks of the sorted keys, so one of the ranks s, 2s, 3s ... falls on it.
    These ranks are selected top down: rows are counted in coarse bins of their keys' values, each rank is in one of them,
    the rows of these bins alone are counted in finer bins, and so on until a bin is a single value, whose count is exact by
    then. Keys are never counted one by one; a pass brings at most ``2 ** FAN_BITS`` counts for each rank, of which there
    are 1 / min_share at most (MAX_RANKS, else it is refused). A bin of fewer than s rows holds no such key and is let go.

    All rows count, repeated ones too; rows with a null key count in the total but are no key. An empty table gives no row.
    Keys that aren't whole numbers are ordered by their hash; the few found are counted once more by themselves.
    """
    a, b = ratio(min_share)
    if a <= 0 or b > a * MAX_RANKS:
        raise ValueError(f"a share of 1 / {MAX_RANKS} at least, not {min_share}")
    spark, kind = df.sparkSession, df.schema[key].dataType
    own = isinstance(kind, T.IntegralType)
    rows = df.select(F.col(key).alias("_key"), F.when(F.col(key).isNotNull(), F.col(key).cast("long") if own else F.xxhash64(key)).alias("_v"))
    span = rows.agg(F.count(F.lit(1)).alias("all"), F.count("_v").alias("held"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    step = max(1, -(-a * span["all"] // b))
    ranks = np.arange(step, span.held + 1, step, dtype="int64")
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_rows", T.LongType())])
    shift = 0
    while len(ranks) and (span.hi >> shift) - (span.lo >> shift) >= 1 << FAN_BITS:
        shift += FAN_BITS
    # Of each rank the bin it is in, and its rank among the rows of that bin.
    inside, found = np.zeros(len(ranks), "int64"), {}
    while len(ranks):
        here = rows.filter("_v is not null") if not found else rows.filter(F.shiftright("_v", shift + FAN_BITS).isin(list(found)))
        got = here.groupBy(F.shiftright("_v", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
        bins, n = got["bin"].to_numpy("int64"), got["n"].to_numpy("int64")
        # The bins of one parent lie side by side; ranks count from the parent's first row.
        upper = bins >> FAN_BITS if found else np.zeros(len(bins), "int64")
        running = np.cumsum(n)
        before = (running - n)[np.searchsorted(upper, inside, "left")] if len(bins) else inside
        at = np.searchsorted(running, ranks + before, "left")
        ranks, inside, large = ranks + before - (running - n)[at], bins[at], n[at] >= step
        ranks, inside = ranks[large], inside[large]
        found = dict(zip(bins[at][large].tolist(), n[at][large].tolist()))
        if not shift:
            break
        shift -= FAN_BITS
    if not len(ranks):
        return spark.createDataFrame([], schema)
    if own:
        return spark.createDataFrame(sorted(found.items()), schema)
    counted = rows.filter(F.col("_v").isin(list(found))).groupBy("_key").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= step)
    return counted.select(F.col("_key").alias(key), "n_rows")


def distinct_members(df: DataFrame, key: str, members: str, min_share: float) -> DataFrame:
    """Per ``key``: rows, distinct members of its sets, and whether it is heavy: (``key``, n_rows, n_members, heavy).

    Members are spread by (key, member) before they are counted, so no task sees all of a heavy key. Null members do not
    count; a key whose sets are all null or empty has 0 members. Rows with a null key are left out of the result and count
    in the total only.
    """
    exploded = df.select(F.col(key).alias("_k"), F.posexplode_outer(members).alias("_pos", "_m"))
    per_member = exploded.groupBy("_k", "_m").agg(F.count(F.when(F.coalesce(F.col("_pos"), F.lit(0)) == 0, 1)).alias("_rows"))
    per_key = per_member.groupBy("_k").agg(F.sum("_rows").alias("n_rows"), F.count("_m").alias("n_members"))
    heavy = heavy_keys(df, key, min_share).select(F.col(key).alias("_k"), F.lit(True).alias("heavy"))
    return per_key.filter(F.col("_k").isNotNull()).join(heavy, "_k", "left").select(F.col("_k").alias(key), "n_rows", "n_members", F.coalesce("heavy", F.lit(False)).alias("heavy"))
