"""Items that appear together more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.util import cut, members, ratio, saved, whole

#: Items of a basket that are paired in one place; a larger basket is taken apart, and its parts are paired two by two.
BLOCK = 1024


def _pairs_within(parts: DataFrame) -> DataFrame:
    """All (item_a, item_b), item_a before item_b, inside each row's sorted ``_s``."""
    return (
        parts.filter(F.size("_s") > 1).select(F.posexplode("_s").alias("_p", "item_a"), "_s")
        .select("item_a", F.explode(F.slice("_s", F.col("_p") + 2, F.size("_s"))).alias("item_b"))
    )


def _pairs_across(parts: DataFrame) -> DataFrame:
    """The same between different parts of one basket, which lie in the order of their items.

    Each two parts of a basket meet at a place of their own, so a huge basket is spread over many tasks.
    """
    places = parts.filter("_parts > 1").select("_id", "_k", "_s", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_o")).filter("_o <> _k")
    met = (
        places.groupBy("_id", F.least("_k", "_o").alias("_i"), F.greatest("_k", "_o").alias("_j"))
        .agg(F.sort_array(F.collect_list(F.struct("_k", "_s"))).alias("_two")).filter(F.size("_two") == 2)
    )
    return met.select(F.explode(F.col("_two")[0]["_s"]).alias("item_a"), F.col("_two")[1]["_s"].alias("_s")).select("item_a", F.explode("_s").alias("item_b"))


def cooccurrences(baskets: DataFrame, basket: str, items: str, min_count: int = 1, min_lift: float = 0, block: int = BLOCK) -> DataFrame:
    """Pairs of items that share baskets: (item_a, item_b, n_a, n_b, n_ab, n_baskets, lift, pmi), item_a < item_b.

    ``baskets`` has one row per basket; a basket's items count once each, null items and baskets without items don't
    count. Kept are pairs in at least ``min_count`` baskets whose lift n_ab * N / (n_a * n_b) is at least ``min_lift``; both
    are compared in whole numbers, so ties at a threshold are kept.

    Two bounds drop items before pairs are made, without changing the result: an item in fewer than ``min_count`` baskets
    has no such pair, and neither has one with n * ``min_lift`` > N, as n_ab is at most the count of the rarer item. Pairs
    are made of ``block`` items of a basket at once and summed on the map side before the shuffle. An empty table gives no row.
    """
    num, den = ratio(min_lift)
    sets = baskets.select(members(F.col(items)).alias("_s")).filter(F.size("_s") > 0)
    sets = saved(sets.withColumn("_id", F.monotonically_increasing_id()))
    total = sets.count()
    singles = cut(sets.select(F.explode("_s").alias("_i")).groupBy("_i").agg(F.count(F.lit(1)).alias("_n")))
    useful = singles.filter(F.col("_n") >= min_count).filter(whole(F.col("_n")) * num <= whole(F.lit(total)) * den)
    n_parts = F.ceil(F.size("_s") / block).cast("int")
    if min_count > 1 or num:
        each = sets.select("_id", n_parts.alias("_parts"), F.posexplode("_s").alias("_p", "_i")).join(useful.select("_i"), "_i", "left_semi")
        parts = each.groupBy("_id", "_parts", F.floor(F.col("_p") / block).cast("int").alias("_k")).agg(F.sort_array(F.collect_list("_i")).alias("_s"))
    else:
        slices = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda k: F.struct(k.alias("_k"), F.slice("_s", k * block + 1, F.lit(block)).alias("_s")))
        parts = sets.select("_id", n_parts.alias("_parts"), F.inline(slices))
    pairs = (
        _pairs_within(parts).unionByName(_pairs_across(parts))
        .groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= min_count)
    )
    counted = (
        pairs.join(useful.select(F.col("_i").alias("item_a"), F.col("_n").alias("n_a")), "item_a")
        .join(useful.select(F.col("_i").alias("item_b"), F.col("_n").alias("n_b")), "item_b")
        .filter(whole(F.col("n_ab")) * F.lit(total) * den >= whole(F.col("n_a")) * F.col("n_b") * num)
    )
    lift = F.col("n_ab").cast("double") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return counted.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.lit(total).cast("long").alias("n_baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"))
