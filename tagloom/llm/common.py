"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions to use all cores in a stage that computes much.

    A table of many splits, as any large one, stays as it is, and so do rows that a shuffle has dealt out; a table of a few
    splits is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df.rdd.getNumPartitions() >= 4 * cores else df.repartition(4 * cores)


def runs_of(texts: list[str | None], rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts as (start, end), up to ``rows`` of them or ``chars`` characters: what fits into memory at once."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (i - start >= rows or size + n > chars):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
