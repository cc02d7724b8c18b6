"""How often every distinct term occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.util import ratio, whole


def normal_form(c: Column) -> Column:
    """Unicode letters and digits only, each lowered by itself; null stays null.

    A capital sigma lowers to the ordinary small sigma wherever it stands, as it does when characters are lowered one by one.
    """
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    return F.lower(F.regexp_replace(kept, "Σ", "σ"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of a sorted stream of (term, record, n, w): one row per term, which the last run of a batch carries over."""
    term, records, n, w = None, 0, 0, 0
    out = lambda t, r, k, x: pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(x, pa.int64())], names=["term", "n_records", "n", "total"])
    for b in batches:
        if not b.num_rows:
            continue
        terms = b.column(0)
        starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)]))
        firsts = terms.take(pa.array(starts)).to_pylist()
        sums = [np.add.reduceat(np.asarray(b.column(i)), starts).tolist() for i in (2, 3)]
        lengths = np.diff(np.append(starts, b.num_rows)).tolist()
        done = [[], [], [], []]
        for t, r, k, x in zip(firsts, lengths, *sums):
            if t == term:
                records, n, w = records + r, n + k, w + x
                continue
            if term is not None:
                for to, v in zip(done, (term, records, n, w)):
                    to.append(v)
            term, records, n, w = t, r, k, x
        if done[0]:
            yield out(*done)
    if term is not None:
        yield out([term], [records], [n], [w])


def term_counts(df: DataFrame, term: Column, record: Column, weight: Column | None = None) -> DataFrame:
    """Every distinct term: (term, n_records, n, total).

    ``n`` is the number of rows with the term, ``n_records`` that of distinct records, ``total`` the sum of ``weight`` (1 a
    row without one; null weights count 0). Null and empty terms are no terms; a null record is a record of its own.

    Rows are first combined per (term, record); these pairs are sorted by range, so a term's pairs lie side by side and a
    frequent term is split over as many ranges as it needs. A scan of run lengths counts each range, and the few terms
    that reach over a border are summed.
    """
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    rows = df.select(term.alias("_t"), record.cast("string").alias("_r"), w.cast("long").alias("_w")).filter(F.length("_t") > 0)
    pairs = rows.groupBy("_t", "_r").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"))
    ordered = pairs.repartitionByRange("_t", "_r").sortWithinPartitions("_t", "_r").select("_t", "_r", "_n", "_w")
    runs = ordered.mapInArrow(_runs, "term string, n_records long, n long, total long")
    return runs.groupBy("term").agg(F.sum("n_records").alias("n_records"), F.sum("n").alias("n"), F.sum("total").alias("total"))


def mark_terms(terms: DataFrame, whole_total: int, rare_below: int, common_share: float) -> DataFrame:
    """``terms`` with ``mark``: `rare` below ``rare_below``, else `common` from ``common_share`` of ``whole_total`` on, else null."""
    a, b = ratio(common_share)
    common = whole(F.col("total")) * b >= whole(F.lit(whole_total)) * a
    rare = F.col("total") < rare_below
    return terms.withColumn("mark", F.when(rare, "rare").when(common, "common"))
