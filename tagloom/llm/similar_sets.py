"""All pairs of records whose sets overlap above a similarity threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.util import cut, members, ratio, saved, whole

#: Of the tokens that a record has in common with any partner, so many at least are among those it may follow at a node.
COMMON = 2
#: How many of these it follows on average: from the root, and from every other node.
FOLLOWED, FOLLOWED_ON = 1.5, 2.0
#: A node with at most so many records is compared by brute force.
SMALL_NODE = 48
#: Tokens are counted in so many buckets: a table of fixed size tells every path how common its tokens are at most.
BUCKETS = 1 << 20
#: A path grows by at most so many tokens before its node is counted, and nodes are counted so many times.
MAX_DEPTH, MAX_TURNS = 12, 6
#: A record of a large node that has on average this share of the threshold in common with it is compared, not branched.
DENSE = 0.7
#: Up to so many large nodes, candidates or classes with copies (36 bytes each at most) are broadcast.
BROADCAST_ROWS = 200_000
#: Records of a large node that one task compares with the rest of the node.
SLICE = 2000

_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = (1 << 32) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def survival(common: int = COMMON, followed: float = FOLLOWED, followed_on: float = FOLLOWED_ON) -> float:
    """Chance that a pair at the threshold shares a path of any length in one tree, at the least.

    At a node each of ``common`` tokens or more that both may follow is followed with the same chance; beyond the root a
    path lasts with the chance that solves q = 1 - (1 - p * q) ** common, which the number of steps never goes below.
    """
    q = 1.0
    for _ in range(200):
        q = 1 - (1 - min(1.0, followed_on / common) * q) ** common
    return 1 - (1 - min(1.0, followed / common) * q) ** common


def trees_for(recall: float) -> int:
    """Trees after which a pair at the threshold has been compared with probability ``recall``, however deep its paths are."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - survival()))))


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (_mix(tokens.astype("uint64") * _B) % np.uint64(BUCKETS)).astype("int64")


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, "int64")
    for b in batches:
        counts += np.bincount(_bucket(np.asarray(b.column(0).flatten()).astype("int64")), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "c"])


def token_levels(sets: DataFrame, n_sets: int) -> np.ndarray:
    """An upper bound of each token's share, by bucket, as a power of two in eighths: BUCKETS bytes, whatever the data."""
    rows = sets.select("toks").mapInArrow(_count_buckets, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
    level = np.full(BUCKETS, 255, "uint8")
    got = rows.toArrow()
    shares = np.asarray(got.column("c")).astype("float64") / n_sets
    level[np.asarray(got.column("bucket"))] = np.minimum(255, np.floor(-8 * np.log2(np.minimum(1.0, shares)))).astype("uint8")
    return level


def _paths(trees: int, seed: int, levels: np.ndarray, target: float, part: str, num: int, den: int):
    """A function for mapInArrow: (cid, toks, side, root, logp, used) -> the nodes at which the record's paths end, and those it passes.

    A record of n tokens has at least c = ceil(n * num / den) in common with any partner, so at a node whose path has j tokens
    at least c - j of those left. It looks at its rarest tokens only, at as many as hold COMMON of these for certain, and
    follows each by the node's own hash, with a chance that depends on their number alone: two partners see the same rare
    tokens they have in common, and follow them together.

    A path ends where the product of its tokens' shares says that a node holds ``target`` records or fewer. Two records
    whose tokens in common are used up before part there: a record is put out as ``passing`` at each node whose path holds
    all it may have in common with a partner. ``part`` says which rows come out: `first` those that end at their first
    token, whose nodes are small for certain as shares are bounds, or `deep` all others.
    """
    stop = math.log(target)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 16384):
                yield from chunk(whole_batch.slice(at, 16384))

    def chunk(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cid = np.asarray(b.column(0))
        n = np.asarray(b.column(1).value_lengths()).astype("int64")
        flat = np.asarray(b.column(1).flatten()).astype("int64")
        if not len(flat):
            return
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        bucket = _bucket(flat)
        level = levels[bucket]
        # A record's tokens from the rarest on; ties go by the token's hash, the same in every record.
        order = np.lexsort((flat, bucket, -level.astype("int16"), owner))
        flat, level = flat[order], level[order]
        logp = level * (-math.log(2) / 8)
        bits = np.bitwise_xor.reduceat(np.int64(1) << (_mix(flat.astype("uint64") + _GOLD) & np.uint64(31)).astype("int64"), first[n > 0])
        packed = n << 34 | np.asarray(b.column(2)).astype("int64") << 32
        packed[n > 0] |= bits
        least = -(-n * num // den)
        sub = np.asarray(b.column(5).flatten()).astype("int64")
        n_used = np.asarray(b.column(5).value_lengths()).astype("int64")
        width = int(n_used.max()) if len(n_used) else 0
        old = np.full((len(cid), width), -1, "int64")
        if width:
            old[np.repeat(np.arange(len(cid)), n_used), np.arange(len(sub)) - np.repeat(np.cumsum(n_used) - n_used, n_used)] = sub
        rec = np.repeat(np.arange(len(cid)), trees)
        path = _mix(np.repeat(np.asarray(b.column(3)).view("uint64"), trees) + np.tile(np.arange(1 + seed * 1000, trees + 1 + seed * 1000, dtype="uint64"), len(cid)) * _GOLD)
        score = np.repeat(np.asarray(b.column(4)), trees)
        used = np.repeat(old, trees, axis=0)
        for step in range(MAX_DEPTH):
            if not len(rec):
                return
            depth = n_used[rec] + step
            left = n[rec] - depth
            sure = np.minimum(np.maximum(1, least[rec] - depth), np.maximum(1, left))
            few = np.minimum(COMMON, sure)
            chance = np.minimum(1.0, np.where(depth == 0, FOLLOWED, FOLLOWED_ON) / few)
            # The path's own tokens are passed over: so many more are looked at, and the first of the others kept.
            look = np.minimum(n[rec], left - sure + few + depth)
            row = np.repeat(np.arange(len(rec)), look)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(look) - look, look)
            pos = nth + first[rec[row]]
            if depth.any():
                fresh = np.ones(len(row), bool)
                for j in range(used.shape[1]):
                    # Records of one turn may come with paths of different lengths; what fills up the shorter is no token.
                    fresh &= (used[row, j] != flat[pos]) | ((n_used[rec[row]] <= j) if j < width else False)
                row, pos = row[fresh], pos[fresh]
                count = np.bincount(row, minlength=len(rec))
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                near = nth < (left - sure + few)[row]
                row, pos = row[near], pos[near]
            tok = flat[pos]
            h = _mix(path[row] ^ _mix(tok.astype("uint64") * _GOLD))
            chosen = (h >> np.uint64(11)).astype("float64") * 2.0**-53 < chance[row]
            row, pos, tok, h = row[chosen], pos[chosen], tok[chosen], h[chosen]
            rec, path, score, depth = rec[row], _mix(h + _GOLD), score[row] + logp[pos], depth[row] + 1
            over = score <= stop
            if step == 0:
                proven = over & (depth == 1)
                if part == "first":
                    yield pa.RecordBatch.from_pydict({"node": path[proven].view("int64"), "cid": cid[rec[proven]], "packed": packed[rec[proven]]})
                    return
            if step + 1 == MAX_DEPTH:
                over = np.ones(len(rec), bool)
            used = np.concatenate([used[row], tok[:, None]], axis=1)
            ends = over & ~proven if step == 0 else over
            passing = ~over & (depth >= least[rec])
            out = np.flatnonzero(ends | passing)
            if len(out):
                r, u = rec[out], used[out]
                held = (np.arange(u.shape[1]) < n_used[r][:, None]) | (np.arange(u.shape[1]) >= width)
                yield pa.RecordBatch.from_pydict({
                    "node": path[out].view("int64"), "cid": cid[r], "packed": packed[r], "depth": depth[out].astype("int32"), "passing": passing[out],
                    "used": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(depth[out])]).astype("int32")), pa.array(u[held])),
                })
            on = ~over & (depth < n[rec])
            rec, path, score, used = rec[on], path[on], score[on], used[on]

    return walk


_FIRST = "node long, cid long, packed long"
_DEEP = f"{_FIRST}, depth int, passing boolean, used array<long>"


def _size(packed: str) -> Column:
    return F.shiftright(packed, 34)


def _close(a: str, b: str, num: int, den: int) -> Column:
    """Can the two records reach the threshold, by their sides, sizes and bits? Never false for a pair that does."""
    na, nb = _size(a), _size(b)
    sides = F.shiftright(F.col(a).bitwiseOR(F.col(b)), 32).bitwiseAND(F.lit(3)) == 3
    differ = F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(_LOW)))
    # |a & b| = (na + nb - differing) / 2 and |a | b| = (na + nb + differing) / 2, with differing >= differ.
    return sides & (F.least(na, nb) * den >= F.greatest(na, nb) * num) & ((na + nb - differ) * den >= (na + nb + differ) * num)


def _scan(num: int, den: int):
    """Brute force over rows (node, cid, packed) sorted by node: each row is held against those after it at its node."""

    def pairs(node, cid, packed) -> pa.RecordBatch:
        left, right = [], []
        n, side, bits = packed >> 34, packed >> 32 & 3, packed & _LOW
        here = np.arange(len(node))
        step = 0
        while len(here):
            step += 1
            here = here[here + step < len(node)]
            here = here[node[here] == node[here + step]]
            i, j = here, here + step
            both, differ = n[i] + n[j], np.bitwise_count(bits[i] ^ bits[j]).astype("int64")
            ok = (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & ((both - differ) * den >= (both + differ) * num)
            ok &= (cid[i] != cid[j]) & (side[i] | side[j] == 3)
            left.append(cid[i[ok]])
            right.append(cid[j[ok]])
        a, b = np.concatenate(left or [np.zeros(0, "int64")]), np.concatenate(right or [np.zeros(0, "int64")])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["cid_a", "cid_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(i)) for i in range(3)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            # The last node of a batch may go on in the next one; a small node's rows are few.
            cut_at = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut_at:
                yield pairs(*[c[:cut_at] for c in cols])
            held = [c[cut_at:] for c in cols]
        if held is not None:
            yield pairs(*held)

    return run


def set_classes(records: DataFrame, record: str, values: str, min_size: int = 1, side: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal sets: membership (record, cid long), and (cid, toks, n, side) of each class.

    A class id is the least record id of the class. Values may be of any type; tokens are their hashes of 64 bits, ids
    themselves where they are whole numbers. Null values, repeats, and sets smaller than ``min_size`` are left out, and so
    are null records; of several rows with one record the greatest set counts. Equal sets are told by two hashes of 64 bits.
    ``side`` names a column with 1 for records of the left table and 2 for the right one; a class has the sum of its records'.
    """
    kind = records.schema[values].dataType.elementType.typeName()
    s = F.col(values) if kind in ("long", "integer", "short", "byte") else F.transform(values, lambda x: F.when(x.isNotNull(), F.xxhash64(x)))
    which = F.lit(3) if side is None else F.col(side).cast("int")
    rows = records.select(F.col(record).cast("long").alias("record"), members(s).cast("array<long>").alias("toks"), which.alias("side"))
    sets = saved(rows.filter(F.col("record").isNotNull() & (F.size("toks") >= min_size)))
    n = sets.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record").alias("d")).first()
    if n.n > n.d:
        sets = saved(sets.groupBy("record").agg(F.max(F.struct("toks", "side")).alias("m")).select("record", "m.*"))
    sets = sets.select("*", F.xxhash64("toks").alias("h"), F.xxhash64(F.lit(1), "toks").alias("h2"))
    same = sets.groupBy("h", "h2").agg(F.min("record").alias("cid"), F.count(F.lit(1)).alias("k"), F.bit_or("side").alias("sides"))
    shared = cut(same.filter("k > 1").select("h", "h2", "cid", "sides"))
    told = sets.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, ["h", "h2"], "left")
    member = told.select("record", F.coalesce("cid", "record").alias("cid"))
    classes = told.filter("cid is null or cid = record").select(F.col("record").alias("cid"), "toks", F.size("toks").alias("n"), F.coalesce("sides", "side").alias("side"))
    return member, classes


def similar_classes(classes: DataFrame, threshold: float, recall: float = 0.999, small_node: int = SMALL_NODE, seed: int = 0) -> DataFrame:
    """Pairs of different sets with Jaccard similarity ``threshold`` or more: (cid_a, cid_b, n_common, n_union), cid_a < cid_b.

    Chosen paths: at a node of a tree a record follows some of its rarer tokens, picked by the node's own hash; records at one
    node share all tokens of its path. A path goes on until its tokens' shares say that the node is small, so frequent
    tokens never end one. Nodes of up to ``small_node`` records are compared by brute force, sizes and a bitmap sieve the
    pairs, and the rest is verified on the sets themselves. Nodes of several tokens that are larger than foreseen, as their
    tokens occur together, are found by counting: those of their records that are like most of the node, or have no token
    left, are compared with the whole node in slices, the others are branched again from where they are. Records whose common
    tokens are all on the path by then would part at the next token: at nodes passed or branched again, those whose sizes and
    the path's length prove the threshold are paired.

    As many independent trees grow as give ``recall`` to a pair at the threshold, whatever the threshold and the depth of its
    paths. What is returned is exact. With a column ``side`` only pairs between the two tables are returned.
    """
    num, den = ratio(threshold)
    trees = trees_for(recall)
    n_classes = classes.count()
    schema = "cid_a long, cid_b long, n_common long, n_union long"
    if n_classes < 2:
        return classes.sparkSession.createDataFrame([], schema)
    sets = classes if "side" in classes.columns else classes.withColumn("side", F.lit(3))
    levels = token_levels(sets, n_classes)
    todo = sets.select("cid", "toks", "side", F.lit(0).cast("long").alias("root"), F.lit(0.0).alias("logp"), F.array().cast("array<long>").alias("used"))
    target = small_node / n_classes
    found = [_brute(todo.mapInArrow(_paths(trees, seed, levels, target, "first", num, den), _FIRST), num, den)]
    grown = trees
    for turn in range(MAX_TURNS):
        walked = saved(todo.mapInArrow(_paths(grown, seed + turn, levels, target, "deep", num, den), _DEEP))
        found.append(_proved(walked.filter("passing"), num, den))
        nodes = walked.filter("not passing")
        large = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > small_node))
        n_large = large.count()
        if n_large <= BROADCAST_ROWS:
            large = F.broadcast(large)
        found.append(_brute(nodes.join(large, "node", "left_anti") if n_large else nodes, num, den))
        if not n_large:
            break
        held = nodes.join(large, "node").withColumn("n", _size("packed"))
        # Of the last turn, and of records like most of their node, every pair is compared: branching would not part them.
        each = held.join(sets.select("cid", "toks"), "cid").select("node", "cid", "n", "c", F.explode("toks").alias("t"))
        shared = each.groupBy("node", "t").agg(F.count(F.lit(1)).alias("k"))
        alike = each.join(shared, ["node", "t"]).groupBy("node", "cid").agg((F.sum("k") / F.first(F.col("c") * F.col("n"))).alias("alike"))
        dense = (F.col("depth") >= F.col("n")) | (F.col("alike") >= DENSE * threshold) | F.lit(turn == MAX_TURNS - 1)
        held = saved(held.join(alike, ["node", "cid"]).withColumn("dense", dense))
        found.append(_brute_against(held.filter("dense"), held, num, den))
        found.append(_proved(held.filter("not dense"), num, den))
        todo = held.filter("not dense").join(sets.select("cid", "toks", "side"), "cid")
        todo = todo.select("cid", "toks", "side", F.col("node").alias("root"), F.log(F.col("c") / n_classes).alias("logp"), "used")
        if todo.isEmpty():
            break
        # A pair at the threshold is at one node here already, and goes on as from any node.
        grown = 1
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    pairs = cut(pairs.distinct())
    ids = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
    few = pairs.count() <= BROADCAST_ROWS
    # The sets of candidates alone are kept for the verification, so the others are not dealt out for it.
    asked = cut(sets.join(F.broadcast(ids) if few else ids, "cid", "left_semi").select("cid", "toks", "side"))
    both = pairs.join(asked.toDF("cid_a", "ta", "sa"), "cid_a").join(asked.toDF("cid_b", "tb", "sb"), "cid_b").filter(F.col("sa").bitwiseOR(F.col("sb")) == 3)
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    counted = both.select("cid_a", "cid_b", common.alias("n_common"), (F.size("ta") + F.size("tb") - common).alias("n_union"))
    return counted.filter(whole(F.col("n_common")) * den >= whole(F.col("n_union")) * num)


def _brute(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of records at one small node that may reach the threshold; rows are gathered by node once.

    They are dealt out by a hash of the node, not by the node itself: where a join on the node comes before, the planner takes
    rows as dealt out already, and may still read them map by map when that join turns into a broadcast.
    """
    ordered = nodes.select("node", "cid", "packed").repartition(F.xxhash64("node")).sortWithinPartitions("node")
    return ordered.mapInArrow(_scan(num, den), "cid_a long, cid_b long")


def _brute_against(some: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of ``some`` records with all at their large node, in slices of the node."""
    slices = F.ceil(F.col("c") / SLICE).cast("int")
    a = some.withColumn("slice", F.pmod(F.xxhash64("cid"), slices).cast("int")).select("node", "slice", F.col("cid").alias("x"), F.col("packed").alias("px"))
    b = nodes.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select("node", "slice", F.col("cid").alias("y"), F.col("packed").alias("py"))
    pairs = a.join(b, ["node", "slice"]).filter((F.col("x") != F.col("y")) & _close("px", "py", num, den))
    return pairs.select(F.least("x", "y").alias("cid_a"), F.greatest("x", "y").alias("cid_b"))


def _proved(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of records at one node that share at least its path, where that with their sizes proves the threshold.

    A record has n - depth tokens beside the path, and those of both may be depth * (den - num) / num at most. The join is on
    the number of them too, so that it makes no other pair than those.
    """
    beside = rows.select("node", "cid", (_size("packed") - F.col("depth")).cast("int").alias("e"), F.expr(f"cast(depth * {den - num}L div {num}L as int)").alias("most"))
    a = beside.filter("2 * e <= most").select("node", F.col("cid").alias("x"), F.col("e").alias("ex"), F.explode(F.sequence("e", F.col("most") - F.col("e"))).alias("e"))
    pairs = a.join(beside.select("node", "e", F.col("cid").alias("y")), ["node", "e"]).filter("ex < e or x < y")
    return pairs.select(F.least("x", "y").alias("cid_a"), F.greatest("x", "y").alias("cid_b"))


def similar_pairs(records: DataFrame, record: str, values: str, threshold: float, min_size: int = 1, recall: float = 0.999) -> DataFrame:
    """All pairs of records with Jaccard similarity ``threshold`` or more, copies included: (a, b, n_common, n_union), a < b.

    Classes of equal sets are compared as one; the pairs of a class's own copies and those of two similar classes come from
    joins on the class, whose output is the result itself.
    """
    member, classes = set_classes(records, record, values, min_size)
    across, twins = _expanded(member, classes, similar_classes(classes, threshold, recall))
    rows = across.unionByName(twins)
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n_common", "n_union")


def _expanded(member: DataFrame, classes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of records (x, y, n_common, n_union): of linked classes, and of one class, these with x < y."""
    of = lambda r, c: member.select(F.col("record").alias(r), F.col("cid").alias(c))
    across = links.join(of("x", "cid_a"), "cid_a").join(of("y", "cid_b"), "cid_b").select("x", "y", "n_common", "n_union")
    copies = cut(member.groupBy("cid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("cid"))
    sizes = classes.join(copies, "cid", "left_semi").select("cid", F.col("n").cast("long").alias("n_common"))
    twins = sizes.join(of("x", "cid"), "cid").join(of("y", "cid"), "cid").filter("x < y")
    return across, twins.select("x", "y", "n_common", F.col("n_common").alias("n_union"))


def similar_pairs_between(left: DataFrame, right: DataFrame, record: str, values: str, threshold: float, min_size: int = 1, recall: float = 0.999) -> DataFrame:
    """As ``similar_pairs``, between the records of two tables with the same columns: (a of ``left``, b of ``right``, n_common, n_union).

    Pairs within one table are sieved out before they are verified. Rows that repeat an id count as so many records, their
    pairs once.
    """
    tagged = left.select(F.col(record), F.col(values), F.lit(1).alias("_side")).unionByName(right.select(F.col(record), F.col(values), F.lit(2).alias("_side")))
    tagged = saved(tagged.filter(F.col(record).isNotNull()).withColumn("_row", F.monotonically_increasing_id()))
    member, classes = set_classes(tagged, "_row", values, min_size, "_side")
    across, twins = _expanded(member, classes, similar_classes(classes, threshold, recall))
    names = tagged.select("_row", "_side", F.col(record).alias("_id"))
    x = across.unionByName(twins).join(names.toDF("x", "sx", "ix"), "x").join(names.toDF("y", "sy", "iy"), "y").filter("sx <> sy")
    first = F.col("sx") == 1
    return x.select(F.when(first, F.col("ix")).otherwise(F.col("iy")).alias("a"), F.when(first, F.col("iy")).otherwise(F.col("ix")).alias("b"), "n_common", "n_union").distinct()
