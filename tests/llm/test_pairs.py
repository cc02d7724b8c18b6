import itertools
import random

import pytest

from tagloom.llm import cooccurrence, leakage, similar_sets, vocabulary

from pyspark.sql import functions as F


def brute_pairs(baskets):
    sets = [set(b) - {None} for b in baskets if b]
    sets = [s for s in sets if s]
    n = {}
    both = {}
    for s in sets:
        for x in s:
            n[x] = n.get(x, 0) + 1
        for p in itertools.combinations(sorted(s), 2):
            both[p] = both.get(p, 0) + 1
    return len(sets), n, both


@pytest.mark.parametrize("min_count, lift", [(1, 0), (3, 0), (3, 2), (5, 1.5)])
def test_cooccurrences(spark, min_count, lift):
    r = random.Random(4)
    baskets = [[r.choice([1, 2, 3, r.randint(4, 12), None]) for _ in range(r.randint(0, 6))] for _ in range(200)] + [None, [], [None]] + [[50, 51]] * 6
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(baskets)], "id long, items array<long>, n_a string")
    total, n, both = brute_pairs(baskets)
    want = {(a, b): (n[a], n[b], c, total) for (a, b), c in both.items() if c >= min_count and c * total >= lift * n[a] * n[b]}
    got = {(x.item_a, x.item_b): (x.n_a, x.n_b, x.n_ab, x.n_baskets) for x in cooccurrence.cooccurrences(df, "id", "items", min_count, lift).collect()}
    assert got == want


@pytest.mark.parametrize("min_count", [1, 2])
def test_a_huge_basket_is_taken_apart(spark, min_count):
    baskets = [list(range(50)), list(range(20, 45)), [3], [7, 8, 9, 10, 11, 12, 13, 14], list(range(0, 50, 3))]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "id long, items array<long>")
    _, n, both = brute_pairs(baskets)
    got = {(x.item_a, x.item_b): (x.n_a, x.n_b, x.n_ab) for x in cooccurrence.cooccurrences(df, "id", "items", min_count, block=4).collect()}
    assert got == {(a, b): (n[a], n[b], c) for (a, b), c in both.items() if c >= min_count}


def test_cooccurrences_of_nothing(spark):
    df = spark.createDataFrame([], "id long, items array<long>")
    assert cooccurrence.cooccurrences(df, "id", "items").count() == 0


def test_all_pairs_of_tags_come_out(spark, rows, tmp_path):
    import __spark_entry__ as entry

    sets = spark.createDataFrame([(1, [1, 2, None]), (2, [2, 3, 1]), (3, []), (4, [4])], "fileid long, tagid_bitmap array<long>")
    sets.withColumn("written_at", F.lit("2020-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/relationship_roaring_fileid.parquet")
    assert rows(entry.queries()["p1_pairs"](spark, str(tmp_path)).select("tag_a", "tag_b", "n_ab", "n_baskets", "lift")) == [(1, 2, 2, 3, 1.5), (1, 3, 1, 3, 1.5), (2, 3, 1, 3, 1.5)]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_similar(sets, threshold, least):
    sets = {k: set(v) - {None} for k, v in sets.items() if v}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= least and len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * round(threshold * 100)}


def noisy_sets(r, n):
    """Sets around common tokens, with near copies of each other, copies and a big cluster."""
    out = {}
    for i in range(n):
        base = [r.choice(range(5)) for _ in range(3)] + [r.randint(10, 4000) for _ in range(r.randint(3, 9))]
        out[len(out)] = base
        if r.random() < 0.2:
            near = list(base)
            near[r.randrange(len(near))] = r.randint(5000, 9000)
            out[len(out)] = near
        if r.random() < 0.1:
            out[len(out)] = base + [None, base[0]]
    core = list(range(100, 116))
    for i in range(120):
        out[len(out)] = core + [20_000 + i, 30_000 + i % 40]
    out[len(out)] = core
    out[len(out)] = core + [20_000]
    out[len(out)], out[len(out) + 1], out[len(out) + 2] = None, [], [None]
    return out


@pytest.mark.parametrize("threshold, broadcast, ids", [(0.8, "10m", 10**6), (0.6, "10m", 10**6), (0.8, "1k", 10**6), (0.8, "1k", 0), (0.8, "-1", 0)])
def test_similar_pairs(spark, threshold, broadcast, ids, monkeypatch):
    monkeypatch.setattr(similar_sets, "BROADCAST_ROWS", ids)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    sets = noisy_sets(random.Random(7), 600)
    df = spark.createDataFrame([(k, v, 1) for k, v in sets.items()] + [(None, [1, 2, 3, 4, 5], 1)], "id long, toks array<long>, cid int")
    want = brute_similar(sets, threshold, 5)
    rows = similar_sets.similar_pairs(df, "id", "toks", threshold, 5).collect()
    got = {(r.a, r.b) for r in rows}
    assert len(rows) == len(got) and got <= want and len(want) > 2000
    assert len(got) >= 0.99 * len(want)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_similar_sets_of_popular_tokens_only(spark):
    """Their common tokens are used up before the shares of these say that a node is small."""
    r = random.Random(11)
    sets = {i: [t for t in range(12) if r.random() < 0.4] + [100 + 6 * i + j for j in range(6)] for i in range(20_000)}
    want = set()
    for k in (4, 5, 6, 7, 8):
        for _ in range(12):
            base = r.sample(range(12), k)
            both = [base, base + [10**6 + len(sets)]]
            if k == 8:
                both = [base + [10**6 + len(sets)], base + [10**7 + len(sets)]]
            for b in both:
                sets[len(sets)] = b
            want.add((len(sets) - 2, len(sets) - 1))
    df = spark.createDataFrame(list(sets.items()), "id long, toks array<long>").repartition(4)
    got = {(x.a, x.b) for x in similar_sets.similar_pairs(df, "id", "toks", 0.8, 4).collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert all(jaccard(set(sets[a]), set(sets[b])) >= 0.8 for a, b in got)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_recall_at_the_threshold(spark, threshold):
    """Pairs that are no more similar than they must be, among others, with tokens that are rare, frequent, and frequent together."""
    r = random.Random(13)
    frequent = lambda: r.sample(range(40), r.randint(0, 5))
    sets, want = {}, set()
    for i in range(9000):
        sets[len(sets)] = frequent() + [r.randint(100, 2000) for _ in range(r.randint(4, 9))] + ([50, 51, 52, 53] if i % 3 else [])
    for i in range(400):
        n = r.randint(6, 14)
        common = -(-n * 2 * round(threshold * 10) // (10 + round(threshold * 10)))
        both = r.sample(range(40), min(common, r.randint(0, 6)))
        both += [r.randint(100, 2000) for _ in range(common - len(both))]
        for k in range(2):
            sets[len(sets)] = both + [10**6 * (k + 1) + 100 * i + j for j in range(n - common)]
        a, b = set(sets[len(sets) - 2]), set(sets[len(sets) - 1])
        if a != b and jaccard(a, b) >= threshold:
            want.add((len(sets) - 2, len(sets) - 1))
    df = spark.createDataFrame(list(sets.items()), "id long, toks array<long>").repartition(4)
    got = {(x.a, x.b) for x in similar_sets.similar_pairs(df, "id", "toks", threshold).collect()}
    assert len(want) > 250 and len(want & got) >= 0.98 * len(want)
    assert all(jaccard(set(sets[a]), set(sets[b])) >= threshold for a, b in got)


def test_paths_do_not_depend_on_the_others_of_a_batch():
    import numpy as np
    import pyarrow as pa

    def ends(rows, part):
        cid, used = [r[0] for r in rows], [r[1] for r in rows]
        cols = [pa.array(cid), pa.array([list(range(12))] * len(rows)), pa.array([3] * len(rows)), pa.array([77] * len(rows)), pa.array([-0.5] * len(rows)), pa.array(used, pa.list_(pa.int64()))]
        walk = similar_sets._paths(4, 1, np.full(similar_sets.BUCKETS, 8, "uint8"), 0.02 if part == "deep" else 0.9, part, 4, 5)
        out = pa.Table.from_batches(list(walk([pa.RecordBatch.from_arrays(cols, names=list("abcdef"))]))).to_pylist()
        return sorted((tuple(sorted(x.items(), key=str)) for x in out if x["cid"] == 1), key=str)

    for part, used in (("first", []), ("deep", [3])):
        assert len(ends([(1, used)], part)) > 0
        assert str(ends([(1, used)], part)) == str(ends([(1, used), (2, [0, 1, 2, 3, 4, 5])], part))


def test_records_that_repeat(spark, rows):
    df = spark.createDataFrame([(1, [1, 2, 3]), (1, [1, 2, 3]), (2, [1, 2, 3]), (3, [9]), (3, [9, 10, 11]), (4, [9, 10, 11])], "id long, toks array<long>")
    assert rows(similar_sets.similar_pairs(df, "id", "toks", 0.8).select("a", "b")) == [(1, 2), (3, 4)]


def test_similar_pairs_of_text_between_tables(spark):
    a = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, ["x"])], "id long, t array<string>")
    b = spark.createDataFrame([(1, ["a", "b", "c", "d", "e", None]), (2, ["a", "b", "c", "d", "f"]), (3, ["a", "b", "c", "d", "e", "g"])], "id long, t array<string>")
    got = sorted((r.a, r.b) for r in similar_sets.similar_pairs_between(a, b, "id", "t", 0.8).collect())
    assert got == [(1, 1), (1, 3)]
    assert similar_sets.similar_pairs(a.limit(0), "id", "t", 0.8).count() == 0


def test_trees_reach_the_recall():
    assert similar_sets.trees_for(0.999) > similar_sets.trees_for(0.9) >= 1
    assert 1 - (1 - similar_sets.survival()) ** similar_sets.trees_for(0.995) >= 0.995


def test_terms(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "A", "Bb", "ß", "ΑΣ", "", None, " !", "é"]), r.choice([1, 2, 3, None]), r.choice([None, 1, 5])) for _ in range(300)] + [("hot", i, 1) for i in range(2000)] + [("hot", 1, 1)] * 500
    df = spark.createDataFrame(data, "t string, id long, c long").repartition(7)
    want = {}
    for t, i, c in data:
        k = "".join(x.lower() for x in t or "" if x.isalnum())
        if k:
            w = want.setdefault(k, [set(), 0, 0])
            w[0].add(i)
            w[1] += 1
            w[2] += c or 0
    got = {x.term: (x.n_records, x.n, x.total) for x in vocabulary.term_counts(df, vocabulary.normal_form(F.col("t")), F.col("id"), F.col("c")).collect()}
    assert got == {k: (len(a), b, c) for k, (a, b, c) in want.items()}
    assert vocabulary.term_counts(df.limit(0), F.col("t"), F.col("id")).count() == 0


def test_normal_form_keeps_letters_and_digits(spark, rows):
    df = spark.createDataFrame([("ΟΔΟΣ", ), ("ὁδός", ), ("हिन्दी 2", ), ("ไทย", ), ("Ⅷ-é́ß", )], "t string")
    assert [r[0] for r in df.select(vocabulary.normal_form(F.col("t"))).collect()] == ["οδοσ", "ὁδός", "हनद2", "ไทย", "ⅷéß"]


def test_marks(spark):
    df = spark.createDataFrame([("a", 4), ("b", 5), ("c", 400), ("d", 399)], "term string, total long")
    assert [r.mark for r in vocabulary.mark_terms(df, 100_000, 5, 0.004).orderBy("term").collect()] == ["rare", None, "common", None]


def words(r, n):
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()) for _ in range(n)]


def test_leaks(spark):
    r = random.Random(6)
    items = [(i, " ".join(words(r, 30))) for i in range(5)] + [(5, "今天我们要去很远的地方看一看那里的山和水然后再慢慢地走回家里来吃饭"), (6, "too short"), (7, None), (None, "x")]
    docs = []
    for k, (i, t) in enumerate(items[:5]):
        w = t.split()
        docs.append((10 + k, " ".join(words(r, 20)) + " " + " ".join(w[5:17]).upper().replace(" ", ",  ") + "! " + " ".join(words(r, 9)), i, 0))
        changed = w[5:17]
        changed[6] = "omega"
        docs.append((30 + k, "so " + " ".join(changed) + " and on", i, 1))
        docs.append((50 + k, "so " + " ".join(w[5:11]) + " omega omega omega omega " + " ".join(w[11:17]), None, None))
    docs.append((70, "他说：今天我们要去很远的地方，看一看那里的山和水；然后再慢慢地走。", 5, 0))
    docs += [(80, None, None, None), (81, "", None, None), (82, "ΣΑΣ é" * 50, None, None)]
    got = {(x.doc, x.item): x.edits for x in leakage.leaks(leakage.leaked_passages(spark.createDataFrame([(d, t, 1) for d, t, *_ in docs], "doc_id long, text string, item int"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")).collect()}
    want = {(d, i): e for d, _, i, e in docs if i is not None}
    assert {k: v for k, v in got.items() if v == 0} == {k: v for k, v in want.items() if v == 0}
    assert len({k for k in want if k in got}) >= len(want) - 1 and set(got) <= set(want)


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_of_edited_passages(spark, edits):
    """Copies of passages with one or two words replaced, left out or put in between, in items and documents of many words."""
    r = random.Random(20 + edits)
    some = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    items = [(i, some(40)) for i in range(60)]
    docs, want = [], set()
    for k in range(600):
        i, w = r.choice(items)
        at = r.randint(0, 28)
        part = w[at:at + 12]
        if edits == 1 or r.random() < 0.5:
            for p in r.sample(range(12), edits):
                part[p] = "zz"
        else:
            del part[r.randint(1, 10)]
            part.insert(r.randint(1, 10), "zz")
        docs.append((k, " ".join(some(15) + part + some(15))))
        want.add((k, i))
    found = leakage.leaks(leakage.leaked_passages(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(i, " ".join(w)) for i, w in items], "i long, t string"), "i", "t", edits, block_windows=800)).collect()
    got = {(x.doc, x.item) for x in found}
    assert len(want & got) >= 0.95 * len(want) and got <= want and all(x.edits <= edits for x in found)


def test_repetitions_that_cannot_reach_the_recall_are_an_error(monkeypatch):
    import numpy as np

    monkeypatch.setattr(leakage, "MAX_REPETITIONS", 2)
    units = np.arange(1, 200, dtype="uint64") * np.uint64(2**40 + 1)
    with pytest.raises(ValueError):
        leakage._Index.of([1], units, np.array([len(units)]), 12, 3, 0.99)


def test_edit_distances_agree_with_the_plain_recurrence():
    import numpy as np

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = np.random.default_rng(1)
    a, b = r.integers(0, 3, (300, 8)).astype("uint64"), r.integers(0, 3, (300, 8)).astype("uint64")
    got = leakage.edit_distances(a, b, 3)
    assert got.tolist() == [min(4, plain(x.tolist(), y.tolist())) for x, y in zip(a, b)]


def test_accents_and_case_do_not_matter():
    assert leakage.plain("ÉCOLE Straße İş") == leakage.plain("ecole STRASSE is")
