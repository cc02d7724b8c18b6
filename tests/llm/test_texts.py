import pytest
from pyspark.sql import functions as F

from tagloom.llm import mixing, pii, pii_seeds, sentences

TARGETS = [("big", 0.5, 1), (" BIG ", 0.1, 3), ("small", 0.3, 4), ("gone", 0.2, 2), (None, 0.5, 1), ("never", 0.1, 0)]


def mix(spark, docs, **more):
    return mixing.mixture(spark.createDataFrame(docs, "id long, src string, n long, source string"), "id", "src", "n", spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long"), **more)


def test_mixture_reaches_its_shares(spark):
    docs = [(i, ["big", "Big ", "big"][i % 3], 50 + i % 70, "z") for i in range(3000)] + [(10_000 + i, "small", 40 + i % 9, "z") for i in range(300)] + [(i, s, n, "z") for i, s, n in ((1, "never", 5), (2, None, 5), (None, "big", 5), (3, "small", 0), (4, "other", 9))]
    mixed, shares = mix(spark, docs, block_tokens=512, rows_per_task=100)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "small", "gone", "never"} and got["gone"].mixed_tokens == got["never"].mixed_tokens == 0
    assert abs(got["big"].reached_share - 0.6 / 0.9) < 0.005 and abs(got["small"].reached_share - 0.3 / 0.9) < 0.005
    uses = {(r.source, r.id): (r.n, r.most) for r in mixed.groupBy("source", "id").agg(F.count("*").alias("n"), F.max("repeat").alias("most")).collect()}
    assert all(n == most + 1 and n <= {"big": 1, "small": 4}[s] for (s, _), (n, most) in uses.items())
    order = mixed.orderBy("slot", "place").collect()
    have, block = {"big": 0, "small": 0}, 512 + 120
    for r in order:
        have[r.source] += r.n_tokens
        total = sum(have.values())
        assert abs(have["small"] - total / 3) < 2 * block


def test_mixture_does_not_depend_on_how_the_work_is_parted(spark):
    docs = [(i, "big", 7 + i % 5, "") for i in range(4000)] + [(10_000 + i, "small", 10, "") for i in range(50)]
    rows = lambda **more: sorted(tuple(r) for r in mix(spark, docs, total_tokens=10_000, block_tokens=64, **more)[0].collect())
    want = rows(rows_per_task=200_000)
    assert len({r[0] for r in want}) > 700
    assert rows(rows_per_task=100) == rows(rows_per_task=7) == want
    assert sorted(r[:4] + r[5:] for r in rows(period=16)) == sorted(r[:4] + r[5:] for r in want)


def test_blocks_stay_as_small_as_asked_for(spark):
    docs = [(i, "big", 10**9, "") for i in range(30)] + [(1000 + i, "small", 10**9, "") for i in range(5)]
    mixed, shares = mix(spark, docs, block_tokens=10**7)
    assert {r.block_tokens for r in shares.collect()} == {10**7}
    have = {"big": 0, "small": 0}
    for r in mixed.orderBy("slot", "place").collect():
        have[r.source] += r.n_tokens
        assert abs(have["small"] - sum(have.values()) / 3) < 10**7 + 10**9


def test_mixture_of_a_given_size_and_of_nothing(spark):
    docs = [(i, "big", 10, "") for i in range(100)] + [(1000 + i, "small", 10, "") for i in range(5)]
    _, shares = mix(spark, docs, total_tokens=900, block_tokens=50)
    got = {r.source: r.mixed_tokens for r in shares.collect()}
    assert got["big"] == 600 and got["small"] == 200
    mixed, shares = mix(spark, [])
    assert mixed.count() == 0 and shares.count() == 4 and shares.filter("mixed_tokens > 0").count() == 0


def test_a_quotation_ends_behind_any_number_of_unclosed_brackets():
    assert sentences.enclosed("«one (two [three 【four. five» six.") == [(0, 29)]


def test_slots_never_lag_a_block():
    blocks = [2000, 1200, 600, 200, 0]
    have = [0] * 5
    for t, i in enumerate(mixing.pfair_slots(blocks), 1):
        have[i] += 1
        assert all(abs(h - b * t / 4000) < 1 for h, b in zip(have, blocks))
    assert have == blocks


def test_periods_meet():
    import random

    r = random.Random(5)
    for _ in range(300):
        blocks = [r.choice([0, 1, 2, r.randint(1, 400)]) for _ in range(r.randint(1, 8))] + [1]
        n, period = sum(blocks), r.choice([1, 2, 7, 50])
        starts = list(mixing.period_starts(blocks, period))
        assert starts[-1] == blocks
        for t, (a, b) in zip(range(0, n, period), zip(starts, starts[1:])):
            assert all(x <= y for x, y in zip(a, b)) and sum(b) == min(n, t + period)
            assert all(abs(y - w * min(n, t + period) / n) < 1 for y, w in zip(b, blocks))


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id long, text string")
    got = {r.id: r.n_tokens for r in mixing.token_counts(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


CASES = [
    ("Dr. Alder kept 4.5 percent. He left at 9 p.m. sharp.", ["Dr. Alder kept 4.5 percent.", "He left at 9 p.m. sharp."]),
    ('She said: "Go. Now." Then "Where?" he asked.\nBut\nno one spoke', ['She said: "Go. Now."', 'Then "Where?" he asked.', "But\nno one spoke"]),
    ("A heading\n \n1. First one. Second one.\n\n* Bullet!", ["A heading", "1. First one.", "Second one.", "* Bullet!"]),
    ("他问：“好了吗？”为什么不走？她只说“快！走！”就走了。", ["他问：“好了吗？”", "为什么不走？", "她只说“快！走！”就走了。"]),
    ("„Nicht so.“ stand da. Am 3. Mai war z. B. Ruhe.Dann kam er.", ["„Nicht so.“ stand da.", "Am 3. Mai war z. B. Ruhe.", "Dann kam er."]),
    ("ไฟล์มี 3 หน้า ทำไมขาด 5 แถว", ["ไฟล์มี 3 หน้า", "ทำไมขาด 5 แถว"]),
    ("Πού είναι; Δεν ξέρω· ίσως αύριο.", ["Πού είναι;", "Δεν ξέρω· ίσως αύριο."]),
    ("यह अच्छा है। वाह! ठीक है?", ["यह अच्छा है।", "वाह!", "ठीक है?"]),
    ("", []), ("  \n\n ", []), ("...", ["..."]), ("!!! ??? a", ["!!! ??? a"]),
]


@pytest.fixture(scope="module")
def splitter():
    return sentences.default_splitter()


@pytest.mark.parametrize("text, want", CASES[:-1])
def test_sentences(splitter, text, want):
    assert [text[a:b] for a, b in splitter.spans(text)] == want


def test_every_character_is_in_one_sentence(splitter):
    for block, _ in sentences.training_blocks(300, seed=123):
        text = "  " + block + "\n \n\"(“" + block[::-1] + "\r\n\r\n「" + block
        spans = splitter.spans(text)
        covered = [i for a, b in spans for i in range(a, b)]
        assert len(covered) == len(set(covered))
        assert {i for i, ch in enumerate(text) if not ch.isspace()} <= set(covered)
        assert all(text[a:b] == text[a:b].strip() for a, b in spans)


def test_held_out_borders():
    """A splitter that hasn't seen the sentences of the held-out part, whose abbreviations are often its own."""
    model = sentences.default_splitter(part="train")
    right = total = 0
    for block, ends in sentences.training_blocks(1500, seed=77, part="held"):
        got = set(model.ends(block))
        right += sum((e in got) == (e in ends) for e, _ in sentences.candidates(block))
        total += sum(1 for _ in sentences.candidates(block))
    assert right / total > 0.93


def test_scores_by_parts_are_those_of_all_features(splitter):
    for block, _ in sentences.training_blocks(200, seed=5):
        for _, seen in sentences.candidates(block):
            assert splitter.score(seen) == pytest.approx(sum(splitter.weights.get(f, 0.0) for f in sentences.features(seen)))


def test_sentence_rows(spark, splitter):
    df = spark.createDataFrame([(1, "We go. You stay.", 0), (2, None, 0), (3, "", 0), (None, "X.", 0), (1, "We go. You stay.", 0), (4, "y. " * 20_000, 0)], "doc_id long, text string, start_char int")
    got = sentences.sentences(df, "doc_id", "text", splitter)
    assert sorted((r.doc_id, r.start_char, r.end_char) for r in got.filter("doc_id = 1").collect()) == [(1, 0, 6), (1, 0, 6), (1, 7, 16), (1, 7, 16)]
    assert got.filter("doc_id is null").count() == 1 and got.filter("doc_id in (2, 3)").count() == 0
    assert got.filter("start_char >= end_char").count() == 0


@pytest.fixture(scope="module")
def tagger():
    return pii.default_tagger()


def test_held_out_items():
    """A tagger that hasn't seen the sentences, names, places, streets and words of the held-out part."""
    model = pii.default_tagger(part="train")
    plain = sorted(w for w, where in model.words.items() if where & 1 and 3 <= len(w) <= 10)
    labelled = list(pii_seeds.texts(1000, seed=99, part="held", words=plain))
    right = found = there = 0
    for (_, spans), got in zip(labelled, model.find([t for t, _ in labelled])):
        right += len(set(spans) & set(got))
        found += len(got)
        there += len(spans)
    assert right / found > 0.88 and right / there > 0.86


def test_parts_of_the_table_do_not_meet():
    import random

    train, held = (pii_seeds._Filler(random.Random(1), p, pii_seeds.WORDS) for p in ("train", "held"))
    for entries in (*pii_seeds.LINES.values(), pii_seeds.PLAIN, pii_seeds.GIVEN, pii_seeds.PLACES):
        assert not set(train.of(list(dict.fromkeys(entries)))) & set(held.of(list(dict.fromkeys(entries))))


def test_tokens_and_their_types_agree():
    tokens = pii.Tokens()
    for sep in [chr(i) for i in range(1, 0x3001) if chr(i).isspace()] + ["<p>", "<br/>", "\n<b>", " <"]:
        for text in (f"a{sep}B9 c{sep}{sep}d-1@x{sep}", f"{sep}x\n{sep}y"):
            assert [t for _, _, t in tokens.of(text)] == tokens.types_of(text), repr(text)
            assert [t for _, _, t in tokens.of(text)] == pii.Tokens.types_of(tokens, text)


def test_texts_left_out_hold_nothing(tagger, monkeypatch):
    some = [t for t, _ in pii_seeds.texts(400, seed=31)] + [x for t, _ in pii_seeds.texts(100, seed=32) for x in t.split()] + [""]
    quick = tagger.find(some)
    monkeypatch.setattr(pii.Tagger, "_open", lambda self, e, starts, sizes: sizes >= 0)
    assert tagger.find(some) == quick


def test_decoder_finds_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    n = len(pii.LABELS)
    e, moves = r.normal(size=(8, n)).astype("float32"), r.normal(size=(n, n)).astype("float32")
    for path, (start, size) in zip(pii._viterbi(e, np.array([0, 4]), np.array([4, 3]), moves), ((0, 4), (4, 3))):
        first = [i for i, x in enumerate(pii.LABELS) if x[0] != "I"]
        score = lambda p: sum(e[start + i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        best = max((p for p in itertools.product(range(n), repeat=size) if p[0] in first), key=score)
        assert score(path.tolist()) == pytest.approx(score(best), abs=1e-3)


def test_sums_over_paths_agree_with_listing_them():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    em, moves = r.normal(size=(1, 3, 4)), r.normal(size=(4, 4))
    post, both = pii._posteriors(em, np.ones((1, 3), bool), moves)
    weight = {p: np.exp(sum(em[0, i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(4), repeat=3)}
    z = sum(weight.values())
    want = np.zeros((3, 4))
    moved = np.zeros((4, 4))
    for p, w in weight.items():
        for i, x in enumerate(p):
            want[i, x] += w / z
        for a, b in zip(p, p[1:]):
            moved[a, b] += w / z
    assert np.allclose(post[0], want, atol=1e-5) and np.allclose(both, moved, atol=1e-5)


def test_redaction(spark, tagger):
    text = "Please call +44 7700 900514 after six.\nI spoke with Maria Johnson yesterday."
    df = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "+1", "k"), (5, "a " * 30_000, "k")], "id long, content string, items string")
    got = {r.id: r for r in pii.find_pii(df, "content", ["id"], tagger).collect()}
    assert got[1].redacted == "Please call [PHONE] after six.\nI spoke with [NAME] yesterday."
    assert [(i.kind, i.item) for i in got[1]["items"]] == [("phone", "+44 7700 900514"), ("name", "Maria Johnson")]
    assert got[2].redacted is None and got[2]["items"] is None and got[3].redacted == "" and got[4]["items"] == [] and got[5].redacted == "a " * 30_000
