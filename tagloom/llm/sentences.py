"""Sentences of documents in many languages and scripts."""

from __future__ import annotations

import bisect
import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import spread
from tagloom.llm.sentence_seeds import NAMES, NAMES_RU, SEEDS, WORDS

#: Blocks of sentences with known borders that the model is trained on.
TRAINING_BLOCKS = 6000

# Marks that may end a sentence, quotes and brackets.
_MARKS = ".!?…。！？｡．؟।॥;\u037e"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "‹": "›"}
_OPENERS = {c: [o for o in [*_PAIRS, '"'] if c in _PAIRS.get(o, '"')] for c in {'"', *"".join(_PAIRS.values())}}
_CLOSERS = "\"”“»)]）」』】》〉›"
_SPACES = "    "
_END = regex.compile(rf"[{regex.escape(_MARKS)}]+")
_THAI = regex.compile(r"(?<=[ก-ฺเ-๎])[ \t  -   　]+(?=[ก-ฺเ-๎])")
_THAI_LETTER = regex.compile("[ก-๎]")
_BLANK = regex.compile(r"(?:\r\n|[\n\v\f\r\x85  ])[^\S\n\v\f\r\x85  ]*(?:\r\n|[\n\v\f\r\x85  ])\s*")
_QUOTES = regex.compile("[\"“”„«»()\\[\\]（）「」『』【】《》〈〉‹›]")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+(?:[.'’-][\p{L}\p{M}\p{N}]+)*")
_GREEK, _CASELESS = regex.compile(r"\p{Greek}"), regex.compile(r"[\p{Lo}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SCRIPTS = [(s, regex.compile(rf"\p{{{s}}}")) for s in ("Latin", "Cyrillic", "Greek", "Arabic", "Devanagari", "Thai")]


@functools.lru_cache(maxsize=50_000)
def _script(ch: str) -> str:
    for name, r in _SCRIPTS:
        if r.match(ch):
            return name
    return "CJK" if _CJK.match(ch) else "other"


def enclosed(block: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a block that are closed in it, as (start, end) in order."""
    stack: list[tuple[str, int]] = []
    opened: dict[str, list[int]] = {}  # where in the stack each kind of opener lies
    spans = []
    for m in _QUOTES.finditer(block):
        ch, at = m[0], m.start()
        k = max((opened[o][-1] for o in _OPENERS.get(ch, ()) if opened.get(o)), default=-1)
        if k >= 0:
            spans.append((stack[k][1], at + 1))
            while len(stack) > k:
                opened[stack.pop()[0]].pop()
        elif ch in _PAIRS or ch == '"' and block[at + 1:at + 2].strip():
            opened.setdefault(ch, []).append(len(stack))
            stack.append((ch, at))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


@functools.lru_cache(maxsize=100_000)
def _shape(word: str) -> str:
    if not word:
        return "none"
    if word.isdigit():
        return "digits"
    if word[0].isdigit():
        return "number"
    core = word.replace(".", "").replace("-", "")
    if "." in word:
        return "dotted"
    if len(core) == 1:
        return "Initial" if core.isupper() else "initial" if core.islower() else "sign"
    if _CASELESS.match(word):
        return "caseless"
    if word[0].isupper():
        return "UPPER" if word.isupper() else "Title"
    return "mixed" if any(c.isupper() for c in word) else "lower"


def _place_features(t: str, k: str, p: str, q: str, g: str, size: int, place: str, a: str, b: str) -> list[str]:
    """Of the mark, the kinds of the words beside it, quotations, the gap, the length of the word before, where it stands, scripts."""
    return [
        "bias", f"t={t}", f"t={t} k={k}", f"t={t} p={p}", f"t={t} q={q}", f"q={q}", f"q={q} k={k}", f"g={g} k={k} t={t}", f"k={k}", f"p={p}", f"p={p} k={k}",
        f"s={size} p={p}", f"s={size} k={k}", f"q={q} t={t} k={k}", f"place={place} p={p} k={k}", f"a={a} b={b} t={t}",
    ]


def _word_features(word: str, k: str) -> list[str]:
    return [f"w={word}", f"w={word} k={k}"] if word else []


def _next_features(word: str) -> list[str]:
    return [f"next={word}"]


def _number_features(p: str, before: str, word: str, k: str, word2: str, follows: str) -> list[str]:
    """Of the word before a number, an initial or a dotted word."""
    s2 = f"s2={before}"
    return [f"{s2} p={p}", f"{s2} p={p} k={k}", f"{s2} w={word} k={k}", f"w2={word2} p={p}", f"w2={word2} p={p} k={k}", f"p={p} next={follows}"]


_FEATURES = (_place_features, _word_features, _next_features, _number_features)


def features(seen: tuple[tuple | None, ...]) -> list[str]:
    """The features of a candidate, by what ``candidates`` has seen of it."""
    return [f for make, part in zip(_FEATURES, seen) if part is not None for f in make(*part)]


def candidates(block: str) -> Iterator[tuple[int, tuple[tuple | None, ...]]]:
    """Places where a sentence may end in a block, as (end, what each of _FEATURES needs to know)."""
    spans = enclosed(block)
    starts = [s for s, _ in spans]
    n = len(block)
    for m in _END.finditer(block):
        i, end = m.span()
        mark = m[0]
        if end >= n:
            continue
        after, before = block[end], block[i - 1:i]
        if mark == "." and (after.isascii() and after.isalnum() and not after.isupper()):
            # Inside names, numbers and addresses; left are capitals inside a word, and digits after a word.
            if not (after.isdigit() and before.isalpha() or block[end + 1:end + 2].isupper() and before.isalpha()):
                continue
        if mark[0] in ";\u037e" and not (_GREEK.match(block[:i].rstrip()[-1:] or " ") or before.isdigit() and _GREEK.search(block[max(0, i - 40):i])):
            continue
        k = bisect.bisect_left(starts, i) - 1
        around = spans[k] if k >= 0 and spans[k][1] > i else None
        stop = end
        while stop < n:
            spaced = around and around[1] == stop + 2 and block[stop] in _SPACES
            if not spaced and (block[stop] not in _CLOSERS or block[stop] in '"“' and not (around and around[1] == stop + 1)):
                break
            stop += 1
        if around and stop > around[1]:
            around = (around[0], stop)
        if stop >= n or not block[stop:].strip():
            continue
        left = block[max(0, i - 30):i]
        words = _TOKEN.findall(left)
        touching = bool(words) and left.endswith(words[-1])
        prev = words[-1] if touching else ""
        if prev and _CJK.match(prev[-1]):
            prev = prev[-1]
        prev2 = (words[-2] if touching else words[-1]) if len(words) > touching else ""
        rest = block[stop:stop + 40]
        bare = rest.lstrip()
        gap = "none" if len(bare) == len(rest) else "space"
        follows = _TOKEN.match(bare)
        nxt = follows[0] if follows else ""
        if nxt and _CJK.match(nxt[0]):
            nxt = nxt[0]
        kind = _shape(nxt) if nxt else "open" if bare[0] in _PAIRS or bare[0] in "\"¿¡" else "punct" if bare[0] in ",;:)]»”’،؛" else "other"
        if nxt and kind in ("Initial", "initial", "sign"):
            kind = "Title" if nxt[0].isupper() else "lower" if nxt[0].islower() else "caseless"
        p, t = _shape(prev), "……" if mark == "……" else "…" if mark in ("...", "..", "…") else mark[-1]
        quote = "none"
        if around and around[1] > stop:
            quote = "inside"
        elif around:
            lead = block[:around[0]].rstrip()
            quote = "start" if not lead or lead[-1] in _MARKS or lead[-1] in _CLOSERS or lead[-1] in "-*•" else "colon" if lead[-1] in ":：" else "middle"
            if block[around[0]] in "([（【":
                quote += " bracket"
        size = min(len(prev), 6)
        place = "first" if touching and not block[:i - len(prev)].strip() else "later"
        short = prev.lower() if len(prev) <= 6 else ""
        following = nxt.lower()[:12]
        number = p in ("digits", "number", "initial", "Initial", "dotted")
        yield stop, (
            (t, kind, p, quote, gap, size, place, _script(prev[-1:] or " "), _script(bare[0])), (short, kind), (following,),
            (p, _shape(prev2), short if short else "none", kind, prev2.lower()[:12], following) if number else None,
        )


def _filled(template: str, r: random.Random) -> str:
    out = template
    for key, make in (
        ("{n}", lambda: str(r.choice([r.randint(1, 9), r.randint(10, 99), r.randint(100, 999)]))), ("{d}", lambda: f"{r.randint(0, 99)}.{r.randint(0, 99)}"), ("{v}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}"),
        ("{w}", lambda: r.choice(WORDS)), ("{N}", lambda: r.choice(NAMES)), ("{L}", lambda: r.choice("ABCDEGHKLMNPRST")), ("{Lr}", lambda: r.choice("АБВГКЛМНПС")), ("{Nr}", lambda: r.choice(NAMES_RU)),
    ):
        while key in out:
            out = out.replace(key, make(), 1)
    return out


def training_blocks(n: int, seed: int = 8, part: str = "all") -> Iterator[tuple[str, set[int]]]:
    """Blocks of sentences side by side, with the places where one ends and another follows; ``part`` is `all`, `train` or `held`."""
    r = random.Random(seed)
    langs = sorted(SEEDS)
    seeds = {lang: [x for i, x in enumerate(own) if part == "all" or (i % 5 == 0) == (part == "held")] for lang, own in SEEDS.items()}
    for _ in range(n):
        lang = r.choice([*langs, "en", "en", "en", "de", "zh"])
        block, ends = "", set()
        if r.random() < 0.15:
            block = r.choice(["1. ", "2) ", "3. ", "- ", "* ", f"{r.randint(4, 19)}. "])
        glued, loud = r.random() < 0.12, r.random() < 0.04
        for k in range(r.randint(2, 4)):
            own = lang if r.random() < 0.85 else r.choice(langs)
            s = _filled(r.choice(seeds[own]), r)
            if loud:
                s = s.upper()
            if r.random() < 0.15:
                s = s.replace(" ", "\n", 1) if " " in s else s
            if k:
                ends.add(len(block))
                cjk = block[-1] in "。！？」”…）" and own in ("zh", "ja")
                block += "" if cjk and r.random() < 0.9 or glued and block[-1] not in "\"»" and lang != "th" else r.choice([" ", " ", " ", "  ", "\n", "\u00a0"])
            block += s
        yield block, ends


class Splitter:
    """A maximum-entropy classifier of candidate borders."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        # Scores of what was seen, part by part: most candidates are told by four look-ups.
        self.known: tuple[dict[tuple, float], ...] = ({}, {}, {}, {})

    def __reduce__(self):
        return Splitter, (self.weights,)

    def score(self, seen: tuple[tuple | None, ...]) -> float:
        total = 0.0
        for known, make, part in zip(self.known, _FEATURES, seen):
            if part is None:
                continue
            got = known.get(part)
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                got = known[part] = sum(self.weights.get(f, 0.0) for f in make(*part))
            total += got
        return total

    @staticmethod
    def train(blocks: Iterator[tuple[str, set[int]]], rounds: int = 400, ridge: float = 0.3) -> Splitter:
        rows, labels = [], []
        for block, ends in blocks:
            for end, seen in candidates(block):
                rows.append(features(seen))
                labels.append(end in ends)
        counts: dict[str, int] = {}
        for f in rows:
            for x in f:
                counts[x] = counts.get(x, 0) + 1
        names = [x for x, c in counts.items() if c >= 3]
        index = {x: i for i, x in enumerate(names)}
        flat = [(i, index[x]) for i, f in enumerate(rows) for x in f if x in index]
        at, col = np.array([a for a, _ in flat]), np.array([c for _, c in flat])
        y, w, square = np.array(labels, dtype="float64"), np.zeros(len(names)), np.full(len(names), 1e-8)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.bincount(at, w[col], minlength=len(y))))
            slope = np.bincount(col, (p - y)[at], minlength=len(w)) + ridge * w
            square += slope * slope
            w -= 0.5 * slope / np.sqrt(square)
        return Splitter(dict(zip(names, w.tolist())))

    def ends(self, block: str) -> list[int]:
        """Ends of a block's sentences but the last."""
        out = [end for end, seen in candidates(block) if self.score(seen) > 0]
        if _THAI_LETTER.search(block):
            out = sorted({*out, *(m.start() for m in _THAI.finditer(block))})
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """All sentences of a text as (start, end)."""
        out = []
        at = 0
        borders = [(m.start(), m.end()) for m in _BLANK.finditer(text)] + [(len(text), len(text))]
        for stop, following in borders:
            block = text[at:stop]
            last = 0
            for end in [*self.ends(block), len(block)]:
                piece = block[last:end]
                bare = piece.strip()
                if bare:
                    start = at + last + len(piece) - len(piece.lstrip())
                    out.append((start, start + len(bare)))
                last = end
            at = following
        return out


@functools.lru_cache(maxsize=2)
def default_splitter(blocks: int = TRAINING_BLOCKS, part: str = "all") -> Splitter:
    return Splitter.train(training_blocks(blocks, part=part))


def sentences(docs: DataFrame, doc_id: str, text: str, splitter: Splitter | None = None) -> DataFrame:
    """One row per sentence: (``doc_id``, start_char, end_char, sentence), positions in code points, the end exclusive.

    Candidates are marks that may end a sentence, with the quotes and brackets that close after them; a maximum-entropy model
    over the mark, the words on both sides, their case, length, digits and script, and the state of quotations tells which
    do. Blank lines always end a sentence, spaces between Thai letters do. Every character that isn't white space is in
    exactly one sentence. Null, empty and blank texts have none. Rows are independent: repeated ids give repeated rows.
    """
    model = splitter or default_splitter()
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, start, end, out = [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for s, e in model.spans(t or ""):
                        row.append(i)
                        start.append(s)
                        end.append(e)
                        out.append(t[s:e])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(out, pa.string())], names=["d", "start_char", "end_char", "sentence"])

    rows = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("t is not null"))
    return rows.mapInArrow(run, f"d {kind.simpleString()}, start_char long, end_char long, sentence string").withColumnRenamed("d", doc_id)
