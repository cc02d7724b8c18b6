"""Passages of evaluation items inside a corpus."""

from __future__ import annotations

import functools
import io
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import runs_of, spread
from tagloom.util import write_shared

#: Units of a passage: words, or letters and digits where a script has no spaces.
WORD_WINDOW, CHAR_WINDOW = 12, 25
#: Positions of the embedding that one hash looks at: fewer bring more candidates, more ask for more repetitions.
SAMPLED = 8
#: Windows of items in one block of the index.
BLOCK_WINDOWS = 1_000_000
#: Edited copies that the number of repetitions is measured on, and repetitions after which it is given up, with an error.
MEASURED, MAX_REPETITIONS = 2000, 1000
#: Windows that are embedded at once, and characters of texts that are taken apart at once.
STEP, CHARS = 200_000, 2_000_000

_UNIT = regex.compile(r"[\p{L}\p{N}]+")
_MARKS = regex.compile(r"\p{M}+")
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_LETTER = regex.compile(r"\p{L}")
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _scaled(n: int) -> np.uint64:
    return np.uint64(n * int(_GOLD) % 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


class _Bare(dict):
    """Characters without the marks that their decomposition splits off."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        apart = unicodedata.normalize("NFKD", ch)
        self[code] = ch if len(apart) == 1 else _MARKS.sub("", apart)
        return self[code]


_BARE = _Bare()


def plain(text: str) -> str:
    """Text without case, and without the marks that decomposition splits off."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).translate(_BARE).casefold()


def spaceless(text: str) -> bool:
    """Is most of the text in Chinese or Japanese characters?"""
    return 2 * len(_SPACELESS.findall(text)) > len(_LETTER.findall(text))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of normalized texts, and how many each text has."""
    words: list[str] = []
    sizes = []
    for t in texts:
        found = _UNIT.findall(t)
        sizes.append(len(found))
        words += found
    coded = pa.array(words, pa.string()).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) | 1 for w in coded.dictionary.to_pylist()], dtype="uint64")
    return hashes[coded.indices.to_numpy()] if words else np.zeros(0, "uint64"), np.array(sizes, dtype="int64")


def char_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for letters and digits."""
    parts = ["".join(_UNIT.findall(t)) for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="uint32").astype("uint64")
    return _mix(codes + _GOLD) | np.uint64(1), np.array([len(p) for p in parts], dtype="int64")


def _windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the text each is in."""
    first = np.cumsum(sizes) - sizes
    n = np.maximum(0, sizes - width + 1)
    owner = np.repeat(np.arange(len(sizes)), n)
    return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def embed_keys(units: np.ndarray, starts: np.ndarray, width: int, seed: int, sampled: np.ndarray) -> np.ndarray:
    """One hash for each window: the embedding's symbols at the ``sampled`` places.

    The embedding is a random walk: 3 * width times it puts out the unit under a pointer, which moves on when a random bit
    belonging to the unit and the step says so. Two windows of edit distance e then differ in O(e * e) places.
    """
    at, end = starts.copy(), starts + width
    key = np.full(len(starts), _scaled(seed + 1))
    steps, last = set(sampled.tolist()), len(units) - 1
    bits = None
    for j in range(int(sampled.max()) + 1):
        if j % 64 == 0:
            bits = _mix(units ^ _scaled(seed * 64 + j // 64 + 1))
        inside = at < end
        here = np.minimum(at, last)
        if j in steps:
            key = _mix(key * _GOLD + np.where(inside, units[here], np.uint64(0)))
        at += ((bits[here] >> np.uint64(j % 64)) & np.uint64(1)).astype("int64") * inside
    return key


def edit_distances(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Edit distances of rows of units, limit + 1 where they are greater; a diagonal band for all rows at once."""
    n, w = a.shape
    far = limit + 1
    row = np.full((n, 2 * limit + 3), far, dtype="int16")  # row[:, d + limit + 1] is the cell (i, i + d)
    for d in range(0, limit + 1):
        row[:, d + limit + 1] = d
    for i in range(1, w + 1):
        new = np.full_like(row, far)
        for d in range(-limit, limit + 1):
            j = i + d
            if j < 0 or j > w:
                continue
            c = d + limit + 1
            best = row[:, c + 1] + 1
            best = np.minimum(best, new[:, c - 1] + 1)
            best = np.minimum(best, row[:, c] + (a[:, i - 1] != b[:, j - 1])) if j else np.minimum(best, i)
            new[:, c] = np.minimum(best, far)
        row = new
    return row[:, limit + 1]


@dataclass
class _Index:
    """Windows of one kind of items, and their hashes."""

    width: int
    max_edits: int
    item: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    units: np.ndarray
    vocabulary: np.ndarray
    samples: list[np.ndarray] = field(default_factory=list)
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    needs_spaceless: bool = False
    recall: float = 1.0

    @staticmethod
    def of(ids: list[int], units: np.ndarray, sizes: np.ndarray, width: int, max_edits: int, recall: float) -> _Index:
        starts, owner = _windows(sizes, width)
        first = np.cumsum(sizes) - sizes
        index = _Index(width, max_edits, np.array(ids, dtype="int64")[owner], starts - first[owner], starts, units, np.unique(units))
        if len(starts):
            rng = np.random.default_rng(12)
            pairs, hit = None, np.zeros(0, bool)
            while not index.samples or hit.mean() < recall:
                index.repeat(rng)
                if max_edits:
                    if pairs is None:
                        pairs = index.edited(rng, MEASURED)
                        hit = np.zeros(MEASURED, bool)
                    hit |= index.meet(pairs, len(index.samples) - 1)
                    if hit.mean() >= recall:
                        # What stops is measured on pairs that had no part in it; if they miss it, they go on being asked.
                        pairs = index.edited(rng, MEASURED)
                        hit = np.logical_or.reduce([index.meet(pairs, r) for r in range(len(index.samples))])
                    index.recall = float(hit.mean())
                else:
                    hit = np.ones(1, bool)
        return index

    def repeat(self, rng: np.random.Generator) -> None:
        """One more embedding, hashed on places of its own."""
        r = len(self.samples)
        if r == MAX_REPETITIONS:
            raise ValueError(f"{r} repetitions find {self.recall:.3f} of the copies with {self.max_edits} edits")
        self.samples.append(np.sort(rng.choice(3 * self.width, SAMPLED, replace=False)))
        own = embed_keys(self.units, self.starts, self.width, r, self.samples[r])
        order = np.argsort(own, kind="stable")
        self.keys.append((own[order], order))

    def meet(self, pairs: np.ndarray, r: int) -> np.ndarray:
        """Which pairs of windows have one hash in repetition ``r``."""
        k = embed_keys(pairs.reshape(-1), np.arange(0, pairs.size, self.width), self.width, r, self.samples[r])
        return k[0::2] == k[1::2]

    def arrays(self) -> list[np.ndarray]:
        return [self.item, self.at, self.starts, self.units, self.vocabulary, *[x for pair in self.keys for x in pair]]

    def without_arrays(self) -> _Index:
        none = np.zeros(0, "int64")
        return _Index(self.width, self.max_edits, none, none, none, none, none, self.samples, [], self.needs_spaceless, self.recall)

    def with_arrays(self, parts: list[np.ndarray]) -> _Index:
        item, at, starts, units, vocabulary, *keys = parts
        unsigned = lambda x: x.view("uint64")
        pairs = [(unsigned(k), o) for k, o in zip(keys[0::2], keys[1::2])]
        return _Index(self.width, self.max_edits, item, at, starts, unsigned(units), unsigned(vocabulary), self.samples, pairs, self.needs_spaceless, self.recall)

    def windows(self, which: np.ndarray) -> np.ndarray:
        return self.units[self.starts[which][:, None] + np.arange(self.width)]

    def edited(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """Windows beside copies with ``max_edits`` random edits: what the number of repetitions is measured on."""
        out = np.zeros((n, 2, self.width), "uint64")
        for i in range(n):
            w = self.windows(rng.integers(len(self.starts), size=1))[0]
            out[i, 0] = w
            c = w.tolist()
            left = self.max_edits
            while left:
                p = int(rng.integers(len(c)))
                if left >= 2 and rng.random() < 0.5:
                    # One left out and another put in somewhere: the windows stay as long, what is between is shifted.
                    del c[p]
                    c.insert(int(rng.integers(len(c) + 1)), int(rng.integers(1, 2**63)))
                    left -= 2
                else:
                    c[p] = int(rng.integers(1, 2**63))
                    left -= 1
            out[i, 1] = c
        return out

    def find(self, units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, window of the items, edits) of every window of the texts that is close to one of the items'."""
        found = [], [], [], []
        if len(self.item) and len(units):
            starts, owner = _windows(sizes, self.width)
            # A window within max_edits has at most so many units that no item has.
            known = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, units), len(self.vocabulary) - 1)] == units
            running = np.concatenate([[0], np.cumsum(known)])
            live = running[starts + self.width] - running[starts] >= self.width - self.max_edits
            starts, owner = starts[live], owner[live]
            first = np.cumsum(sizes) - sizes
            for lo in range(0, len(starts), STEP):
                s, o = starts[lo:lo + STEP], owner[lo:lo + STEP]
                pairs = []
                for r, (places, (keys, order)) in enumerate(zip(self.samples, self.keys)):
                    k = embed_keys(units, s, self.width, r, places)
                    a, b = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                    n = b - a
                    w = np.repeat(np.arange(len(s)), n)
                    hits = order[np.repeat(a, n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
                    pairs.append(w * len(self.item) + hits)
                both = np.unique(np.concatenate(pairs))
                for c in range(0, len(both), STEP):
                    w, hits = np.divmod(both[c:c + STEP], len(self.item))
                    edits = edit_distances(units[s[w][:, None] + np.arange(self.width)], self.windows(hits), self.max_edits)
                    ok = edits <= self.max_edits
                    for to, x in zip(found, (o[w[ok]], (s - first[o])[w[ok]], hits[ok], edits[ok])):
                        to.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, "int64") for x in found)


def _build(items: list[tuple[int, str]], max_edits: int, recall: float) -> list[_Index]:
    texts = [(i, plain(t)) for i, t in items]
    worded = [(i, t) for i, t in texts if not spaceless(t)]
    packed = [(i, t) for i, t in texts if spaceless(t)]
    out = []
    for own, hashes, width in ((worded, word_hashes, WORD_WINDOW), (packed, char_hashes, CHAR_WINDOW)):
        units, sizes = hashes([t for _, t in own])
        out.append(_Index.of([i for i, _ in own], units, sizes, width, max_edits, recall))
    for _, t in packed:
        joined = "".join(_UNIT.findall(t))
        plainest = max((len(x) for x in _SPACELESS.split(joined)), default=0)
        out[1].needs_spaceless |= plainest >= CHAR_WINDOW - max_edits
    out[1].needs_spaceless = not out[1].needs_spaceless
    return out


def _pack(indexes: list[_Index]) -> tuple[bytes, list[_Index], list[list[int]]]:
    """The arrays of indexes as the bytes of one file, and what tells how to read them again."""
    arrays = [[np.ascontiguousarray(x) for x in index.arrays()] for index in indexes]
    out = io.BytesIO()
    np.save(out, np.concatenate([x.view("int64") for part in arrays for x in part]))
    return out.getvalue(), [index.without_arrays() for index in indexes], [[len(x) for x in part] for part in arrays]


def _unpack(indexes: list[_Index], sizes: list[list[int]], path: str) -> list[_Index]:
    """The indexes of a file, which stays on disk: its pages are read when they are looked at, and shared by all workers."""
    whole, at, out = np.load(path, mmap_mode="r").view(np.ndarray), 0, []
    for index, lengths in zip(indexes, sizes):
        parts = []
        for n in lengths:
            parts.append(whole[at:at + n])
            at += n
        out.append(index.with_arrays(parts))
    return out


@functools.lru_cache(maxsize=2)
def _opened(names: tuple[str, ...]) -> list[str]:
    return [SparkFiles.get(n) for n in names]


def _search(blocks: list[tuple[str, list[_Index], list[list[int]]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_unpack(indexes, sizes, path) for (_, indexes, sizes), path in zip(blocks, _opened(tuple(n for n, _, _ in blocks)))]
        for batch in batches:
            contents = batch.column(1).to_pylist()
            for lo, hi in runs_of(contents, 500, CHARS):
                texts = [plain(t) for t in contents[lo:hi]]
                ids = np.asarray(batch.column(0).slice(lo, hi - lo))
                for kind, hashes in enumerate((word_hashes, char_hashes)):
                    asked = [indexes[kind] for indexes in opened if len(indexes[kind].item)]
                    if not asked:
                        continue
                    every = not all(x.needs_spaceless for x in asked)
                    used = np.array([i for i, t in enumerate(texts) if every or _SPACELESS.search(t)], dtype="int64")
                    if not len(used):
                        continue
                    units, sizes = hashes([texts[i] for i in used])
                    for index in asked:
                        text, place, window, edits = index.find(units, sizes)
                        if len(text):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids[used[text]]), pa.array(index.item[window]), pa.array(place.astype("int64")), pa.array(index.at[window]), pa.array(edits.astype("int32"))],
                                names=["doc", "item", "doc_unit", "item_unit", "edits"],
                            )

    return run


def leaked_passages(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, max_edits: int = 2, recall: float = 0.95, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Places where a document holds a passage of an item: (doc, item, doc_unit, item_unit, edits).

    A passage is WORD_WINDOW words of an item in a row, or CHAR_WINDOW letters and digits if the item is in Chinese or
    Japanese; case, accents, punctuation and spacing don't matter. A place is a window of the document, as long, within
    ``max_edits`` insertions, deletions and replacements of a passage; units are numbered from 0. Unchanged passages are found
    with certainty, the others each with probability ``recall`` or more: windows are embedded by a random walk that turns
    edits into differing places, hashed on a few sampled places, as often as edited copies of the items' own passages ask
    for, and every candidate's edit distance is computed. With no edits one embedding is enough.

    Documents are read once, whatever the number of items, and never shuffled. The items' index is made on the driver in
    blocks of ``block_windows`` windows, and shipped as files that workers map into memory: an executor needs disk for it,
    about 16 bytes for each window and repetition. Null texts hold nothing; items shorter than a passage have none; several
    rows with one id count as one document. Rows with a null id are left out. Ids are whole numbers.
    """
    sc = docs.sparkSession.sparkContext
    corpus = spread(docs.select(F.col(doc_id).cast("long").alias("_d"), F.col(doc_text).alias("_t")).filter("_d is not null and _t is not null"))
    asked = items.select(F.col(item_id).cast("long").alias("_i"), F.col(item_text).alias("_t")).filter("_i is not null and _t is not null")
    size = asked.agg(F.sum(F.length("_t"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_windows))
    blocks = []
    for k in range(n_blocks):
        block = [(r._i, r._t) for r in asked.filter(F.pmod(F.xxhash64("_i", "_t"), F.lit(n_blocks)) == k).collect()]
        content, indexes, sizes = _pack(_build(block, max_edits, recall))
        name = f"passages-{uuid.uuid4().hex}.npy"
        sc.addFile(write_shared(docs.sparkSession, name, content))
        blocks.append((name, indexes, sizes))
    return corpus.mapInArrow(_search(blocks), "doc long, item long, doc_unit long, item_unit long, edits int")


def leaks(passages: DataFrame) -> DataFrame:
    """One row per document and item: (doc, item, n_places, edits), with the number of places in the document and the least edits."""
    places = passages.groupBy("doc", "item", "doc_unit").agg(F.min("edits").alias("edits"))
    return places.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_places"), F.min("edits").alias("edits"))
