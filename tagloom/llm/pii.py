"""Personal information inside free text."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import runs_of, spread
from tagloom.llm.pii_seeds import GIVEN, KINDS, texts

#: Labelled texts that the model is trained on.
TRAINING_TEXTS = 10000
#: Vocabularies of public tokenizers: the words in them are common ones.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: What an item is replaced with.
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: Share of the features of single words that training keeps back at a time.
KEPT_BACK = 0.5
#: A token sees so many tokens on either side.
REACH = 3
#: Texts are labelled together while they have at most so many places for tokens, or characters.
CELLS, CHARS = 1_000_000, 1_500_000
#: Items with fewer digits are none: a number needs so many, an address a house number. An email needs an at sign, a name
#: more than single letters.
MIN_DIGITS = {"phone": 6, "id_number": 6, "address": 1}

LABELS = ["O", *[f"{b}-{k}" for k in KINDS for b in "BI"]]
_SEPARATOR = regex.compile(r"</?(?:p|br|div|li|ul|ol|b|i|em|strong|span)\b[^<>]*>|[\s\x1c-\x1f]+", regex.I)
_LINE = regex.compile(r"\s*(?:\n|</?(?:p|br|div|li)\b[^<>]*>)\s*", regex.I)
_AT = regex.compile(r"[@＠]|&(?:#0*64|#x0*40|commat);|\bat\b", regex.I)
_PIECE = regex.compile(r"&#?\w+;|\p{Han}+|\p{Hiragana}+|\p{Katakana}+|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])\p{L})[\p{Latin}\p{Cyrillic}\p{Greek}\p{Arabic}\p{Devanagari}\p{Thai}\p{M}]*|\p{N}+|\S")
_WORD = regex.compile(r"\p{L}{2}|\p{Han}")
_NUMERAL = regex.compile(r"\p{Nd}")
_HAN, _KANA = regex.compile(r"\p{Han}"), regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_NINES, _LOWER, _UPPER, _OTHER = (regex.compile(x) for x in (r"9+", r"\p{Ll}+", r"\p{Lu}+", r"\p{Lo}+"))
_GIVEN = {g.lower() for g in GIVEN}


def _form(tok: str) -> str:
    if tok[0] == "9":
        return f"d{min(len(tok), 12)}"
    if tok[0] == "&" and len(tok) > 1:
        return "entity"
    if not tok[0].isalpha():
        return tok
    if _HAN.match(tok):
        return f"han{min(len(tok), 4)}"
    if _KANA.match(tok):
        return f"kana{min(len(tok), 4)}"
    if len(tok) == 1:
        return "Init" if tok.isupper() else "init"
    return "UPPER" if tok.isupper() else "Title" if tok[0].isupper() else "lower" if tok.islower() else "mixed"


@functools.lru_cache(maxsize=100_000)
def _outline(chunk: str) -> str:
    """The shape of a run without spaces: letters as a or A, digits by their number."""
    s = chunk.strip(".,!?;:()<>\"'。、！")
    s = _NINES.sub(lambda m: f"{min(len(m[0]), 12)}", s)
    s = _LOWER.sub("a", s)
    s = _UPPER.sub(lambda m: "A" if len(m[0]) == 1 else "AA", s)
    return _OTHER.sub("o", s)[:18]


def lexicon(vocabularies: Sequence[str] = VOCABULARIES) -> dict[str, int]:
    """Words of vocabularies in lower case: 1 for those that are in them so, 2 for those with a capital, 3 for both."""
    out: dict[str, int] = {}
    for path in vocabularies:
        with open(path, "rb") as lines:
            for line in lines:
                word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
                if word[:1] == " " and len(word) > 3 and word[1:].isalpha():
                    out[word[1:].lower()] = out.get(word[1:].lower(), 0) | (1 if word[1:].islower() else 2)
    return out


def _features(tok: str, outline: str, first: bool, line: bool, words: dict[str, int]) -> list[str]:
    low, form = tok.lower(), _form(tok)
    f = [f"s={form}", f"c={outline}", f"c={outline} s={form}", f"first={first}", f"s={form} first={first}"]
    if line:
        f.append("line")
    if len(low) <= 14 and form[0] != "d":
        f.append(f"w={low}")
    if tok[0].isalpha() and len(low) > 1:
        common = words.get(low, 0)
        f += [f"common={common}", f"common={common} s={form}"]
        if len(low) > 3:
            f += [f"x={low[-3:]}", f"y={low[-2:]}", f"long={min(len(low), 8)}"]
        if low in _GIVEN:
            f += ["given", f"given s={form}"]
    return f


class Tokens:
    """Texts as tokens; tokens that look alike to the model share a type."""

    def __init__(self):
        self.types: dict[tuple, int] = {("",): 0}
        # Runs without spaces that were met, inside a line and at its start: their tokens' places, and the types alone.
        self.places: tuple[dict[str, list], dict[str, list]] = ({}, {})
        self.kinds: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        self.met: dict[tuple[str, bool], list[tuple[int, int, int]]] = {}

    def _chunk(self, chunk: str, line: bool) -> list[tuple[int, int, int]]:
        plain = _NUMERAL.sub("9", chunk)
        known = self.met.get((plain, line))
        if known is None:
            outline = _outline(plain)
            known = []
            for m in _PIECE.finditer(plain):
                key = (m[0], outline, m.start() == 0, line and m.start() == 0)
                known.append((m.start(), m.end(), self.types.setdefault(key, len(self.types))))
            self.met[plain, line] = known
        if len(self.met) + len(self.kinds[0]) + len(self.kinds[1]) > 400_000:
            for held in (self.met, *self.places, *self.kinds):
                held.clear()
        self.places[line][chunk] = known
        self.kinds[line][chunk] = [t for _, _, t in known]
        return known

    @staticmethod
    def _chunks(text: str) -> Iterator[tuple[int, str, bool]]:
        """Runs without spaces and markup: (start, run, is it the first of a line)."""
        at, line = 0, True
        for m in _SEPARATOR.finditer(text):
            if m.start() > at:
                yield at, text[at:m.start()], line
                line = False
            line |= m[0][0] == "<" or "\n" in m[0]
            at = m.end()
        if at < len(text):
            yield at, text[at:], line

    def of(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, type) of each token."""
        out = []
        for at, chunk, line in self._chunks(text):
            out += [(at + a, at + b, t) for a, b, t in self.places[line].get(chunk) or self._chunk(chunk, line)]
        return out

    def types_of(self, text: str) -> list[int]:
        """The types alone."""
        out: list[int] = []
        if "<" in text:
            for _, chunk, line in self._chunks(text):
                out += self.kinds[line].get(chunk) or (self._chunk(chunk, line) and self.kinds[line][chunk])
            return out
        inside, first = self.kinds
        for row in text.split("\n"):
            known = first
            for chunk in row.split():
                got = known.get(chunk)
                if got is None:
                    line = known is first
                    self._chunk(chunk, line)
                    got = known[chunk]
                out += got
                known = inside
        return out


def _flat(seqs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences in a row with REACH empty tokens around each, and the first place of each."""
    out, starts = [0] * REACH, []
    for s in seqs:
        starts.append(len(out))
        out += s
        out += [0] * REACH
    return np.array(out, dtype="int64"), np.array(starts, dtype="int64")


_TAGGERS: dict[str, Tagger] = {}


def _once(mark: str, *parts) -> Tagger:
    """The same tagger for all tasks of a worker, so that it scores a type of token once."""
    if mark not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[mark] = Tagger(*parts)
    return _TAGGERS[mark]


class Tagger:
    """A linear-chain conditional random field. A token's score is a sum over the features of the tokens around it."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, words: dict[str, int]):
        self.index, self.weights, self.moves, self.words = index, weights, moves, words
        self.tokens, self.scored = Tokens(), np.zeros((0, 2 * REACH + 1, len(LABELS)), "float32")

    def __reduce__(self):
        mark = hashlib.md5(self.weights.tobytes() + self.moves.tobytes()).hexdigest()
        return _once, (mark, self.index, self.weights, self.moves, self.words)

    @staticmethod
    def train(labelled: list[tuple[str, list[tuple[int, int, str]]]], words: dict[str, int], passes: int = 14, batches: int = 12, rate: float = 0.35, ridge: float = 2e-4, seed: int = 3) -> Tagger:
        tokens, rows = Tokens(), []
        for text, spans in labelled:
            toks = tokens.of(text)
            ys = [0] * len(toks)
            for a, b, kind in spans:
                inside = [i for i, (s, e, _) in enumerate(toks) if s >= a and e <= b]
                for k, i in enumerate(inside):
                    ys[i] = LABELS.index(f"{'I' if k else 'B'}-{kind}")
            if toks:
                rows.append(([t for _, _, t in toks], ys))
        keys = sorted(tokens.types, key=tokens.types.get)
        named = [["edge"] if k == ("",) else _features(*k, words) for k in keys]
        counts: dict[str, int] = {}
        seen = np.bincount([t for ts, _ in rows for t in ts], minlength=len(keys))
        for fs, c in zip(named, seen.tolist()):
            for f in fs:
                counts[f] = counts.get(f, 0) + c
        names = ["edge", *[f for f, c in counts.items() if c >= 6 and f != "edge"]]
        index = {f: i for i, f in enumerate(names)}
        pairs = np.array([(t, index[f]) for t, fs in enumerate(named) for f in fs if f in index], dtype="int64")
        wide, n_l = 2 * REACH + 1, len(LABELS)
        w, moves = np.zeros((len(names), wide * n_l), "float32"), np.zeros((n_l, n_l), "float32")
        square, square_m = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
        # What a word is, or how it begins and ends, is kept back now and then, so that shapes and common words carry weight too.
        own = np.array([f[:2] in ("w=", "x=", "y=", "c=") for f in names])
        rng = np.random.default_rng(seed)
        order = np.argsort([len(t) for t, _ in rows], kind="stable")
        parts = [p for p in np.array_split(order, batches) if len(p)]
        ready = []
        for part in parts:
            # A batch only scores the types it has.
            flat, starts = _flat([rows[i][0] for i in part])
            types, flat = np.unique(flat, return_inverse=True)
            rank = np.full(len(keys), -1)
            rank[types] = np.arange(len(types))
            here = pairs[rank[pairs[:, 0]] >= 0]
            by_type = np.argsort(rank[here[:, 0]], kind="stable")
            by_feature = np.argsort(here[:, 1], kind="stable")
            features, feature_cuts = np.unique(here[by_feature, 1], return_index=True)
            ready.append((part, flat, starts, len(types), here[by_type, 1], np.searchsorted(rank[here[by_type, 0]], np.arange(len(types))), rank[here[by_feature, 0]], features, feature_cuts))
        for _ in range(passes):
            for k in rng.permutation(len(ready)):
                part, flat, starts, n_types, type_features, type_cuts, feature_types, features, feature_cuts = ready[k]
                shown = np.where(own & (rng.random(len(names)) < KEPT_BACK), np.float32(0), np.float32(1))[:, None]
                scored = np.add.reduceat(w[type_features] * shown[type_features], type_cuts, axis=0).reshape(n_types, wide, n_l)
                sizes = np.array([len(rows[i][0]) for i in part])
                e = sum(scored[flat[REACH + o:len(flat) - REACH + o], REACH + o] for o in range(-REACH, REACH + 1))
                at = (starts - REACH)[:, None] + np.arange(sizes.max())
                live = np.arange(sizes.max()) < sizes[:, None]
                em = e[np.minimum(at, len(e) - 1)]
                post, both = _posteriors(em, live, moves)
                y = np.zeros(live.shape, "int64")
                for r, i in enumerate(part):
                    y[r, :sizes[r]] = rows[i][1]
                slope = post
                slope[np.arange(len(part))[:, None], np.arange(y.shape[1]), y] -= live
                g = np.zeros((len(flat), n_l), "float32")
                g[(at + REACH)[live]] = slope[live]
                inner = g[REACH:len(flat) - REACH]
                per_type = np.zeros((n_types, wide, n_l), "float32")
                for o in range(-REACH, REACH + 1):
                    target = flat[REACH + o:len(flat) - REACH + o]
                    for label in range(n_l):
                        per_type[:, REACH + o, label] = np.bincount(target, inner[:, label], minlength=n_types)
                slope_w = np.add.reduceat(per_type.reshape(n_types, -1)[feature_types], feature_cuts, axis=0) / len(part) * shown[features] + ridge * w[features]
                pair_live = live[:, 1:]
                np.subtract.at(both, (y[:, :-1][pair_live], y[:, 1:][pair_live]), 1)
                slope_m = both / len(part) + ridge * moves
                square[features] += slope_w * slope_w
                square_m += slope_m * slope_m
                w[features] -= rate * slope_w / np.sqrt(square[features])
                moves -= rate * slope_m / np.sqrt(square_m)
        for a, la in enumerate(LABELS):
            for b, lb in enumerate(LABELS):
                if lb[0] == "I" and la[2:] != lb[2:]:
                    moves[a, b] = -1e4
        return Tagger(index, w.reshape(len(names), wide, n_l), moves, words)

    def _score(self) -> None:
        """Scores for types met since the last time."""
        fresh = list(self.tokens.types)[len(self.scored):]
        if fresh:
            new = np.zeros((len(fresh), *self.scored.shape[1:]), "float32")
            for i, key in enumerate(fresh):
                used = [self.index[f] for f in (["edge"] if key == ("",) else _features(*key, self.words)) if f in self.index]
                if used:
                    new[i] = self.weights[used].sum(axis=0)
            self.scored = np.concatenate([self.scored, new])

    def find(self, batch: list[str]) -> list[list[tuple[int, int, str]]]:
        """Items of each text as (start, end, kind)."""
        if len(self.scored) > 400_000:
            self.tokens, self.scored = Tokens(), self.scored[:0]
        # Many texts occur more than once; each is looked at once.
        index: dict[str, int] = {}
        back = [index.setdefault(t, len(index)) for t in batch]
        found = self._find(list(index))
        return [found[i] for i in back]

    def _find(self, batch: list[str]) -> list[list[tuple[int, int, str]]]:
        toks = [self.tokens.types_of(t) for t in batch]
        self._score()
        flat, starts = _flat(toks)
        e = sum(self.scored[flat[REACH + o:len(flat) - REACH + o], REACH + o] for o in range(-REACH, REACH + 1)) if len(flat) > 2 * REACH else np.zeros((0, len(LABELS)), "float32")
        sizes = np.array([len(s) for s in toks])
        out: list[list[tuple[int, int, str]]] = [[] for _ in batch]
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes > 0)[order] & self._open(e, starts - REACH, sizes)[order]]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 1024 and (hi - lo + 1) * sizes[order[hi]] <= CELLS:
                hi += 1
            part, lo = order[lo:hi], hi
            for i, path in zip(part.tolist(), _viterbi(e, starts[part] - REACH, sizes[part], self.moves)):
                if path.any():
                    out[i] = self._items(batch[i], self.tokens.of(batch[i]), path.tolist())
        return out

    def _open(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts can hold an item at all? In the others no path is better than the one without any.

        Items that begin, go on and end gain by their moves ``enter``, ``stay`` and ``leave`` at most. If each token loses more
        than it gains by going on, the best item is a single token, and if that loses too, there is none.
        """
        if not len(e):
            return np.zeros(len(sizes), bool)
        moves = self.moves - self.moves[0, 0]
        enter, stay, leave = moves[0, 1:].max(), max(0.0, moves[1:, 1:].max()), moves[1:, 0].max()
        gain = e[:, 1:].max(axis=1) - e[:, 0]
        hot = np.concatenate([[0], np.cumsum((gain + max(stay, enter + leave, 0.0) >= -1e-3))])
        return hot[np.minimum(starts + sizes, len(e))] > hot[np.minimum(starts, len(e))]

    @staticmethod
    def _items(text: str, toks: list[tuple[int, int, int]], path: list[int]) -> list[tuple[int, int, str]]:
        items: list[list] = []
        for (s, e, _), y in zip(toks, path):
            if y:
                if LABELS[y][0] == "B" or not items or items[-1][2] != LABELS[y][2:]:
                    items.append([s, e, LABELS[y][2:]])
                items[-1][1] = e
        whole = []
        for s, e, k in items:
            # Only addresses go on in the next line.
            cuts = [(m.start(), m.end()) for m in _LINE.finditer(text, s, e)] if k != "address" else []
            for stop, following in [*cuts, (e, e)]:
                if stop > s:
                    whole.append((s, stop, k))
                s = following
        needs = {"email": _AT, "name": _WORD}
        return [(s, e, k) for s, e, k in whole if sum(c.isdigit() for c in text[s:e]) >= MIN_DIGITS.get(k, 0) and (k not in needs or needs[k].search(text, s, e))]


def _posteriors(em: np.ndarray, live: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each token, and expected moves between labels, by scaled forward and backward sums."""
    n, t_max, n_l = em.shape
    p = np.exp(em - em.max(axis=2, keepdims=True)) * live[:, :, None] + (~live)[:, :, None]
    m = np.exp(moves)
    fwd, bwd, scale = np.zeros_like(p), np.ones_like(p), np.ones((n, t_max), p.dtype)
    fwd[:, 0] = p[:, 0]
    for t in range(t_max):
        if t:
            fwd[:, t] = np.where(live[:, t, None], (fwd[:, t - 1] @ m) * p[:, t], fwd[:, t - 1])
        scale[:, t] = fwd[:, t].sum(axis=1)
        fwd[:, t] /= scale[:, t, None]
    both = np.zeros((n_l, n_l), "float64")
    for t in range(t_max - 2, -1, -1):
        nxt = bwd[:, t + 1] * p[:, t + 1] / scale[:, t + 1, None]
        step = live[:, t + 1, None]
        both += (fwd[:, t] * step).T @ (nxt * step) * m
        bwd[:, t] = np.where(step, nxt @ m.T, bwd[:, t + 1])
    post = fwd * bwd
    return post / post.sum(axis=2, keepdims=True) * live[:, :, None], both.astype("float32")


def _viterbi(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> Iterator[np.ndarray]:
    """The best labels of each sequence, for sequences of about one length at once."""
    t_max, n = int(sizes.max()), len(sizes)
    best = e[starts].copy()
    best[:, [i for i, x in enumerate(LABELS) if x[0] == "I"]] = -1e4
    back = np.zeros((t_max, n, len(LABELS)), "int8")
    stay = np.arange(len(LABELS), dtype="int8")
    for t in range(1, t_max):
        live = t < sizes
        reach = best[:, :, None] + moves
        back[t] = np.where(live[:, None], reach.argmax(axis=1), stay)
        best = np.where(live[:, None], reach.max(axis=1) + e[np.minimum(starts + t, len(e) - 1)], best)
    paths = np.zeros((n, t_max), "int64")
    paths[:, -1] = best.argmax(axis=1)
    for t in range(t_max - 1, 0, -1):
        paths[:, t - 1] = back[t][np.arange(n), paths[:, t]]
    for i in range(n):
        yield paths[i, :sizes[i]]


@functools.lru_cache(maxsize=2)
def default_tagger(n: int = TRAINING_TEXTS, part: str = "all", vocabularies: tuple[str, ...] = VOCABULARIES) -> Tagger:
    """A tagger trained on one part of the labelled table, with the common words of ``vocabularies`` in its blanks."""
    words = lexicon(vocabularies)
    plain = sorted(w for w, where in words.items() if where & 1 and 3 <= len(w) <= 10)
    return Tagger.train(list(texts(n, part=part, words=plain)), words)


def redacted(text: str, items: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in items:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join(out) + text[at:]


def find_pii(df: DataFrame, text: str, keep: list[str], tagger: Tagger | None = None) -> DataFrame:
    """``keep`` columns, ``items`` array of (kind, start_char, end_char, item), and ``redacted``, one row per row.

    The kinds are those of KINDS. A conditional random field over word shapes labels all tokens of a text at once; the best
    labels are found by Viterbi's algorithm over batches of texts. Positions are code points, the end exclusive. In
    ``redacted`` each item is replaced by its PLACEHOLDERS entry and everything else is kept. A null text has null items and
    stays null; an empty one has none. Rows are independent, so repeated rows give repeated results.
    """
    model = tagger or default_tagger()
    fields = [df.schema[k] for k in keep]
    struct = pa.struct([("kind", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b.column(b.num_columns - 1).to_pylist()
            for lo, hi in runs_of(contents, 4000, CHARS):
                part = contents[lo:hi]
                found = model.find([t or "" for t in part])
                ends = np.cumsum([len(f) for f in found])
                flat = [(k, s, e, t[s:e]) for t, f in zip(part, found) for s, e, k in f]
                items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat) if flat else [()] * 4, struct)], fields=list(struct))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                none = pa.array([t is None for t in part])
                clean = [redacted(t, f) if f else t for t, f in zip(part, found)]
                cols = [*[c.slice(lo, hi - lo) for c in b.columns[:-1]], pa.ListArray.from_arrays(offsets, items, mask=none), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*[f"c{i}" for i in range(len(keep))], "items", "redacted"])

    inner = spread(df.select(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keep)], F.col(text).alias("t")))
    schema = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)], "items array<struct<kind string, start_char long, end_char long, item string>>, redacted string"])
    return inner.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "items", "redacted")
