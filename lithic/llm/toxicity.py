"""Toxicity scores: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings is the gap-weighted subsequence kernel: each subsequence of ORDER
symbols that spans at most SPAN counts with DECAY to the power of the symbols it skips, so
a word with inserted or left-out characters stays near the word it disguises. It is divided
by a function of each string's length. Strings are the words of sentences and phrases, two
words with a border between them; runs of single characters are read as one word too.

A labelled document is a bag of the strings of its sentences: a toxic one holds at least one
insult, a clean one none. The machine is trained on strings, and the string of each toxic
document that stands for it is chosen anew by the machine after each round. With landmarks
l_j and weights a_j a string's margin is the sum of a_j k(w, l_j). As every term is a sum
over subsequences, the landmarks fold into one table of subsequence weights that scoring
reads. Whole sentences as strings were tried, too: one insult among twenty words drowns.
"""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import Task
from lithic.llm.wordhash import flat, mix, slices, words

ORDER, SPAN, DECAY = 4, 7, 0.8
#: Bounds of the training sample: documents of each label, and characters of one of them.
SAMPLE, SAMPLE_CHARS = 1500, 100_000
LANDMARKS, ROUNDS, NEGATIVES, COST = 160, 3, 6000, 10.0
THRESHOLD = 0.7
#: Word scores that a worker keeps.
CACHE = 500_000
#: Characters summed at once.
SLICE = 1 << 20

_BITS = 6
_PATTERNS = [(0, *p) for span in range(ORDER, SPAN + 1) for p in itertools.combinations(range(1, span), ORDER - 1) if p[-1] == span - 1]
_WEIGHTS = [DECAY ** (p[-1] + 1 - ORDER) for p in _PATTERNS]


def _alphabet() -> np.ndarray:
    """Symbols of ASCII: 0 a border, 1 to 26 letters, 27 to 36 digits, 37 the rest; 38 to 63 are for other characters."""
    table = np.full(128, 37, np.uint8)
    for i in range(26):
        table[[65 + i, 97 + i]] = i + 1
    table[48:58] = 27 + np.arange(10)
    table[0x20] = 0
    return table


_SYMBOL = _alphabet()
_SEEN_LENGTHS = 4096


def _norms() -> np.ndarray:
    n = np.arange(_SEEN_LENGTHS)
    return np.sqrt(sum(w * w * np.maximum(0, n - p[-1]) for p, w in zip(_PATTERNS, _WEIGHTS, strict=True)))


_NORM = _norms()


def _norm(lengths: np.ndarray) -> np.ndarray:
    if lengths.max(initial=0) < _SEEN_LENGTHS:
        return _NORM[lengths]
    return np.sqrt(sum(w * w * np.maximum(0, lengths - p[-1]) for p, w in zip(_PATTERNS, _WEIGHTS, strict=True)))


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each character of UTF-8 bytes, number of characters before each byte)."""
    begins = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(begins)])
    out = _SYMBOL[np.minimum(data, 127)]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        point = padded[wide]
        for k, lead in enumerate((0xC0, 0xE0, 0xF0), 1):  # characters of two, three and four bytes
            point = np.where(padded[wide] >= lead, (point << 6) | (padded[wide + k] & 0x3F), point)
        out[wide] = 38 + point % 26
    return out[begins], before


def _symbols(read: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all strings, each between two borders; first symbol of each string) of bytes that ``_characters`` read."""
    symbol, before = read
    start, sizes = before[start], before[stop] - before[start]
    first = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.zeros(int(first[-1]), np.uint32)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(first[:-1] + 1, sizes) + inner] = symbol[np.repeat(start, sizes) + inner]
    return out, first


def naive_kernel(a: list[int], b: list[int]) -> float:
    """The kernel of two strings of symbols from its definition."""

    def features(s: list[int]) -> Counter:
        out: Counter = Counter()
        for i in range(len(s)):
            for places in itertools.combinations(range(i + 1, min(len(s), i + SPAN)), ORDER - 1):
                out[tuple(s[j] for j in (i, *places))] += DECAY ** (places[-1] - i + 1 - ORDER)
        return out

    one, two = features(a), features(b)
    return sum(v * two[k] for k, v in one.items())


def _occurrences(symbols: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern (places where it fits in a word, subsequences there, weight)."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(symbols))  # symbols from here to the word's end
    for pattern, weight in zip(_PATTERNS, _WEIGHTS, strict=True):
        at = np.flatnonzero(left > pattern[-1])
        key = symbols[at]
        for step in pattern[1:]:
            key = (key << np.uint32(_BITS)) | symbols[at + step]
        yield at, key, weight


def margins(data: np.ndarray, start: np.ndarray, stop: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of a string's subsequence weights over its norm, for all strings."""
    out = np.zeros(len(start))
    read = _characters(data)
    for a in range(0, len(start), 20_000):
        symbols, first = _symbols(read, start[a : a + 20_000], stop[a : a + 20_000])
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(symbols))
        out[a : a + 20_000] = _sums(symbols, left, first[:-1], table) / np.maximum(_norm(np.diff(first)), 1e-9)
    return out


def _sums(symbols: np.ndarray, left: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The weights of the subsequences that begin in each run of symbols from ``first`` on; ``left`` symbols are open to them."""
    out = np.zeros(len(first))
    for a in range(0, len(symbols), SLICE):  # so that one enormous word needs no more memory than many small ones
        b = min(a + SLICE, len(symbols))
        at_place = np.zeros(b - a)
        for pattern, weight in zip(_PATTERNS, _WEIGHTS, strict=True):
            n = min(b, len(symbols) - pattern[-1])
            if n <= a:
                continue
            key = symbols[a:n]
            for step in pattern[1:]:
                key = (key << np.uint32(_BITS)) | symbols[a + step : n + step]
            at_place[: n - a] += table[key] * (weight * (left[a:n] > pattern[-1]))
        low, high = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left")
        out[low:high] += np.add.reduceat(at_place, np.append(a, first[low + 1 : high]) - a)
    return out


def phrase_margins(data: np.ndarray, start: np.ndarray, stop: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The same for each word and the next as one string, a border between them; one fewer than words."""
    out = np.zeros(max(0, len(start) - 1))
    read = _characters(data)
    for a in range(0, len(out), 20_000):
        s, e = start[a : a + 20_001], stop[a : a + 20_001]
        symbol, before = read
        low, sizes = before[s], before[e] - before[s]
        first = np.concatenate([[0], np.cumsum(sizes + 1)])  # each word behind a border, the last before one
        symbols = np.zeros(int(first[-1]) + 1, np.uint32)
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols[np.repeat(first[:-1] + 1, sizes) + inner] = symbol[np.repeat(low, sizes) + inner]
        place = np.arange(len(symbols))
        word = np.repeat(np.arange(len(sizes)), sizes + 1)
        word = np.append(word, len(sizes) - 1)
        own = first[word + 1] + 1 - place
        both = first[np.minimum(word + 2, len(sizes))] + 1 - place
        one, two = _sums(symbols, own, first[:-1], table), _sums(symbols, both, first[:-1], table)
        out[a : a + 20_000] = (two[:-1] + one[1:]) / np.maximum(_norm(sizes[:-1] + sizes[1:] + 3), 1e-9)
    return out


def _buffer(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in found], dtype=np.int64)
    return np.frombuffer(b"".join(found), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(found) else ends, ends


def _strings(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, start, stop = _buffer(found)
    return _symbols(_characters(data), start, stop)


class _Landmarks:
    """Kernel rows against fixed words."""

    def __init__(self, found: list[bytes]) -> None:
        self.found = found
        symbols, first = _strings(found)
        parts = [(np.searchsorted(first, at, "right") - 1, key, np.full(len(at), w)) for at, key, w in _occurrences(symbols, first)]
        word, key, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.keys, row = np.unique(key, return_inverse=True)
        norm = np.maximum(_norm(np.diff(first)), 1e-9)
        self.features = np.zeros((len(self.keys), len(found)))
        np.add.at(self.features, (row, word), weight / norm[word])

    def kernel(self, found: list[bytes]) -> np.ndarray:
        out = np.zeros((len(found), self.features.shape[1]))
        for a in range(0, len(found), 1000):
            symbols, first = _strings(found[a : a + 1000])
            norm = np.maximum(_norm(np.diff(first)), 1e-9)
            for at, key, w in _occurrences(symbols, first):
                row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[row] == key
                at, row = at[known], row[known]
                word = np.searchsorted(first, at, "right") - 1
                cuts = np.flatnonzero(np.diff(word, prepend=-1))
                if len(cuts):
                    out[a + word[cuts]] += np.add.reduceat(self.features[row], cuts, axis=0) * (w / norm[word[cuts]])[:, None]
        return out

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """The weights of the subsequences ``keys`` for the expansion with ``weights``."""
        return (self.features @ weights).astype(np.float32)


def _machine(x: np.ndarray, y: np.ndarray, importance: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps; the last column of ``x`` is all ones."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xa, ia = x[on], importance[on] * cost
        gradient = ridge @ w - xa.T @ (ia * y[on] * slack[on])
        step = np.linalg.solve(ridge + (xa * ia[:, None]).T @ xa, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of margins, with smoothed labels."""
    up, down = label.sum(), (1 - label).sum()
    goal = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - goal) * margin).sum() + 1e-3 * a, (p - goal).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    """Subsequences with their weights, the bias, the logistic curve of margins, and whether phrases count."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    phrases: bool = False

    @property
    def key(self) -> str:
        return hashlib.md5(self.keys.tobytes() + self.weights.tobytes()).hexdigest()

    def table(self) -> np.ndarray:
        """The weight of every possible subsequence; a process keeps the table of one model."""
        if self.key not in _tables:
            _tables.clear()
            _tables[self.key] = np.zeros(1 << (_BITS * ORDER), np.float32)
            _tables[self.key][self.keys] = self.weights
        return _tables[self.key]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


_tables: dict[str, np.ndarray] = {}
#: Without labelled rows of both kinds: nothing is toxic.
NO_MODEL = Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), -1.0, 1.0, -4.0)


def _disguise(found: list[bytes], each: int, draw: random.Random) -> list[bytes]:
    """Spellings of words with characters put in between, doubled or exchanged."""
    out = []
    for word in found:
        for _ in range(each):
            sign = draw.choice([b".", b"-", b"*", b"_", b"1", b"x"])
            at = draw.randrange(1, max(2, len(word)))
            out.append(draw.choice([sign.join(word[i : i + 1] for i in range(len(word))), word[:at] + sign + word[at:], word[:at] + word[at - 1 : at] + word[at:], word[:at] + sign + word[at + 1 :]]))
    return out


def _coded(labels: pa.ChunkedArray, texts: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """(sorted words, label of each document, places of its words in order), near copies of a document once.

    Words become numbers in Arrow, so the task holds no object per word and document. The
    words of a document come in order, those that are spelled in single characters behind.
    """
    listed = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    encoded = listed.flatten().dictionary_encode()
    found = encoded.dictionary.to_pylist()
    order = sorted(range(len(found)), key=found.__getitem__)
    found = [found[i] for i in order]
    codes = np.argsort(order)[encoded.indices.to_numpy()] if order else np.zeros(0, np.int64)
    digests = [hashlib.md5(w).digest() for w in found]
    drawn = np.argsort(sorted(range(len(found)), key=digests.__getitem__)) if order else codes
    first = np.concatenate([[0], np.cumsum([len(b) for b in listed])]).astype(np.int64)
    rows = [(y, np.unique(codes[a:b]).astype(">u4"), codes[a:b]) for y, a, b in zip(labels.to_pylist(), first[:-1], first[1:], strict=True)]
    seen: dict[tuple, tuple[int, np.ndarray, np.ndarray]] = {}
    for y, bag, row in sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())):
        seen.setdefault((y, *np.sort(drawn[bag])[:2].tolist()), (y, bag, row))
    used = np.unique(np.concatenate([bag for _, bag, _ in seen.values()])) if seen else codes
    place = lambda x: np.searchsorted(used, x)
    rows = [x for x in seen.values() if len(x[1])]
    return [found[i] for i in used], np.array([y for y, _, _ in rows], np.int64), [place(row) for _, _, row in rows]


def _marks(up: np.ndarray, down: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Which of the strings that so many toxic and clean documents hold mark toxic ones beyond chance, however many are looked at."""
    n, share = np.maximum(up + down, 1), toxic / (toxic + clean)
    ratio = up * np.log(np.maximum(up, 1e-9) / (n * share)) + down * np.log(np.maximum(down, 1e-9) / (n * (1 - share)))
    return (up > n * share) & (ratio > np.log(max(len(up), 1) / 0.01))


def _odds(up: np.ndarray, down: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    return np.log((up / toxic + 1e-4) / (down / clean + 1e-4)) * np.minimum(1.0, up / 3)


def _phrases(rows: list[np.ndarray], y: np.ndarray, missed: np.ndarray, words_: int, most: int) -> np.ndarray:
    """Neighbouring words that mark toxic documents which no word marks."""
    pairs = [np.unique(row[:-1] * words_ + row[1:]) for row in rows]
    toxic, clean = int((y == 1).sum()), int((y == 0).sum())
    found, up = np.unique(np.concatenate([pairs[i] for i in missed]), return_counts=True)
    many = len(found)
    found, up = found[up >= max(5, 0.01 * toxic)], up[up >= max(5, 0.01 * toxic)]
    down = np.zeros(len(found), np.int64)
    for i in np.flatnonzero(y == 0):
        down += np.isin(found, pairs[i], assume_unique=True)
    odds = _odds(up, down, max(1, len(missed)), clean)
    marked = _marks(np.append(up, np.zeros(many - len(up))), np.append(down, np.zeros(many - len(up))), max(1, len(missed)), clean)[: len(up)]
    order = np.lexsort((found, -odds))
    return found[order[marked[order] & (odds[order] > np.log(30))]][:most]


def fit(labels: pa.ChunkedArray, texts: pa.ChunkedArray) -> Model:
    """A model from the labels and the words of documents, in order.

    Phrases are looked for in the toxic documents that the machine of words leaves; where
    there are some, a second machine learns words and phrases.
    """
    vocabulary, y, rows = _coded(labels, texts)
    if not (y == 1).any() or not (y == 0).any():
        return NO_MODEL
    bags = [np.unique(row) for row in rows]
    model, best = _train(vocabulary, y, bags, [])
    missed = np.flatnonzero((y == 1) & (model.probability(best) < THRESHOLD))
    phrases = _phrases(rows, y, missed, len(vocabulary), LANDMARKS // 4) if len(missed) else []
    if not len(phrases):
        return model
    count = len(vocabulary)
    draw = np.random.default_rng(7)
    clean = np.unique(np.concatenate([rows[i][:-1] * count + rows[i][1:] for i in np.flatnonzero(y == 0)]))
    alike = np.isin(clean // count, phrases // count) | np.isin(clean % count, phrases % count)
    added = np.unique(np.concatenate([phrases, draw.permutation(clean[alike])[:10_000], draw.permutation(clean)[:10_000]]))
    bags = [np.union1d(bag, count + np.flatnonzero(np.isin(added, row[:-1] * count + row[1:]))) for bag, row in zip(bags, rows, strict=True)]
    longer = vocabulary + [vocabulary[k // count] + b" " + vocabulary[k % count] for k in added.tolist()]
    model, best = _train(longer, y, bags, (count + np.searchsorted(added, phrases)).tolist())
    model.phrases = True
    data, start, stop = _buffer(vocabulary)
    for i, row in enumerate(rows):
        if len(row) > 1:
            best[i] = max(best[i], phrase_margins(data, start[row], stop[row], model.table()).max() + model.bias)
    model.slope, model.offset = _platt(best, y.astype(float))
    return model


def _train(vocabulary: list[bytes], y: np.ndarray, bags: list[np.ndarray], known: list[int]) -> tuple[Model, np.ndarray]:
    """A machine for the strings ``vocabulary`` of documents, ``known`` ones being insults, and the highest margin of each document."""
    toxic, clean = ([bag for label, bag in zip(y, bags, strict=True) if label == kind] for kind in (1, 0))
    up, down = (np.bincount(np.concatenate(x), minlength=len(vocabulary)) for x in (toxic, clean))
    odds = _odds(up, down, len(toxic), len(clean))
    marked = _marks(up, down, len(toxic), len(clean))
    sure = [*np.flatnonzero(marked & (odds > np.log(30))).tolist(), *known]
    everything = _buffer(vocabulary)
    cleanly = np.flatnonzero(down)
    common = cleanly[np.argsort(-down[cleanly], kind="stable")]
    draw = random.Random(7)
    negatives = common[: NEGATIVES // 2].tolist() + draw.sample(common[NEGATIVES // 2 :].tolist(), min(NEGATIVES // 2, max(0, len(common) - NEGATIVES // 2)))
    score, hard = odds, []
    model = NO_MODEL
    for _ in range(ROUNDS):
        may = np.where((marked & (odds > np.log(5))) | ((down == 0) & (score > 0) & (score is not odds)), score, -np.inf)  # no word stands for a document by chance
        found = ((bag, int(np.argmax(may[bag]))) for bag in toxic)
        stands = Counter(sure) + Counter(int(bag[i]) for bag, i in found if may[bag[i]] > -np.inf)
        if not stands:
            return NO_MODEL, np.full(len(bags), NO_MODEL.bias)
        positive = sorted(stands, key=lambda i: (-up[i], i))
        against = [i for i in dict.fromkeys([*negatives, *hard]) if i not in stands]
        marks = _Landmarks([vocabulary[i] for i in [*positive[: LANDMARKS * 3 // 4], *hard[: LANDMARKS // 8], *against]][:LANDMARKS])
        plus, minus = [vocabulary[i] for i in positive], [vocabulary[i] for i in against]
        hidden, harmless = _disguise(plus[:40], 8, draw), _disguise(minus[:: max(1, len(minus) // 1000)], 1, draw)
        x = marks.kernel([*plus, *hidden, *minus, *harmless])
        value, vector = np.linalg.eigh(marks.kernel([*marks.found]))
        whiten = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T
        goal = np.array([1.0] * (len(plus) + len(hidden)) + [-1.0] * (len(minus) + len(harmless)))
        weight = np.concatenate([1 + np.log(up[positive]), np.full(len(hidden), 0.5), np.ones(len(minus) + len(harmless))])
        features = np.ones((len(x), x.shape[1] + 1))
        features[:, :-1] = x @ whiten
        del x
        w = _machine(features, goal, weight)
        model = Model(marks.keys, marks.fold(whiten @ w[:-1]), float(w[-1]), 1.0, 0.0)
        score = margins(*everything, model.table()) + model.bias
        hard = cleanly[np.argsort(-score[cleanly], kind="stable")[: NEGATIVES // 4]].tolist()
    best = np.array([score[bag].max() for bag in bags])
    model.slope, model.offset = _platt(best, y.astype(float))
    return model, best


def _spelled(data: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> list[tuple[int, bytes]]:
    """(text, word) of each run of at least four words of one byte."""
    single = (stop - start) == 1
    if not single.any():
        return []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(single)
    borders = np.flatnonzero((np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])) + 1
    begin, end = np.append(0, borders), np.append(borders, len(at))
    long = end - begin >= ORDER
    return [(int(text[at[a]]), data[start[at[a:b]]].tobytes()) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]


_scores: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def document_margins(texts: pa.Array, model: Model) -> np.ndarray:
    """The highest word margin of each text; the bias, or less, for texts without words."""
    data, ends = flat(texts)
    hashes, start, stop, first = words(data, ends)
    out = np.full(len(texts), min(model.bias, -1.0))
    if len(hashes):
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        value = np.zeros(len(distinct))
        known, known_value = _scores.get(model.key, (np.zeros(0, np.uint64), np.zeros(0)))
        new = np.ones(len(distinct), bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            new = known[at] != distinct
            value[~new] = known_value[at[~new]]
        value[new] = margins(data, start[index[new]], stop[index[new]], model.table()) + model.bias
        if len(known) + new.sum() <= CACHE:
            both = np.concatenate([known, distinct[new]])
            order = np.argsort(both, kind="stable")
            _scores.clear()
            _scores[model.key] = both[order], np.concatenate([known_value, value[new]])[order]
        full = np.flatnonzero(np.diff(first))
        out[full] = np.maximum(np.maximum.reduceat(value[inverse], first[full]), out[full])
        if model.phrases:
            text = np.repeat(np.arange(len(texts)), np.diff(first))
            same = text[1:] == text[:-1]
            np.maximum.at(out, text[1:][same], phrase_margins(data, start, stop, model.table())[same] + model.bias)
    spelled = _spelled(data, start, stop, first)
    if spelled:
        more = margins(*_buffer([w for _, w in spelled]), model.table()) + model.bias
        for (text, _), m in zip(spelled, more, strict=True):
            out[text] = max(out[text], m)
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, ends = flat(part["text"])
            _, start, stop, first = words(data, ends)
            raw = data.tobytes().lower()
            bags = [[raw[a:b] for a, b in zip(start[i:j].tolist(), stop[i:j].tolist(), strict=True)] for i, j in itertools.pairwise(first.tolist())]
            for text, word in _spelled(data, start, stop, first):
                bags[text].append(word.lower())
            yield pa.RecordBatch.from_arrays([part["toxic"], pa.array(bags, pa.list_(pa.binary()))], ["toxic", "words"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all documents of a task, as one row."""
    found = [b for b in batches if b.num_rows]
    model = fit(pa.chunked_array([b["toxic"] for b in found]), pa.chunked_array([b["words"] for b in found])) if found else NO_MODEL
    numbers = [pa.array([x]) for x in (model.bias, model.slope, model.offset, model.phrases)]
    yield pa.RecordBatch.from_arrays([pa.array([model.keys.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), *numbers], ["keys", "weights", "bias", "slope", "offset", "phrases"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents of each label, those with the least hash of their id.

    Only labels of ids whose CRC-32 modulo 3 is not 1 are used. The bound is per label, so
    one task gets the words of at most 2 * sample documents, of SAMPLE_CHARS characters
    each at most. It fits the machine, and runs again elsewhere if its executor is lost;
    the driver gets the model alone: a row for each subsequence of LANDMARKS strings.
    """
    labelled = F.col("doc_id").cast("long")
    text_id = labelled.cast("string")
    own = labels.where((F.crc32(text_id.cast("binary")) % 3 != 1) & F.col("toxic").isin(0, 1)).select(labelled.alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    draw = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = [own.where(F.col("toxic") == y).orderBy(draw, "doc_id").limit(sample) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id")
    bags = rows.select("toxic", "text").mapInArrow(Task(_bags), "toxic int, words array<binary>")
    fitted = bags.repartition(1).mapInArrow(Task(_fit), "keys binary, weights binary, bias double, slope double, offset double, phrases boolean").collect()  # one row
    if not fitted:
        return NO_MODEL
    row = fitted[0]
    return Model(np.frombuffer(bytes(row["keys"]), np.uint32), np.frombuffer(bytes(row["weights"]), np.float32), row["bias"], row["slope"], row["offset"], row["phrases"])


class _Score:
    """A batch's columns and, behind them, the score of its ``_text``."""

    def __init__(self, model) -> None:
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in batches:
            for part in slices(batch, "_text", most=6 << 20):
                margin = document_margins(part["_text"], model)
                kept = [i for i, n in enumerate(part.schema.names) if n != "_text"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], pa.array(model.probability(margin))], [*[part.schema.names[i] for i in kept], "_score"])


def score(docs: DataFrame, labels: DataFrame, keep: bool = False, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; with ``keep`` instead its own columns and ``_score``.

    Scores depend on the text alone. Null text counts as empty; a text without words gets
    a low score; repeated rows get equal scores; an empty table gives an empty result; a
    table without usable labels scores all texts low; ids may be of any whole type. Other
    columns take no part; with ``keep`` a column named ``_score`` or ``_text`` is replaced.
    """
    model = model or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the subsequences of LANDMARKS strings, whatever the data
    fields = [f for f in docs.schema.fields if f.name not in ("_score", "_text")] if keep else [T.StructField("doc_id", T.LongType())]
    text = F.col("text").cast("string").alias("_text")
    rows = docs.select(*[f.name for f in fields], text) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    scored = rows.mapInArrow(Task(_Score(shared)), T.StructType([*fields, T.StructField("_score", T.DoubleType())]))
    if keep:
        return scored
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
