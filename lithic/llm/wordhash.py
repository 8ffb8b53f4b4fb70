"""Words and word shingles of Arrow text columns as 64-bit hashes, whole arrays at a time.

A word is a run of bytes other than space and U+0009 to U+000D; in UTF-8 these bytes never
occur inside another character. Its hash is the sum of a mixed number for each pair of a
byte and its place in the word, finished by a bijective mixer: prefix sums give the hashes
of all words of a piece at once. A polynomial modulo 2 ** 64 would do less: whatever its
base, some words of a thousand letters, a and b in the order of Thue and Morse, fall together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; pieces end at separators, so one longer word is a longer piece.
PIECE = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.int64)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: Places in a word whose numbers are kept in a table.
_NEAR = 64


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(256 * _NEAR, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _placed(letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The number of each byte at its place in its word."""
    key = (place << 8) | letters
    far = np.flatnonzero(place >= _NEAR)
    if not len(far):
        return _TABLE[key]
    out = _TABLE[np.where(place < _NEAR, key, 0)]
    out[far] = mix(key[far].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def _pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    at, last = int(ends[0]), int(ends[-1])
    while at < last:
        cut = at + PIECE
        if cut < last:
            border = int(ends[np.searchsorted(ends, cut)])
            for i in range(cut, border, 4096):
                found = np.flatnonzero(_SEPARATOR[data[i : min(i + 4096, border)]])
                if len(found):
                    border = i + int(found[0])
                    break
            cut = border
        yield at, min(cut, last)
        at = min(cut, last)


def words(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop, first): of each word its hash and bytes; first word of each text, and their number."""
    hashes, starts, stops = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    letters = _LOWER if lower else _SAME
    borders = ends[1:-1]
    for a, b in _pieces(data, ends):
        part = data[a:b]
        word = ~_SEPARATOR[part]
        begins, stop = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        inner = borders[np.searchsorted(borders, a) : np.searchsorted(borders, b)] - a
        inner = inner[inner < b - a]
        begins[inner] = word[inner]
        before = inner[inner > 0] - 1
        stop[before] = word[before]
        s, e = np.flatnonzero(begins), np.flatnonzero(stop) + 1
        place = np.zeros(len(part), np.int64)
        place[s] = s
        place = np.arange(len(part)) - np.maximum.accumulate(place)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_placed(letters[part], np.where(word, place, 0)), out=sums[1:])
        hashes.append(mix(sums[e] - sums[s] + (e - s).astype(np.uint64)))
        starts.append(s + a)
        stops.append(e + a)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(stops), np.searchsorted(start, ends)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): of each run of ``width`` words of a text; of all its words, if it has fewer; of none for none."""
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_first[-1])
    factors = _powers(0xD1342543DE82EF95, width)
    out = np.zeros(total, np.uint64)
    if not total:
        return out, out_first
    text = np.repeat(np.arange(len(n)), counts)
    at = first[text] + (np.arange(total) - out_first[text])
    size = np.minimum(n[text], width)
    short = size < width
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for j in range(width):
        part = padded[at + j] * factors[j]
        if short.any():
            part[size <= j] = 0
        out += part
    return mix(out + size.astype(np.uint64)), out_first


def text_shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, A-Z lower-cased."""
    data, ends = flat(texts)
    hashes, _, _, first = words(data, ends)
    return shingles(hashes, first, width)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text at most, but a row at least."""
    texts = batch[column]
    if not len(texts):
        return
    sizes = np.diff(flat(texts)[1])
    part = np.cumsum(sizes) // most
    at = 0
    for cut in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]:
        while at < cut:
            yield batch.slice(at, min(rows, cut - at))
            at += min(rows, cut - at)
