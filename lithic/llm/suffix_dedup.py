"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A string of LENGTH bytes that also starts earlier goes. Not every suffix is sorted, only
those that begin at an anchor: of the k-grams inside a string of LENGTH bytes the one with
the least hash, which depends on the string's bytes alone, so equal strings have equal
anchors at equal places. A suffix at an anchor is compared over LENGTH bytes, and then over
the bytes before the anchor, read backwards.

1. Every slice of the input finds its anchors and sends the hashes of their k-grams; only
   k-grams that occur twice are sorted, since no other string can recur.
2. Slices sort the suffixes at such anchors in runs of bounded size, each distinct one once,
   and cut runs at the splitters of a sample. The pieces are front-coded: each suffix as the
   length of the prefix that it shares with the one before, and the rest.
3. Each range merges its pieces in a tree of losers that carries shared prefixes along and
   compares bytes behind them only. Equal suffixes settle all strings that their anchors
   stand for. What the order tells of shared prefixes, forwards and backwards, settles the
   strings of suffixes that differ somewhere.
4. Suffixes whose k-gram occurs on both sides of a splitter are ordered once more, by the
   bytes before the anchor; strings that both orders leave open are compared one by one.
5. Slices read their documents again and cut the strings out.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import Task, runs, staged

LENGTH = 100
#: Bytes hashed at once; suffixes of a run; anchors of a range and hashes of a bucket; sampled suffixes at most; suffixes settled at once.
PIECE, RUN, RANGE, SAMPLE, CHUNK = 1 << 18, 100_000, 1_000_000, 200_000, 200_000
_LOW = np.uint64((1 << 20) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _STEP
    return (h ^ (h >> np.uint64(29))) * _STEP


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on: lengths are doubled, a byte is added where k has a bit."""
    with np.errstate(over="ignore"):
        one = _BYTES[values]
        out, length, power = one, 1, _STEP
        for bit in bin(k)[3:]:
            out = out[:-length] * power + out[length:]
            length, power = 2 * length, power * power
            if bit == "1":
                out = out[:-1] * _STEP + one[length:]
                length, power = length + 1, power * _STEP
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours from each place on."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def _groups(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal neighbours."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Shape:
    """Lengths that belong together: strings, k-grams, bytes kept before an anchor, bytes of a sorted suffix."""

    def __init__(self, length: int) -> None:
        if not 12 <= length <= 120:
            raise ValueError("strings have 12 to 120 bytes")
        self.length, self.k, self.piece = length, length // 3, PIECE
        self.left = length - self.k
        self.width = length + self.left + 2  # the last two bytes: how many of the others are real

    def anchors(self, values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(at, first, last, hash): anchors in concatenated documents, and the strings they stand for, by their starts."""
        starts, n = ends[:-1], self.length
        inside = np.zeros(len(values) + 1, np.int8)
        full = np.flatnonzero(ends[1:] - starts >= n)
        np.add.at(inside, starts[full], 1)
        np.add.at(inside, ends[1:][full] - n + 1, -1)
        inside = np.cumsum(inside, dtype=np.int8)
        found = []
        for at in range(0, len(values) - n + 1, self.piece):
            part = values[at : at + self.piece + n - 1]
            places = np.flatnonzero(inside[at : at + len(part) - n + 1])
            if not len(places):
                continue
            hashes = rolling(part, self.k)
            best = _least(hashes & ~_LOW | np.arange(len(hashes), dtype=np.uint64), self.left + 1)[places] & _LOW
            first = np.flatnonzero(np.diff(best, prepend=best[0] + np.uint64(1)))
            last = np.append(first[1:], len(best)) - 1
            best = best[first].astype(np.int64)
            found.append((best + at, places[first] + at, places[last] + at, hashes[best]))
        if not found:
            return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
        at, first, last, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        new = np.flatnonzero(np.diff(at, prepend=-1))  # an anchor may stand in two pieces
        with np.errstate(over="ignore"):
            return at[new], first[new], last[np.append(new[1:], len(at)) - 1], _mixed(hashes[new])

    def suffixes(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of bytes for each anchor: forwards, backwards, and the two numbers of real bytes."""
        out = np.zeros((len(at), self.width), np.uint8)
        ahead, behind = np.minimum(end - at, self.length), np.minimum(at - begin, self.left)
        for a in range(0, len(at), 8192):
            x = at[a : a + 8192, None]
            for lo, hi, step, real in ((0, self.length, np.arange(self.length), ahead), (self.length, self.width - 2, -1 - np.arange(self.left), behind)):
                part = np.take(values, x + step, mode="clip")
                part[np.arange(hi - lo) >= real[a : a + 8192, None]] = 0
                out[a : a + 8192, lo:hi] = part
        out[:, -2], out[:, -1] = ahead, behind
        return out


def _sortable(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _shared(rows: np.ndarray) -> np.ndarray:
    """The length of the prefix that each row shares with the one before; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differs = rows[1:] != rows[:-1]
    return np.append(0, np.where(differs.any(1), differs.argmax(1), rows.shape[1]))


_FIELDS = (("key", np.int64), ("row", np.int64), ("off", np.int32), ("back", np.uint8), ("ahead", np.uint8))


def packed(rows: np.ndarray, fields: dict[str, np.ndarray]) -> bytes:
    """A piece of a sorted run, front-coded and compressed."""
    shared = _shared(rows)
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    parts = [np.int64(len(rows)).tobytes(), shared.astype(np.uint8).tobytes(), *[fields[name].astype(kind).tobytes() for name, kind in _FIELDS], rest.tobytes()]
    return _squeezed(b"".join(parts))


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _loose(block: bytes) -> bytes:
    return pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)


class Piece:
    """A packed piece as it is merged: one suffix at a time."""

    def __init__(self, block: bytes, width: int) -> None:
        raw = _loose(block)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        self.shared, at = raw[8 : 8 + n], 8 + n
        self.fields = {}
        for name, kind in _FIELDS:
            self.fields[name] = np.frombuffer(raw, kind, n, at)
            at += n * np.dtype(kind).itemsize
        self.raw, self.at, self.width, self.n = raw, at, width, n
        self.next, self.suffix = 0, b""

    def advance(self) -> int:
        """The shared length of the next suffix, which becomes ``suffix``; -1 behind the last."""
        if self.next == self.n:
            return -1
        shared = self.shared[self.next]
        self.next += 1
        end = self.at + self.width - shared
        self.suffix = self.suffix[:shared] + self.raw[self.at : end]
        self.at = end
        return shared


class LoserTree:
    """Merges pieces. Each suffix comes with the length of the prefix that it shares with the one put out last.

    Of two suffixes that with the longer shared prefix is the smaller, without a look at
    any byte. Only with equal lengths are bytes compared, from there on; what the loser
    shares with the winner is then known. ``compared`` counts those bytes.
    """

    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces
        self.size = 1 << max(0, len(pieces) - 1).bit_length()
        self.shared = [p.advance() for p in pieces] + [-1] * (self.size - len(pieces))
        self.shared = [0 if x >= 0 else -1 for x in self.shared]
        self.losers = [0] * self.size
        self.compared = 0
        won = list(range(self.size))
        at = self.size
        while len(won) > 1:
            at //= 2
            pairs = [self._play(won[i], won[i + 1]) for i in range(0, len(won), 2)]
            self.losers[at : 2 * at] = [x[1] for x in pairs]
            won = [x[0] for x in pairs]
        self.top = won[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two leaves."""
        x, y = self.shared[a], self.shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = self.pieces[a].suffix, self.pieces[b].suffix
        differs = int.from_bytes(s[x:], "big") ^ int.from_bytes(t[x:], "big")
        same = len(s) - (differs.bit_length() + 7) // 8
        self.compared += same - x + (differs != 0)
        if s <= t:
            self.shared[b] = same
            return a, b
        self.shared[a] = same
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(piece, place in it, suffix, length shared with the suffix before), in order."""
        while self.shared[self.top] >= 0:
            leaf = self.top
            piece = self.pieces[leaf]
            yield leaf, piece.next - 1, piece.suffix, self.shared[leaf]
            self.shared[leaf] = piece.advance()
            node = (leaf + self.size) // 2
            while node:
                leaf, self.losers[node] = self._play(leaf, self.losers[node])
                node //= 2
            self.top = leaf


class Decisions:
    """Strings that recur, by row: starts from ``lo`` to ``hi``; packed for each slice of the input."""

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []

    def add(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        if len(row):
            self.rows.append(np.stack([row, lo.astype(np.int64), hi.astype(np.int64)], 1))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        if self.rows:
            rows = np.concatenate(self.rows)
            self.rows = []
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            slices = rows[:, 0] >> 33
            for a, b in _groups(slices):
                part = rows[a:b].copy()
                part[:, 0] &= (1 << 33) - 1
                yield int(slices[a]), _squeezed(part.astype(np.int32).tobytes())


_HASHES = "kind int, bucket long, slice long, hashes binary, again binary, suffix binary, check long"
_KNOWN = "slice long, known binary, check long"
_PIECES = "kind int, part int, slice long, block binary, check long"
_OUT = "slice long, block binary, check long, string binary, key long, row long, start int, rest binary"
_STRINGS = "string binary, key long, row long, start int"


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in names], [n for n, _ in names])


def _bodies(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of documents, and where each begins and ends."""
    column = batch["body"]
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[ends[0] : ends[-1]], ends - ends[0]


def _checked(check: int, batch: pa.RecordBatch, values: np.ndarray, ends: np.ndarray) -> int:
    """A sum over documents and their numbers, to tell whether a slice is read alike again."""
    view = memoryview(np.ascontiguousarray(values))
    for row, a, b in zip(batch["row"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        check = (check + (crc32(view[a:b]) + 1) * (2 * (row & ((1 << 33) - 1)) + 1)) & _LAST
    return check


class _Hashes:
    """Hashes of a slice's k-grams by bucket, and some of its suffixes."""

    def __init__(self, shape: Shape, buckets: int, step: int) -> None:
        self.shape, self.buckets, self.step = shape, buckets, step

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes, check, seen = None, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch["slice"][0].as_py()
            values, ends = _bodies(batch)
            check = _checked(check, batch, values, ends)
            at, _, _, hashed = self.shape.anchors(values, ends)
            hashes.append(hashed)
            picked = np.arange((own * 7919 - seen) % self.step, len(at), self.step)
            seen += len(at)
            if len(picked):
                doc = np.searchsorted(ends, at[picked], "right") - 1
                suffixes = self.shape.suffixes(values, ends[doc], ends[doc + 1], at[picked])
                yield _batch(_HASHES, [{"kind": 1, "slice": own, "suffix": s.tobytes()} for s in suffixes])
        if own is not None:
            hashed, counts = np.unique(np.concatenate(hashes), return_counts=True)
            bucket = ((hashed >> np.uint64(40)) * np.uint64(self.buckets)) >> np.uint64(24)
            low = np.ascontiguousarray(hashed).view(np.uint8).reshape(-1, 8)[:, :6]
            for a, b in _groups(bucket):
                yield _batch(_HASHES, [{"kind": 0, "bucket": int(bucket[a]), "slice": own, "hashes": low[a:b].tobytes(), "again": np.packbits(counts[a:b] > 1).tobytes(), "check": check}])
            if not len(hashed):  # the slice is checked though nothing in it can recur
                yield _batch(_HASHES, [{"kind": 0, "bucket": -1 - own % self.buckets, "slice": own, "hashes": b"", "again": b"", "check": check}])


def _six(raw: bytes) -> np.ndarray:
    """Numbers of six bytes."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice's hashes in a bucket those that occur twice in the whole."""
    for _, table in runs(batches, "bucket"):
        parts = [_six(x) for x in table["hashes"].to_pylist()]
        sizes = [len(p) for p in parts]
        hashes = np.concatenate(parts)
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["again"].to_pylist(), sizes, strict=True)]).astype(bool)
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order][1:] == hashes[order][:-1]
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        at = 0
        for own, check, n in zip(table["slice"].to_pylist(), table["check"].to_pylist(), sizes, strict=True):
            some = np.ascontiguousarray(hashes[at : at + n][again[at : at + n]]).view(np.uint8).reshape(-1, 8)[:, :6]
            at += n
            yield _batch(_KNOWN, [{"slice": own, "known": some.tobytes(), "check": check}])


class _Runs:
    """Sorted runs of a slice's suffixes whose k-grams recur, cut at the splitters, and what a run settles by itself."""

    def __init__(self, shape: Shape, splitters: list[bytes]) -> None:
        self.shape, self.splitters, self.run = shape, splitters, RUN

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in _slices(batches):
            yield from self._slice(own, part)

    def _slice(self, own: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, want, check, held, count = [], None, 0, [], 0
        decisions = Decisions()
        for batch in batches:
            if batch["side"][0].as_py() == 0:
                known += [_six(x) for x in batch["known"].to_pylist()]
                want = batch["check"][0].as_py()
                continue
            if isinstance(known, list):
                known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
            values, ends = _bodies(batch)
            check = _checked(check, batch, values, ends)
            at, first, last, hashed = self.shape.anchors(values, ends)
            hashed &= np.uint64((1 << 48) - 1)
            place = np.minimum(np.searchsorted(known, hashed), max(0, len(known) - 1))
            some = np.flatnonzero(known[place] == hashed) if len(known) else np.zeros(0, np.int64)
            for a in range(0, len(some), self.run):
                pick = some[a : a + self.run]
                doc = np.searchsorted(ends, at[pick], "right") - 1
                key = np.array([_LAST if x is None else x for x in batch["id"].to_pylist()], np.int64)[doc]
                fields = {"key": key, "row": batch["row"].to_numpy()[doc], "off": at[pick] - ends[doc], "back": at[pick] - first[pick], "ahead": at[pick] - last[pick]}
                held.append((self.shape.suffixes(values, ends[doc], ends[doc + 1], at[pick]), fields))
                count += len(pick)
                if count >= self.run:
                    yield from self._run(own, held, decisions)
                    held, count = [], 0
        if check != want:
            raise RuntimeError("the documents were not read alike twice: write computed documents to a table first")
        if count:
            yield from self._run(own, held, decisions)
        for of, block in decisions.blocks():
            yield _batch(_PIECES, [{"kind": 1, "part": of % (len(self.splitters) + 1), "slice": of, "block": block}])
        yield _batch(_PIECES, [{"kind": 1, "part": own % (len(self.splitters) + 1), "slice": own, "check": check}])

    def _run(self, own: int, held: list, decisions: Decisions) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([x[0] for x in held])
        fields = {name: np.concatenate([x[1][name] for x in held]) for name, _ in _FIELDS}
        early = np.lexsort((fields["off"], fields["row"], fields["key"]))
        order = early[np.argsort(_sortable(rows[early]), kind="stable")]
        rows, fields = rows[order], {name: x[order] for name, x in fields.items()}
        new = _shared(rows) < rows.shape[1]
        late = ~new
        decisions.add(fields["row"][late], (fields["off"] - fields["back"])[late], (fields["off"] - fields["ahead"])[late])
        rows, fields = rows[new], {name: x[new] for name, x in fields.items()}
        part = np.searchsorted(np.array(self.splitters, f"S{rows.shape[1]}"), _sortable(rows), "right") if self.splitters else np.zeros(len(rows), np.int64)
        for a, b in _groups(part):
            yield _batch(_PIECES, [{"kind": 0, "part": int(part[a]), "slice": own, "block": packed(rows[a:b], {name: x[a:b] for name, x in fields.items()})}])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Sorted batches by slice, none with rows of two slices or sides."""
    cut = _cut(batches)
    batch = next(cut, None)
    while batch is not None:
        own = batch["slice"][0].as_py()
        rest: list[pa.RecordBatch | None] = [None]

        def of_slice(batch=batch, own=own, rest=rest):
            while batch is not None and batch["slice"][0].as_py() == own:
                yield batch
                batch = next(cut, None)
            rest[0] = batch

        part = of_slice()
        yield own, part
        for _ in part:
            pass
        batch = rest[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key = 2 * batch["slice"].to_numpy().astype(np.int64) + batch["side"].to_numpy()
            for a, b in _groups(key):
                yield batch.slice(a, b - a)


class _Merge:
    """Merges the pieces of a range and settles their strings; decisions of runs go through."""

    def __init__(self, shape: Shape, splitters: list[bytes]) -> None:
        self.shape, self.splitters, self.chunk = shape, splitters, CHUNK

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in runs(batches, "part"):
            pieces = []
            for kind, own, block, check in zip(*(table[c].to_pylist() for c in ("kind", "slice", "block", "check")), strict=True):
                if kind:
                    yield _batch(_OUT, [{"slice": own, "block": block, "check": check}])
                else:
                    pieces.append(Piece(block, self.shape.width))
            if pieces:
                yield from self._range(part, pieces)

    def _range(self, part: int, pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
        k, width = self.shape.k, self.shape.width
        borders = {s[:k] for s in self.splitters[max(0, part - 1) : part + 1]}
        decisions = Decisions()
        leaves, places, classes, distinct, shared = [], [], [], [], []
        for leaf, place, suffix, same in LoserTree(pieces):
            if same < width or not distinct:
                if same < k and len(leaves) >= self.chunk:
                    yield from self._settled(pieces, leaves, places, classes, distinct, shared, borders, decisions)
                    leaves, places, classes, distinct, shared = [], [], [], [], []
                distinct.append(suffix)
                shared.append(same)
            leaves.append(leaf)
            places.append(place)
            classes.append(len(distinct) - 1)
        yield from self._settled(pieces, leaves, places, classes, distinct, shared, borders, decisions)
        for own, block in decisions.blocks():
            yield _batch(_OUT, [{"slice": own, "block": block}])

    def _settled(self, pieces: list[Piece], leaves: list, places: list, classes: list, distinct: list, shared: list, borders: set, decisions: Decisions) -> Iterator[pa.RecordBatch]:
        """Whole groups of suffixes with one k-gram: those equal to an earlier one, then those that share enough on both sides."""
        shape = self.shape
        leaf, place, own = np.array(leaves), np.array(places), np.array(classes)
        fields = {name: np.zeros(len(leaf), kind) for name, kind in _FIELDS}
        order = np.argsort(leaf, kind="stable")
        for a, b in _groups(leaf[order]):
            piece = pieces[leaf[order[a]]]
            for name in fields:
                fields[name][order[a:b]] = piece.fields[name][place[order[a:b]]]
        off = fields["off"].astype(np.int64)
        back, ahead = fields["back"].astype(np.int64), fields["ahead"].astype(np.int64)
        order = np.lexsort((off, fields["row"], fields["key"], own))
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        late = np.ones(len(order), bool)
        late[first] = False
        late = order[late]
        decisions.add(fields["row"][late], off[late] - back[late], off[late] - ahead[late])
        first = order[first]  # of each distinct suffix its earliest place
        key, row, off, back, ahead = fields["key"][first], fields["row"][first], off[first], back[first], ahead[first]
        shared = np.minimum(np.array(shared), shape.length)
        shared[0] = 0  # a chunk begins with another k-gram
        near = np.maximum(shared, np.append(shared[1:], 0))
        rows = np.frombuffer(b"".join(distinct), np.uint8).reshape(len(distinct), shape.width)
        crossing = np.array([s[: shape.k] in borders for s in distinct])
        near[[0, -1]] = np.where(crossing[[0, -1]], shape.length, near[[0, -1]])  # a neighbour may be in the next range
        some = np.flatnonzero(near >= shape.k)
        if not len(some):
            return
        earlier = self._earlier(rows, shared, near, some, np.lexsort((off, row, key)), back, ahead)
        x, lo, hi = _spans(earlier)
        decisions.add(row[some[x]], off[some[x]] - hi, off[some[x]] - lo)
        deltas = np.arange(shape.left + 1)
        rest = ~earlier & (deltas >= ahead[some, None]) & (deltas <= back[some, None]) & (deltas >= shape.length - near[some, None]) & crossing[some, None]
        for i in np.flatnonzero(rest.any(1)):
            x = some[i]
            yield _batch(_OUT, [{"string": distinct[x], "key": int(key[x]), "row": int(row[x]), "start": int(off[x]), "rest": np.packbits(rest[i]).tobytes()}])

    def _earlier(self, rows: np.ndarray, shared: np.ndarray, near: np.ndarray, some: np.ndarray, order: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """For each of ``some`` suffixes and each number of bytes before the anchor: whether that string stands earlier at another.

        Strings are equal if the suffixes share enough bytes forwards and backwards. Those
        that share a length are neighbours in the forward order, and in the backward one.
        """
        shape = self.shape
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        behind = rows[some, shape.length : -2]
        turned = np.argsort(_sortable(behind), kind="stable")
        common = _shared(behind[turned])
        common[0] = 0
        earlier = np.zeros((len(some), shape.left + 1), bool)
        for d in range(shape.left + 1):
            use = np.flatnonzero((ahead[some] <= d) & (back[some] >= d) & (near[some] >= shape.length - d))
            if len(use) < 2:
                continue
            forwards = np.cumsum(shared < shape.length - d)[some[use]]
            backwards = np.empty(len(some), np.int64)
            backwards[turned] = np.cumsum(common < d)
            group = forwards * (len(some) + 1) + backwards[use]
            by = np.lexsort((rank[some[use]], group))
            again = np.append(False, group[by][1:] == group[by][:-1])
            earlier[use[by[again]], d] = True
        return earlier


def _spans(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first columns, last columns) of the runs of true cells in rows."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    return row, lo, hi - 1


class _Backwards:
    """Suffixes whose k-gram a splitter parts, in the order of their k-grams and the bytes before: their open strings that another may share.

    A string with more bytes before the anchor than a suffix shares with its neighbours in
    this order is no other suffix's. The first and last of a partition may have neighbours elsewhere.
    """

    def __init__(self, shape: Shape) -> None:
        self.shape = shape

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, before, was = self.shape, None, None
        for batch in batches:
            for now in batch.to_pylist():
                now["turned"] = now["string"][: shape.k] + now["string"][shape.length : -2]
                if before is not None:
                    after = _common(before["turned"], now["turned"]) - shape.k
                    yield from self._open(before, shape.left if was is None else max(was, after))
                    was = after
                before = now
        if before is not None:
            yield from self._open(before, shape.left)

    def _open(self, suffix: dict, most: int) -> Iterator[pa.RecordBatch]:
        ahead, behind = suffix["string"][: self.shape.length], suffix["string"][self.shape.length : -2]
        rest = np.flatnonzero(np.unpackbits(np.frombuffer(suffix["rest"], np.uint8), count=self.shape.left + 1)).tolist()
        found = [{"string": behind[:d][::-1] + ahead[: self.shape.length - d], "key": suffix["key"], "row": suffix["row"], "start": suffix["start"] - d} for d in rest if d <= most]
        if found:
            yield _batch(_STRINGS, found)


def _common(a: bytes, b: bytes) -> int:
    return len(a) - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class _Cuts:
    """A slice's documents without the strings that recur."""

    def __init__(self, length: int) -> None:
        self.length = length

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _slices(batches):
            yield from self._slice(part)

    def _slice(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, want, check = [], None, 0
        for batch in batches:
            if batch["side"][0].as_py() == 0:
                told += [np.frombuffer(_loose(x), np.int32).reshape(-1, 3) for x in batch["block"].to_pylist() if x is not None]
                odd = [(r, s, s) for r, s in zip(batch["at"].to_pylist(), batch["start"].to_pylist(), strict=True) if r is not None]
                told += [np.array(odd, np.int32)] if odd else []
                want = next((x for x in batch["check"].to_pylist() if x is not None), want)
                continue
            if isinstance(told, list):
                told = np.concatenate(told) if told else np.zeros((0, 3), np.int32)
                told = told[np.lexsort((told[:, 1], told[:, 0]))]
            values, ends = _bodies(batch)
            check = _checked(check, batch, values, ends)
            at = batch["row"].to_numpy() & ((1 << 33) - 1)
            begin, end = np.searchsorted(told[:, 0], at, "left"), np.searchsorted(told[:, 0], at, "right")
            kept, spans = [], []
            for i in range(len(at)):
                body = values[ends[i] : ends[i + 1]].tobytes()
                if end[i] > begin[i]:
                    body, cut = self._without(body, told[begin[i] : end[i]])
                    spans.append(cut)
                else:
                    spans.append([])
                kept.append(body)
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(ends)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])
        if check != (want or 0):
            raise RuntimeError("the documents were not read alike twice: write computed documents to a table first")

    def _without(self, body: bytes, told: np.ndarray) -> tuple[bytes, list[dict]]:
        lo, hi = told[:, 1].astype(np.int64), np.maximum.accumulate(told[:, 2].astype(np.int64) + self.length)
        new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
        begins, ends = lo[new], hi[np.append(new[1:], len(lo)) - 1]
        kept = [body[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(body)], strict=True)]
        return b"".join(kept), [{"begin": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): texts as bytes, without each byte of a string of ``length`` bytes that also starts earlier.

    Earlier is at a smaller doc_id, or before in the same document; strings are judged on the
    whole input and never cross documents. ``removed`` are the maximal runs of removed bytes,
    ``kept`` is what remains, which need not be valid UTF-8.

    Null texts count as empty; texts shorter than ``length`` stay; rows without an id count
    as the last, and rows that share an id in the order in which they are read; an empty
    table gives an empty result; other columns are ignored. The documents are read three
    times and must come in the same partitions and order, as files do: a difference stops
    the job.

    A slice is a partition of the input. No task holds more than the hashes of a slice or of
    a bucket, RUN suffixes or the packed pieces of a range. A string that very many documents
    share is one suffix in each run, and a k-gram that very many different suffixes share
    is cut by splitters like any other part of the order.
    """
    spark, shape = docs.sparkSession, Shape(length)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
    anchors = 2 * total // (shape.left + 2)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, ranges = min(1 << 20, max(parts, anchors // (4 * RANGE))), max(parts, anchors // RANGE)  # buckets by 24 bits of a hash
    own = docs.select(F.spark_partition_id().cast("long").alias("slice"), F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(key).cast("long").alias("id"), body.alias("body"))
    step = max(1, anchors // min(40 * ranges, SAMPLE))
    hashes = staged(own.select("slice", "row", "body").mapInArrow(Task(_Hashes(shape, buckets, step)), _HASHES), "hashes")
    sample = sorted(bytes(r["suffix"]) for r in hashes.where("kind = 1").select("suffix").collect())  # about SAMPLE at most
    splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    known = hashes.where("kind = 0").select("bucket", "slice", "hashes", "again", "check").repartition("bucket").sortWithinPartitions("bucket", "slice").mapInArrow(Task(_known), _KNOWN)
    pieces = _by_slice(own, known, parts).select("slice", "side", "row", "id", "body", "known", "check").mapInArrow(Task(_Runs(shape, splitters)), _PIECES)
    merged = pieces.repartitionById(max(1, len(splitters) + 1), "part").sortWithinPartitions("part").mapInArrow(Task(_Merge(shape, splitters)), _OUT)
    merged = staged(merged, "repeats")
    told = merged.where("string IS NULL").select("slice", "block", "check", F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("start"))
    told = told.unionByName(_by_string(merged.where("string IS NOT NULL").select("string", "key", "row", "start", "rest"), shape, parts))
    rows = _by_slice(own.drop("id"), told, parts).select("slice", "side", "row", "doc_id", "body", "block", "check", "at", "start")
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(Task(_Cuts(length)), f"doc_id {kind}, n_bytes long, removed array<struct<begin:int,end:int>>, kept binary")


def _by_slice(own: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """The documents of each slice behind what is told to it."""
    both = own.withColumn("side", F.lit(1)).unionByName(told.withColumn("side", F.lit(0)), allowMissingColumns=True)
    return both.repartitionById(parts, F.pmod("slice", F.lit(parts)).cast("int")).sortWithinPartitions("slice", "side", "row")


def _by_string(suffixes: DataFrame, shape: Shape, parts: int) -> DataFrame:
    """Strings of suffixes whose k-gram a splitter parts, as their ranges left them open: all but the earliest of each go.

    The earliest come back by a join with a shuffle of its own on both sides, so that adaptive
    execution can split a string that very many suffixes have.
    """
    behind = [F.substring("string", 1, shape.k), F.substring("string", shape.length + 1, shape.left), F.col("key"), F.col("row"), F.col("start")]
    turned = suffixes.repartitionByRange(parts, *behind).sortWithinPartitions(*behind)
    strings = staged(turned.mapInArrow(Task(_Backwards(shape)), _STRINGS), "strings")
    place = F.struct("key", "row", "start")
    first = strings.groupBy("string").agg(F.min(place).alias("first"))
    twin = F.concat("string", F.lit(b"\0"))
    again = strings.select(twin.alias("twin"), place.alias("place")).join(first.select(twin.alias("twin"), "first"), "twin").where("place > first")
    return again.select(F.shiftright("place.row", 33).alias("slice"), F.lit(None).cast("binary").alias("block"), F.lit(None).cast("long").alias("check"), F.col("place.row").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.col("place.start").alias("start"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what remains."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
