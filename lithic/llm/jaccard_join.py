"""Exact similarity join of word-shingle sets, by set-relation skipping.

Two documents link when their sets of distinct shingles have a Jaccard similarity of at
least PERCENT / 100. Prefixes of the sets, in an order that puts frequent shingles last,
find candidate groups: any two linked documents share a shingle of their prefixes, so they
fall in one group. Inside a group the inverted lists are in order of set size, and a
document visits only the stretch of each list that its size admits. Counts of common
shingles are derived from those of a highly similar document that was answered before,
by reading only the lists of the shingles in which the two differ. Documents that the
links found so far connect already are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import Task, filter_slot, id_filter, runs, staged
from lithic.llm.components import connected, roots
from lithic.llm.wordhash import mix, slices, text_shingles

PERCENT, WIDTH = 75, 5
#: Counters of shingle frequencies, and the parts they travel in.
COUNTERS, PARTS = 1 << 21, 32
#: Ids of a bit map at most; beyond, rows are thinned by a join.
MAPPED = 1 << 24
#: A block of a candidate group: at most so many documents, and about so many shingles.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000


def _ceil(a: np.ndarray, top: int, bottom: int) -> np.ndarray:
    return -(-a * top // bottom)


def prefixes(n: np.ndarray, percent: int = PERCENT, more: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles a set of ``n`` shows to smaller sets, and to larger or equal ones.

    A set shares at least percent/100 of its own shingles with any partner, and at least
    2 * percent / (100 + percent) of them with one that is not smaller. Prefixes with
    ``more`` shingles hold as many common ones.
    """
    return n - _ceil(n, percent, 100) + more, n - _ceil(n, 2 * percent, 100 + percent) + more


def common(n: np.ndarray) -> np.ndarray:
    """How many common shingles the longer prefixes of two linked sets hold, the smaller of which has ``n`` shingles."""
    return np.maximum(1, n // 16)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, byte plane by byte plane: rising ids and small counts take little more than a byte."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(steps).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    """The numbers that ``squeeze`` packed, as int64."""
    n = int.from_bytes(data[:4], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[4:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel())


def _shingles(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, shingle hashes, first of each row) of texts."""
    for part in slices(batch, most=2 << 20):
        yield (part, *text_shingles(part["text"], WIDTH))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for _, hashes, _ in _shingles(batch):
            total += _counters(hashes)
    if total.any():
        yield _parts(total)


def _counters(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes & np.uint64(COUNTERS - 1)).view(np.int64), minlength=COUNTERS).astype(np.uint32)


#: Counts of shared shingles, packed.
COUNTED = "part int, ids binary, counts binary, sizes binary"
SIGNED = "kind int, doc_id long, n long, sig1 long, sig2 long, part int, counts binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's size and signature (kind 0), and the task's counters of shingles (kind 1)."""
    names = [c.split()[0] for c in SIGNED.split(", ")]
    total = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for part, hashes, first in _shingles(batch):
            total += _counters(hashes)
            n, sig1, sig2 = np.zeros(len(part), np.int64), np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64)
            for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if a < b:
                    n[i], sig1[i], sig2[i] = _signature(np.unique(hashes[a:b]))
            cols = [pa.array(np.zeros(len(part), np.int32)), part["doc_id"].cast(pa.int64()), pa.array(n), pa.array(sig1.view(np.int64)), pa.array(sig2.view(np.int64)), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)
    if total.any():
        parts = _parts(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(parts), np.int32)), *[pa.nulls(len(parts), pa.int64())] * 4, *parts.columns], names)


def _signature(own: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    """Size and two sums of the hashes of a set."""
    return len(own), own.sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def _parts(total: np.ndarray) -> pa.RecordBatch:
    """Counts of a task, up to 255 each, in compressed parts."""
    cut = np.minimum(total, 255).astype(np.uint8).reshape(PARTS, -1)
    packed = [pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in cut]
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed counts of each part, as classes of their logarithm over the part's mean."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"], strict=True):
            found = np.frombuffer(pa.decompress(counts.as_py(), COUNTERS // PARTS, codec="zstd", asbytes=True), np.uint8)
            if part not in sums:
                sums[part] = np.zeros(len(found), np.uint64)
            sums[part] += found
    for part, counts in sums.items():
        over = np.maximum(counts / max(float(counts.mean()), 1.0), 1.0)
        classes = np.clip(np.floor(2 * np.log2(over)), 0, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["part", "counts"])


def frequency_classes(parts: DataFrame) -> np.ndarray:
    """For each counter a class that grows with the logarithm of its count, from the counters of all tasks.

    The counters are a fixed number of bytes, so what comes to the driver has a bound. The
    classes only order shingles; any order gives the same links.
    """
    summed = parts.select("part", "counts").repartition(PARTS, "part").mapInArrow(Task(_sum), "part int, counts binary").collect()  # PARTS rows
    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint8)
    for row in summed:
        out[row["part"]] = np.frombuffer(bytes(row["counts"]), np.uint8)
    return out.ravel()


class _Prefixes:
    """The prefixes of sets, packed by bucket of shingles; longer ones, that linked sets share several shingles of, if ``long``.

    The lower 32 bits of a hash, with the bucket, made of the upper 24, tell shingles apart
    well enough to find candidates.
    """

    SCHEMA = "bucket int, shingles binary, place binary, ids binary, sizes binary"

    def __init__(self, classes, buckets: int, long: bool = False) -> None:
        self.classes, self.buckets, self.long = classes, buckets, long

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = self.classes.value
        for batch in batches:
            for part, hashes, first in _shingles(batch):
                ids = part["doc_id"].to_numpy(zero_copy_only=False)
                known = ~np.asarray(part["doc_id"].is_null())
                rank = classes[hashes.astype(np.int64) & (COUNTERS - 1)]
                n = np.zeros(len(part), np.int64)
                found, place, index = [], [], []
                for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    if a == b or not known[i]:
                        continue
                    own, at = np.unique(hashes[a:b], return_index=True)
                    n[i] = len(own)
                    probe, store = prefixes(n[i], more=common(n[i]) if self.long else 1)
                    order = np.argsort(rank[a:b][at], kind="stable")[:probe]
                    found.append(own[order])
                    place.append(np.full(len(order), i, np.int32))
                    index.append(np.arange(len(order)) < store)
                if found:
                    yield self._packs(np.concatenate(found), np.concatenate(place), np.concatenate(index), ids, n)

    def _packs(self, found, place, index, ids, n) -> pa.RecordBatch:
        bucket = ((found >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, found, place, index = bucket[order], found[order], place[order], index[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out: list[list] = [[], [], [], [], []]
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            own, local = np.unique(place[a:b], return_inverse=True)
            for col, value in zip(out, (int(bucket[a]), found[a:b].astype(np.uint32).tobytes(), squeeze(2 * local + index[a:b]), squeeze(ids[own]), squeeze(n[own])), strict=True):
                col.append(value)
        cols = [pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in self.SCHEMA.split(", ")])


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket's postings a star per candidate group: (a, b = its least id)."""
    for _, packs in runs(batches, "bucket"):
        shingle, doc, n, store = [], [], [], []
        for s, p, i, z in zip(*[packs[c].to_pylist() for c in ("shingles", "place", "ids", "sizes")], strict=True):
            p = expand(p)
            own = p >> 1
            shingle.append(np.frombuffer(s, np.uint32))
            doc.append(expand(i)[own])
            n.append(expand(z).astype(np.uint32)[own])
            store.append((p & 1).astype(bool))
        shingle, doc, n, store = map(np.concatenate, (shingle, doc, n, store))
        order = np.argsort(shingle, kind="stable")
        same = shingle[order][1:] == shingle[order][:-1]
        several = np.zeros(len(order), bool)
        several[1:] |= same
        several[:-1] |= same
        order = order[several]  # shingles of one document join nothing
        shingle, doc, n, store = shingle[order], doc[order], n[order].astype(np.int64), store[order]
        order = np.lexsort((~store, n, shingle))
        shingle, doc, n, store = shingle[order], doc[order], n[order], store[order]
        at = np.maximum.accumulate(np.where(store, np.arange(len(store)), -1))
        before = np.concatenate([[-1], at[:-1]]) if len(at) else at  # the nearest earlier posting that is stored
        fit = before >= 0
        fit[fit] &= (shingle[before[fit]] == shingle[fit]) & (100 * n[before[fit]] >= PERCENT * n[fit])
        ids, local = np.unique(np.concatenate([doc[fit], doc[before[fit]]]), return_inverse=True)
        root = roots(len(ids), local[: fit.sum()], local[fit.sum() :])
        own = root != np.arange(len(ids))
        k = int(own.sum())
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])


class _Crowd:
    """How many shingles of its prefix each document shares, in a bucket, with any other that is not much larger or smaller."""

    def __init__(self, parts: int) -> None:
        self.parts = parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packs in runs(batches, "bucket"):
            shingle, doc, n = [], [], []
            for s, p, i, z in zip(*[packs[c].to_pylist() for c in ("shingles", "place", "ids", "sizes")], strict=True):
                own = expand(p) >> 1
                shingle.append(np.frombuffer(s, np.uint32))
                doc.append(expand(i)[own])
                n.append(expand(z)[own])
            shingle, doc, n = map(np.concatenate, (shingle, doc, n))
            order = np.lexsort((n, shingle))
            shingle, doc, n = shingle[order], doc[order], n[order]
            near = (shingle[1:] == shingle[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])  # the nearest in size is near enough if any is
            shared = np.append(near, False) | np.append(False, near)
            yield from _dealt(doc[shared], n[shared], self.parts)


def _dealt(doc: np.ndarray, size: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """How often each document occurs, and its least size, packed by hash of the document."""
    order = np.lexsort((size, doc))
    doc, size = doc[order], size[order]
    ids, at, n = np.unique(doc, return_index=True, return_counts=True)
    part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    columns, part = [c[order] for c in (ids, n, size[at])], part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    if len(cuts):
        packed = [[squeeze(c[x:y]) for x, y in zip(cuts, [*cuts[1:], len(part)], strict=True)] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), *[pa.array(c, pa.binary()) for c in packed]], ["part", "ids", "counts", "sizes"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, shared) of each part; of sizes under one id the least counts."""
    for _, table in runs(batches, "part"):
        ids, counts, sizes = (np.concatenate([expand(x.as_py()) for x in table[c]]) for c in ("ids", "counts", "sizes"))
        own, place = np.unique(ids, return_inverse=True)
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, place, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(least), pa.array(np.bincount(place, counts).astype(np.int64))], ["doc_id", "n", "shared"])


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents that share as many shingles of their prefixes as linked ones do."""
    for batch in _add(batches):
        n, shared = batch["n"].to_numpy(), batch["shared"].to_numpy()
        yield batch.select(["doc_id"]).filter(pa.array(shared >= common(_ceil(n, PERCENT, 100))))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text compressed: less than its set of hashes, which nothing compresses."""
    for batch in batches:
        data = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]
        told = [len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in data]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(told, pa.binary())], ["doc_id", "packed"])


def _unpacked(packed: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of packed texts."""
    out: list[np.ndarray] = []
    for a in range(0, len(packed), 100):
        data = [x.as_py() for x in packed.slice(a, 100)]
        texts = [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in data]
        ends = np.cumsum([0, *map(len, texts)])
        column = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(texts))])
        for _, hashes, first in _shingles(pa.RecordBatch.from_arrays([column], ["text"])):
            out += [np.unique(hashes[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
    return out


class _Kept:
    """The rows that the bit map lets through."""

    def __init__(self, found) -> None:
        self.found = found

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = self.found.value
        for batch in batches:
            slot = batch["slot"].to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array((bits[slot // 8] >> (slot % 8).astype(np.uint8)) & 1 == 1))


class _Spread:
    """Shortened shingle hashes of sets, packed by bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, first in _shingles(batch):
                ids = part["doc_id"].to_numpy()
                sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                hashes, place = np.concatenate(sets), np.repeat(np.arange(len(part)), [len(x) for x in sets])
                bucket = ((hashes >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, short, place = bucket[order], hashes[order].astype(np.uint32), place[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                out: list[list] = [[], [], [], []]
                for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    own, n = np.unique(place[a:b], return_counts=True)
                    for col, value in zip(out, (int(bucket[a]), short[a:b].tobytes(), squeeze(ids[own]), squeeze(n)), strict=True):
                        col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["bucket", "shingles", "ids", "counts"])


class _Shared:
    """How many shingles of a bucket each document shares with any other, packed by hash of the document."""

    def __init__(self, parts: int) -> None:
        self.parts = parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "bucket"):
            found = [(np.frombuffer(s, np.uint32), np.repeat(expand(i), expand(n))) for s, i, n in zip(*[table[c].to_pylist() for c in ("shingles", "ids", "counts")], strict=True)]
            shingle, doc = map(np.concatenate, zip(*found, strict=True))
            order = np.argsort(shingle, kind="stable")
            shingle, doc = shingle[order], doc[order]
            several = np.zeros(len(order), bool)
            several[1:] |= shingle[1:] == shingle[:-1]
            several[:-1] |= shingle[1:] == shingle[:-1]
            yield from _dealt(doc[several], np.zeros(int(several.sum()), np.int64), self.parts)


def tile_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of a tile, as pairs of ids.

    With two sides only pairs across count. Sets ascend by size; list positions do too.
    """
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, size))
    ids, side, size, sets = ids[order], side[order], size[order], [sets[i] for i in order]
    count = len(ids)
    both = len(np.unique(side)) > 1
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(count), size)
    frequent = np.bincount(member)[member] > 1
    member, owner = member[frequent], owner[frequent]
    held = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))])
    own = [member[a:b] for a, b in zip(held[:-1], held[1:], strict=True)]
    keys = np.sort(member.astype(np.int64) * count + owner)  # inverted lists, each in order of size
    label = np.arange(count)
    answered: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {}
    low = np.searchsorted(size, _ceil(size, percent, 100), "left")
    high = np.searchsorted(size, size * 100 // percent, "right")
    links = []

    def hits(members: np.ndarray, a: int, b: int) -> np.ndarray:
        """How many of ``members`` each set in positions a to b holds; other positions are skipped."""
        start, stop = np.searchsorted(keys, members * count + a), np.searchsorted(keys, members * count + b)
        n = stop - start
        at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else start
        return np.bincount(keys[at] % count - a, minlength=b - a) if len(at) else np.zeros(b - a, np.int64)

    for j in range(count):
        a, b = int(low[j]), int(high[j])
        if not len(own[j]) or (label[a:b] == label[j]).all():
            continue
        near = answered.get(int(own[j][0]))
        common = None
        if near is not None and near[2] <= a and near[3] >= b:
            more = np.setdiff1d(own[j], near[0], assume_unique=True)
            less = np.setdiff1d(near[0], own[j], assume_unique=True)
            if len(more) + len(less) < len(own[j]) // 2:
                common = near[1][a - near[2] : b - near[2]] + hits(more, a, b) - hits(less, a, b)
        if common is None:
            common = hits(own[j], a, b)
        answered[int(own[j][0])] = (own[j], common, a, b)
        if len(answered) > 256:
            answered.clear()
        linked = a + np.flatnonzero(100 * common >= percent * (size[a:b] + size[j] - common))
        if both:
            linked = linked[side[linked] != side[j]]
        for i in linked:
            if label[i] != label[j]:
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return [(x, y) for x, y in links if x != y]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links: list[tuple[int, int]] = []
    for _, table in runs(batches, "tile"):
        if table.num_rows > 1:
            links += tile_links(table["doc_id"].to_numpy(), _unpacked(table["packed"]), table["side"].to_numpy())
        if len(links) > 10_000:
            yield _links(links)
            links = []
    if links:
        yield _links(links)


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _tiles(members: DataFrame) -> DataFrame:
    """From (doc_id, n, component) of candidate groups to (tile, side, doc_id).

    A small group is one tile. A larger one is cut into blocks by size class, each class a
    factor of 100 / PERCENT wide, and by hash inside a class; two blocks make a tile where
    sizes admit links: of the same class or of neighbouring ones.
    """
    ratio = float(np.log(100 / PERCENT))
    rows = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int"))
    per_class = rows.groupBy("component", "class").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.max("n").alias("most"))
    whole = per_class.groupBy("component").agg(F.sum("docs").alias("all_docs"), F.sum("shingles").alias("all_shingles"))
    small = whole.where((F.col("all_docs") <= BLOCK) & (F.col("all_shingles") <= 2 * BLOCK_SHINGLES) & (F.col("all_docs") > 1)).select("component")
    large = whole.where((F.col("all_docs") > BLOCK) | (F.col("all_shingles") > 2 * BLOCK_SHINGLES)).select("component")
    one = rows.join(small, "component", "left_semi").select(F.xxhash64("component").alias("tile"), F.lit(0).alias("side"), "doc_id")
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    counts = per_class.join(large, "component", "left_semi").select("component", "class", blocks.alias("k"))
    near = counts.alias("c")
    for name, step in (("up", 1), ("down", -1)):
        other = counts.select("component", (F.col("class") - step).alias("class"), F.col("k").alias(name))
        near = near.join(other, ["component", "class"], "left")
    near = near.select("component", "class", "k", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"))
    cut = rows.join(near, ["component", "class"]).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.col("k")))
    seq = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    key = lambda *x: F.xxhash64(F.col("component"), *x)
    same = F.transform(seq("k"), lambda o: F.struct(key(F.col("class"), F.least("h", o), F.lit(0), F.greatest("h", o)).alias("tile"), (F.col("h") > o).cast("int").alias("side")))
    up = F.transform(seq("up"), lambda o: F.struct(key(F.col("class"), F.col("h"), F.lit(1), o).alias("tile"), F.lit(0).alias("side")))
    down = F.transform(seq("down"), lambda o: F.struct(key(F.col("class") - 1, o, F.lit(1), F.col("h")).alias("tile"), F.lit(1).alias("side")))
    many = cut.select("doc_id", F.inline(F.concat(same, up, down))).select("tile", "side", "doc_id")
    return one.unionByName(many)


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach. Words are runs of characters
    other than space and U+0009 to U+000D, A-Z lower-cased; a text of fewer than WIDTH
    words is one shingle. Null and wordless texts have no shingles, link with nothing and
    are their own component; so does a null id, whose component is null. Rows that share
    an id share its component. An empty table gives an empty result; other columns are
    not read. Shingles are compared by 64-bit hashes.

    Texts are read three times: for signatures and counters of shingles, for the prefixes,
    and to keep those of candidates. Equal sets are merged by signature first: from then on
    one document stands for all its copies, however many sets have copies. Sets are made of
    texts where they are needed; what is written and sent are compressed texts, which take
    less than half the bytes of their hashes. A document
    is a candidate if it shares a sixteenth of its size in shingles of its prefix with
    others, each maybe with another one: a linked document shares as many with its partner
    alone. By the same reason a candidate stays only if it shares PERCENT of its shingles
    with other candidates. Those that stay are grouped by counters of their own shingles.
    Groups larger than a block are verified in tiles of two blocks, so no task holds more
    than two blocks whatever the size of a group.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = staged(texts.mapInArrow(Task(_sign), SIGNED), "signed")
    rows = signed.where("kind = 0").select("doc_id", "n", "sig1", "sig2")
    nodes = rows.where("n > 0 AND doc_id IS NOT NULL")
    equal = nodes.groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    equal = staged(equal, "equal")  # a table of its own, so that the join may split a large group
    copies = staged(nodes.join(equal.where("copies > 1").drop("copies"), ["sig1", "sig2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "copies")
    share = spark.sparkContext.broadcast
    named = texts.where("doc_id IS NOT NULL")
    firsts = equal.select(F.col("rep").alias("doc_id")).distinct()  # ids with a row that is no copy
    prefixes_ = _Prefixes(share(frequency_classes(signed.where("kind = 1"))), 4 * tasks, True)
    dealt = _thinned(named, firsts, _Prefixes.SCHEMA, prefixes_).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    near = _summed(dealt.mapInArrow(Task(_Crowd(tasks)), COUNTED), tasks).mapInArrow(Task(_crowded), "doc_id long")
    near = staged(near.join(firsts, "doc_id", "left_semi"), "near")
    close = staged(_thinned(named, near, "doc_id long, text string"), "close", codec="zstd")
    spread = close.mapInArrow(Task(_Spread(4 * tasks)), "bucket int, shingles binary, ids binary, counts binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    shared = _summed(spread.mapInArrow(Task(_Shared(tasks)), COUNTED), tasks).mapInArrow(Task(_add), "doc_id long, n long, shared long").drop("n")
    sizes = nodes.select("doc_id", "n").join(near, "doc_id")
    sharing = staged(sizes.join(shared, "doc_id").where(F.col("shared") * 100 >= F.col("n") * PERCENT).select("doc_id", "n").distinct(), "sharing")
    ids = sharing.select("doc_id").distinct()
    again = _grouped(close, ids, tasks, share(frequency_classes(_thinned(close, ids, "part int, counts binary", _count))))
    groups = connected(again, "groups")
    members = staged(sharing.join(groups, F.col("doc_id") == F.col("node")).select("doc_id", "n", "component"), "members")
    chosen = _thinned(close, members.select("doc_id").distinct(), "doc_id long, packed binary", _packed)
    loaded = _tiles(members).join(chosen, "doc_id").repartition(tasks, "tile").sortWithinPartitions("tile")
    links = loaded.select("tile", "side", "doc_id", "packed").mapInArrow(Task(_verify), "a long, b long")
    found = connected(links.unionByName(copies), "links")
    out = rows.join(found, rows["doc_id"] == found["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _thinned(rows: DataFrame, ids: DataFrame, schema: str, *steps) -> DataFrame:
    """What ``steps`` make of the texts of these ids, and maybe of some others: by a bit map of eight bits an id, or beyond MAPPED ids by a join."""
    count = ids.count()
    if count > MAPPED:
        return rows.select("doc_id", "text").join(ids.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(Task(*steps), schema)
    bits = max(20, (8 * count).bit_length())
    found = rows.sparkSession.sparkContext.broadcast(id_filter(ids, "doc_id", bits))  # 32 MB at most
    return rows.select("doc_id", filter_slot("doc_id", bits).alias("slot"), "text").mapInArrow(Task(_Kept(found), *steps), schema)


def _summed(counts: DataFrame, tasks: int) -> DataFrame:
    return counts.repartition(tasks, "part").sortWithinPartitions("part")


def _grouped(rows: DataFrame, ids: DataFrame, tasks: int, classes) -> DataFrame:
    """The stars of the candidate groups of the sets of these ids."""
    packed = _thinned(rows, ids, _Prefixes.SCHEMA, _Prefixes(classes, 4 * tasks))
    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(Task(_group), "a long, b long")


def oracle(percent: int = PERCENT, width: int = WIDTH) -> str:
    """DuckDB SQL that counts the common shingles of every pair which has one, and walks the links."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
u AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS x FROM s WHERE doc_id IS NOT NULL),
c AS (SELECT any_value(a.doc_id) AS i, any_value(b.doc_id) AS j FROM u a JOIN u b ON a.x = b.x AND a.r < b.r
  GROUP BY a.r, b.r HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT i, j FROM c UNION SELECT j, i FROM c),
reach(i, j) AS (SELECT i, i FROM e UNION SELECT reach.i, e.j FROM reach JOIN e ON reach.j = e.i),
k AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id FROM s LEFT JOIN k ON s.doc_id = k.i
"""
