"""Line dedup by a log-template tree.

A line is parsed to a fixed depth: by its number of words, then by its LEAD leading words;
such a leaf groups its lines by the words that are equal in the same place. Words with a
digit are variable fields: they equal each other. Lines of at least LONG words belong
together if at most a third of the words behind the leading ones differ (rounded up), in any
places, directly or by way of other lines. Shorter lines of at least MASKED words belong to
one template for each place behind the leading words, in which that word is variable; and
neighbouring shorter lines of together LONG words, as few as it takes, are one unit. Lines
and units recur if enough documents have them; they are dropped from all of them but the
first, by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import Task, staged
from lithic.llm.wordhash import _powers, flat, mix, slices, words

LEAD, SEGMENTS, LONG, MASKED = 2, 3, 8, 5
#: Documents that make a template recur: for lines and units of at least LONG words, and for shorter lines.
DOCUMENTS, DOCUMENTS_SHORT = 2, 8

#: Lowest two bits of a key: what it stands for.
_UNIT, _SHORT, _WHOLE = 1, 2, 3
#: Bits of the map of leaves, lines that are grouped at once, lines whose pairs are all tried.
_LEAF_BITS, _CHUNK, _PAIRED = 25, 50_000, 16

_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SALT = 0x632BE59BD9B4E019


@dataclass(frozen=True)
class _Lines:
    """Lines with words: number, first word, words, hash; of each word its hash and its part of the line's hash."""

    first: np.ndarray  # first line of each text, and their number
    own: np.ndarray
    begin: np.ndarray
    n: np.ndarray
    whole: np.ndarray
    hashes: np.ndarray
    value: np.ndarray

    def long(self) -> np.ndarray:
        return self.n >= LONG

    def text(self, line: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, line, "right") - 1

    def leaf(self, on: np.ndarray) -> np.ndarray:
        """Hashes of the leaves of the lines ``on``, of at least LEAD words."""
        lead = self.n[on].astype(np.uint64) * np.uint64(_SALT)
        for k in range(LEAD):
            lead = lead + self.value[self.begin[on] + k]
        return mix(lead)


def _parse(texts: pa.Array) -> _Lines:
    data, ends = flat(texts)
    hashes, start, stop, _ = words(data, ends)
    text = np.searchsorted(ends, start, "right") - 1
    breaks = np.flatnonzero(data[ends[0] : ends[-1]] == 0x0A) + ends[0] if len(texts) else np.zeros(0, np.int64)
    first = np.searchsorted(breaks, ends) + np.arange(len(ends))
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return _Lines(first, none, none, none, none.astype(np.uint64), hashes, hashes)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data[ends[0] : ends[-1]]])])
    hashes = np.where(digits[stop - ends[0]] > digits[start - ends[0]], np.uint64(0x2545F4914F6CDD1D), hashes)
    line = np.searchsorted(breaks, start) + text
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    n = np.diff(np.append(begin, len(line)))
    at = np.arange(len(line)) - np.repeat(begin, n)
    value = mix(hashes + at.astype(np.uint64) * np.uint64(_SALT))
    return _Lines(first, line[begin], begin, n, np.add.reduceat(value, begin) + n.astype(np.uint64), hashes, value)


def _mark(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix(x) & ~np.uint64(3)) | np.uint64(kind)


def line_keys(lines: _Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, key): template hashes and the lines that each stands for, in order of lines."""
    long = lines.long()
    found = [(lines.own[long], lines.own[long], _mark(lines.whole[long], _WHOLE)), (lines.own[~long], lines.own[~long], _mark(lines.whole[~long], _SHORT))]
    for k in range(LEAD, LONG - 1):
        on = ~long & (lines.n >= MASKED) & (lines.n > k)
        found.append((lines.own[on], lines.own[on], _mark(lines.whole[on] - lines.value[lines.begin[on] + k] + np.uint64((k + 1) * _SALT % 2**64), _SHORT)))
    found += _units(lines)
    start, stop, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(start, kind="stable")
    return start[order], stop[order], keys[order]


def _units(lines: _Lines) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, key) of the least runs of short lines with LONG words that begin or end at each; lines without words do not count.

    Any passage of short lines with LONG words is covered by such runs inside it.
    """
    count = len(lines.own)
    if not count:
        return []
    short = ~lines.long()
    run = np.cumsum(~short | (np.diff(lines.text(lines.own), prepend=-1) != 0))
    run = np.where(short, 2 * run, -np.arange(1, count + 1))  # a long line is in no run
    total = np.cumsum(lines.n)
    at = np.arange(count)
    to = np.searchsorted(total, total - lines.n + LONG)
    since = np.searchsorted(total - lines.n, total - LONG, "right") - 1
    forward, back = short & (to < count) & (run[np.minimum(to, count - 1)] == run), short & (since >= 0) & (run[np.maximum(since, 0)] == run)
    a, b = np.concatenate([at[forward], since[back]]), np.concatenate([to[forward], at[back]])
    both = np.unique(a * count + b)
    a, b = both // count, both % count
    own, powers, unit = mix(lines.whole), _powers(0xD1342543DE82EF95, LONG), (b - a).astype(np.uint64)
    for k in range(LONG):
        on = a + k <= b
        unit[on] += own[a[on] + k] * powers[k]
    return [(lines.own[a], lines.own[b], _mark(unit, _UNIT))]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct template hashes, with the leaf of a long line."""
    for batch in batches:
        for part in slices(batch):
            lines = _parse(part["text"])
            ids = part["doc_id"].to_numpy(zero_copy_only=False)
            start, _, keys = line_keys(lines)
            leaf = np.zeros(len(keys), np.uint64)
            leaf[(keys & np.uint64(3)) == _WHOLE] = lines.leaf(np.flatnonzero(lines.long()))
            doc = ids[lines.text(start)]
            order = np.lexsort((keys, doc))
            doc, keys, leaf = doc[order], keys[order], leaf[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(doc[new].astype(np.int64)), pa.array(keys[new].view(np.int64)), pa.array(leaf[new].view(np.int64))], ["doc_id", "key", "leaf"])


def _shared_leaves(keys: DataFrame) -> np.ndarray:
    """A bit map of leaves that lines of two documents share: 2 ** _LEAF_BITS bits; it may let others pass."""
    leaves = keys.where(F.col("key").bitwiseAND(F.lit(3).cast("long")) == _WHOLE).groupBy("leaf").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    slot = F.shiftrightunsigned("leaf", 64 - _LEAF_BITS) + 1
    hit = leaves.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    out = np.zeros((1 << _LEAF_BITS) // 8, np.uint8)
    for row in hit.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():  # at most 2 ** _LEAF_BITS / 32768 rows
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        at = (row["bucket"] - 1) * 4096
        out[at : at + len(part)] |= part
    return out


class _Gather:
    """The long lines of shared leaves, once per slice: leaf, key, least and greatest document, 4 bytes of each word's hash."""

    SCHEMA = "leaf long, key long, first long, last long, places binary"

    def __init__(self, leaves) -> None:
        self.leaves = leaves

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = self.leaves.value
        for batch in batches:
            for part in slices(batch):
                lines = _parse(part["text"])
                on = np.flatnonzero(lines.long())
                leaf = lines.leaf(on)
                slot = leaf >> np.uint64(64 - _LEAF_BITS)
                kept = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                on, leaf = on[kept], leaf[kept]
                if not len(on):
                    continue
                key, doc = _mark(lines.whole[on], _WHOLE), part["doc_id"].to_numpy(zero_copy_only=False)[lines.text(lines.own[on])].astype(np.int64)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                line = on[order[at]]
                word, _ = _spread(lines.begin[line], lines.n[line])
                ends = np.concatenate([[0], np.cumsum(4 * lines.n[line])]).astype(np.int32)
                places = pa.Array.from_buffers(pa.binary(), len(line), [None, pa.py_buffer(ends), pa.py_buffer((lines.hashes[word] >> np.uint64(32)).astype(np.uint32))])
                columns = [leaf[order[at]].view(np.int64), key[at].view(np.int64), doc[at], doc[np.append(at[1:], len(doc)) - 1]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), places], ["leaf", "key", "first", "last", "places"])


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of n places from ``start``: all places, and their places in the runs."""
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(start, n) + at, at


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lines in order of leaves the keys of recurring lines and the first document of their group."""
    parts: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        parts.append(batch)
        rows += batch.num_rows
        if rows >= _CHUNK:
            table = pa.Table.from_batches(parts).combine_chunks()
            leaf = table["leaf"].to_numpy()
            cut = int(np.searchsorted(leaf, leaf[-1]))
            if cut:
                yield _recurring(table.slice(0, cut))
            parts, rows = table.slice(cut).to_batches(), 0  # the last leaf may go on
    if parts:
        yield _recurring(pa.Table.from_batches(parts))


def _recurring(table: pa.Table) -> pa.RecordBatch:
    leaf, key, first, last = (table[c].to_numpy() for c in ("leaf", "key", "first", "last"))
    order = np.lexsort((key, leaf))
    at = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else order
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["key", "first"])
    first, last = np.minimum.reduceat(first[order], at), np.maximum.reduceat(last[order], at)
    leaf, key = leaf[order[at]], key[order[at]]
    label = np.arange(len(key))
    same = leaf[1:] == leaf[:-1]
    many = np.flatnonzero(np.append(same, False) | np.append(False, same))  # lines that are not alone in their leaf
    if len(many):
        places = table["places"].combine_chunks().take(pa.array(order[at][many]))
        places = places.combine_chunks() if isinstance(places, pa.ChunkedArray) else places
        _, ends, data = places.buffers()
        ends = np.frombuffer(ends, np.int32)[places.offset : places.offset + len(places) + 1].astype(np.int64) // 4
        group = groups(leaf[many].view(np.uint64), np.frombuffer(data, np.uint32), ends)
        label[many] = many[group]
    least, most = first.copy(), last.copy()
    np.minimum.at(least, label, first)
    np.maximum.at(most, label, last)
    recurs = least[label] < most[label]
    return pa.RecordBatch.from_arrays([pa.array(key[recurs]), pa.array(least[label][recurs])], ["key", "first"])


def groups(leaf: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each line the least line of its group: lines of a leaf are linked if few enough places differ.

    Lines that differ in d places at most are equal in one of any d + 1 stretches, so only lines
    that share a stretch are compared. A large set of such lines is searched from line to line.
    """
    n = np.diff(ends)
    most = -((LEAD - n) // SEGMENTS)
    word, at = _spread(ends[:-1], n)
    line = np.repeat(np.arange(len(n)), n)
    stretch = np.where(at < LEAD, -1, (at - LEAD) * (most + 1)[line] // (n - LEAD)[line])
    begin = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(stretch, prepend=-2) != 0))
    value = np.add.reduceat(mix(places[word].astype(np.uint64) + at.astype(np.uint64) * np.uint64(_SALT)), begin)
    begin, value = begin[stretch[begin] >= 0], value[stretch[begin] >= 0]
    key = mix(value + leaf[line[begin]] + (stretch[begin] + 1).astype(np.uint64) * np.uint64(_SALT))
    order = np.argsort(key, kind="stable")
    key, owner = key[order], line[begin][order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    own = np.repeat(size, size)
    pairs = []
    for gap in range(1, _PAIRED):
        i = np.flatnonzero((key[gap:] == key[:-gap]) & (own[gap:] <= _PAIRED))
        if not len(i):
            break
        pairs.append(np.unique(np.minimum(owner[i], owner[i + gap]) * len(n) + np.maximum(owner[i], owner[i + gap])))
    pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    a, b = pair // len(n), pair % len(n)
    near = [np.zeros((2, 0), np.int64)]
    step = np.cumsum(n[a]) // 1_000_000
    for cut in np.split(np.arange(len(a)), np.flatnonzero(np.diff(step)) + 1):
        if len(cut):
            x, y = a[cut], b[cut]
            i, k = _spread(ends[x], n[x])
            unequal = np.add.reduceat((places[i] != places[np.repeat(ends[y], n[x]) + k]).astype(np.int64), np.cumsum(n[x]) - n[x])
            near.append(np.stack([x, y])[:, unequal <= most[x]])
    for s, k in zip(start[size > _PAIRED], size[size > _PAIRED], strict=True):
        members = owner[s : s + k]
        near.append(_search(members, places[ends[members][:, None] + np.arange(n[members[0]])], int(most[members[0]])))
    a, b = np.concatenate(near, axis=1)
    label = np.arange(len(n))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _search(members: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Links that connect what differs in ``most`` places at most; a found line is not sought again."""
    left, links = np.arange(len(members)), [np.zeros((2, 0), np.int64)]
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = (places[left] != places[at]).sum(1) <= most
            links.append(np.stack([np.full(int(hit.sum()), members[at]), members[left[hit]]]))
            front.extend(left[hit])
            left = left[~hit]
    return np.concatenate(links, axis=1)


class _Drop:
    """Takes the marked lines out of a text."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines_of = _parse(part["text"].filter(pa.array(np.asarray(part["_marked"].is_valid()))))
                start, stop, keys = line_keys(lines_of)
                first, edges = lines_of.first, np.searchsorted(start, lines_of.first)
                worded = np.zeros(int(first[-1]), bool)
                worded[lines_of.own] = True
                texts, lines, gone = part["text"].to_pylist(), [], []
                at = 0
                for i, (text, marked) in enumerate(zip(texts, part["_marked"], strict=True)):
                    split = [] if text is None else text.split("\n")
                    lines.append(len(split))
                    dropped: list[int] = []
                    if marked.is_valid:
                        hit = np.zeros(int(first[at + 1] - first[at]), bool)
                        found = edges[at] + np.flatnonzero(np.isin(keys[edges[at] : edges[at + 1]].view(np.int64), np.asarray(marked.values)))
                        for a, b in zip(start[found] - first[at], stop[found] - first[at], strict=True):
                            hit[a : b + 1] = True
                        hit &= worded[first[at] : first[at + 1]]
                        at += 1
                        dropped = np.flatnonzero(hit).tolist()
                        if dropped and text is not None:
                            texts[i] = "\n".join(x for x, h in zip(split, hit, strict=True) if not h)
                    gone.append(dropped)
                cols = [pa.array(texts, pa.string()) if n == "text" else part.column(part.schema.get_field_index(n)) for n in self.names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], [*self.names, "_lines", "_dropped"])


def drop_recurring(docs: DataFrame) -> DataFrame:
    """The documents with recurring lines taken out of ``text``, and columns _lines and _dropped.

    _lines is the number of lines, _dropped the places (from 0) of those taken out. Lines
    end at line feeds; those without words stay. Null text stays null with no lines; a text
    may become empty. The first document of a template, by doc_id, keeps its line; a line
    that repeats only within a document stays. Rows with equal ids count as one document;
    rows with a null id are returned as they are. An empty table gives an empty result;
    other columns pass through. Templates are told apart by 62-bit hashes, the places of two
    lines by 32-bit ones.

    Texts are read three times: for the hashes, for the long lines of leaves that two documents
    share, and to drop lines. Counting short lines is a grouped aggregation with partial sums
    before its shuffle. A leaf goes to one task, with each distinct line once per slice of
    input. A line of very many documents makes one hot key in the join back, which adaptive
    execution splits.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = staged(rows.mapInArrow(Task(_emit), "doc_id long, key long, leaf long"), "lines")
    kind = F.col("key").bitwiseAND(F.lit(3).cast("long"))
    repeated = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()  # else a document gives each key once
    counted = keys.where(kind != _WHOLE)
    counted = counted.dropDuplicates(["doc_id", "key"]) if repeated else counted
    recurring = counted.groupBy("key").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    recurring = recurring.where((F.col("documents") >= F.when(kind == _UNIT, DOCUMENTS).otherwise(DOCUMENTS_SHORT)) & (F.col("first") < F.col("last"))).select("key", "first")
    leaves = docs.sparkSession.sparkContext.broadcast(_shared_leaves(keys))  # 2 ** _LEAF_BITS bits
    gathered = rows.mapInArrow(Task(_Gather(leaves)), _Gather.SCHEMA).repartition("leaf").sortWithinPartitions("leaf")
    recurring = recurring.unionByName(gathered.mapInArrow(Task(_leaves), "key long, first long"))
    marked = keys.join(recurring, "key").where("doc_id <> first").select("doc_id", "key")
    marked = marked.groupBy("doc_id").agg(F.collect_set("key").alias("_marked"))  # a document's own lines
    fields = [f for f in docs.schema.fields if f.name not in ("_lines", "_dropped", "_marked")]
    names = [f.name for f in fields]
    joined = docs.select(*names).join(marked.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    out = T.StructType([*[T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in fields], T.StructField("_lines", T.LongType()), T.StructField("_dropped", T.ArrayType(T.IntegerType()))])
    return joined.mapInArrow(Task(_Drop(names)), out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (places of lines), text (what stays)."""
    done = drop_recurring(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("_lines").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), F.col("_dropped").alias("dropped"), "text")
