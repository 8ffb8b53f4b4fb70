"""SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import Task, runs
from lithic.llm.wordhash import flat, slices

#: Bytes of text in a block of documents; one longer text is a block of its own.
BLOCK = 16 << 20
MARK = "▁"


class ChunkCodec:
    """Encodes and decodes chunks that no piece can cross.

    A chunk is a run of whitespace markers with what follows up to the next marker, split
    again behind each line feed. That no piece of the model crosses such a border is
    checked when the model is loaded: no piece has a marker after another character, or a
    line feed in it. Byte pair merges then never join symbols of two chunks, so the ids of
    a text are those of its chunks in order.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        is_byte = [self.sp.is_byte(i) for i in range(len(pieces))]
        plain = [p for i, p in enumerate(pieces) if not is_byte[i] and not self.sp.is_control(i) and not self.sp.is_unknown(i)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("pieces of this model cross whitespace markers or line feeds")
        if self.sp.normalize("  a  b é Ａ") != f"{MARK * 3}a{MARK * 2}b{MARK}é{MARK}Ａ":
            raise ValueError("the model must keep text as it is and put one marker before it")
        self.end = self.sp.eos_id()
        self.lead = self.sp.encode("\n")
        output = [bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for p, b in zip(pieces, is_byte, strict=True)]
        output[self.sp.unk_id()] = b" \xe2\x81\x87 "
        output[self.end] = b""
        self.pieces = pa.array(output, pa.large_binary())
        self.decimal = pa.array([b"%d " % i for i in range(len(pieces))], pa.large_binary())

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids of each chunk, without the marker that it puts before a text."""
        chunks = [c.replace(" ", MARK) for c in chunks]
        marked = [c.startswith(MARK) and c != MARK for c in chunks]  # of an empty text the library makes nothing
        ids = self.sp.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked, strict=True)], num_threads=1)
        return [x if m else x[len(self.lead) :] for x, m in zip(ids, marked, strict=True)]

    def spoken(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids one behind the other, and where each begins."""
        return _joined(self.pieces, pa.array(ids))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids that a text was encoded to."""
        data, _ = self.spoken(np.array(ids, np.int64))
        return bytes(data)[1:].decode()


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    """One codec per worker process and model."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def chunks(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """(all chunks of the texts, number of chunks of each): texts behind a space each; empty ones have none."""
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    marked = pc.binary_join_element_wise(space, pc.fill_null(texts.cast(pa.large_string()), none), none)
    data, ends = flat(marked)
    data = data[: ends[-1]]
    mark = data == 0x20
    wide = np.flatnonzero(data == 0xE2)
    wide = wide[wide + 2 < len(data)]
    wide = wide[(data[wide + 1] == 0x96) & (data[wide + 2] == 0x81)]  # the marker's own character
    for k in range(3):
        mark[wide + k] = True
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = (mark[1:] & ~mark[:-1]) | (data[:-1] == 0x0A)
    starts[ends] = True
    empty = np.diff(ends) == 1
    at = np.flatnonzero(starts)
    sizes = np.diff(np.searchsorted(at, ends))
    found = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    if empty.any():
        found = found.filter(pa.array(~np.repeat(empty, sizes)))
        sizes = np.where(empty, 0, sizes)
    return found, sizes


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as compressed byte planes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: memoryview) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _both(data: bytes) -> tuple[memoryview, memoryview]:
    n = 8 + int.from_bytes(data[:8], "little")
    return memoryview(data)[8:n], memoryview(data)[n:]


def pack_strings(found: pa.Array) -> bytes:
    data, ends = _bytes(found)
    text = data[ends[0] : ends[-1]]
    return _pair(pack(np.diff(ends)), len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True))


def unpack_strings(data: bytes) -> pa.Array:
    sizes, text = _both(data)
    n = int.from_bytes(text[:8], "little")
    ends = np.concatenate([[0], np.cumsum(unpack(sizes))])
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.decompress(text[8:], n, codec="zstd") if n else pa.py_buffer(b"")])


def _bytes(found: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a binary array, and where its values begin and end in them."""
    found = found.cast(pa.large_binary())
    _, ends, data = found.buffers()
    ends = np.frombuffer(ends, np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    return memoryview(data) if data is not None else memoryview(b""), ends


def _joined(entries: pa.Array, at: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The entries at these places one behind the other, and where each begins and ends."""
    data, ends = _bytes(entries.take(at))
    return data[ends[0] : ends[-1]], ends - ends[0]


def _hash(found: pa.Array) -> np.ndarray:
    import pandas as pd

    return pd.util.hash_array(np.array(found.to_pylist(), object), categorize=False) if len(found) else np.zeros(0, np.uint64)


class _Blocks:
    """Documents in blocks: of each its distinct chunks, by bucket, or the place among them of every chunk of the texts."""

    LISTS = "bucket int, block long, chunks binary"
    HEADS = "block long, ids array<long>, sizes array<int>, places binary, listed long"

    def __init__(self, buckets: int, lists: bool) -> None:
        self.buckets, self.lists = buckets, lists

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = made = 0
        for batch in batches:
            for part in slices(batch, most=BLOCK):
                size = int(np.diff(flat(part["text"])[1]).sum())
                if parts and held + size > BLOCK:
                    yield self._block(parts, made)
                    parts, held, made = [], 0, made + 1
                parts.append(part)
                held += size
        if parts:
            yield self._block(parts, made)

    def _block(self, parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        found, sizes = chunks(pa.concat_arrays(rows["text"].chunks))
        coded = found.dictionary_encode()
        hashes = _hash(coded.dictionary)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)
        order = pc.sort_indices(pa.table({"bucket": bucket, "chunk": coded.dictionary}), sort_keys=[("bucket", "ascending"), ("chunk", "ascending")])
        block = (TaskContext.get().partitionId() << 40) + (number << 24) + int(hashes.sum(dtype=np.uint64) & np.uint64(0xFFFFFF))  # the last part holds only for the same chunks
        if self.lists:
            own, bucket = coded.dictionary.take(order), bucket[order.to_numpy()]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            listed = [pack_strings(own.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([block] * len(cuts), pa.int64()), pa.array(listed, pa.binary())], ["bucket", "block", "chunks"])
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        columns = [[block], [rows["doc_id"].to_pylist()], [sizes.tolist()], [pack(place[coded.indices.to_numpy()])], [len(order)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "ids", "sizes", "places", "listed"])


class _Segment:
    """The table of a bucket's distinct chunks: each is segmented once, and each block gets the ids of its own."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(self.path)
        for bucket, table in runs(batches, "bucket"):
            lists = [unpack_strings(x.as_py()) for x in table["chunks"]]
            coded = pa.concat_arrays(lists).dictionary_encode()
            found = coded.dictionary
            segmented = []
            for a in range(0, len(found), 10_000):
                part = own.segment([c.decode() for c in found.slice(a, 10_000).to_pylist()])
                segmented.append((np.fromiter(map(len, part), np.int64, len(part)), np.fromiter(itertools.chain.from_iterable(part), np.int64)))
            n, ids = (np.concatenate(x) for x in zip(*segmented, strict=True))
            entries = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), pa.array(ids))
            at, edge = coded.indices, 0
            for block, chunks_ in zip(table["block"].to_pylist(), lists, strict=True):
                mine = at.slice(edge, len(chunks_))
                edge += len(chunks_)
                answer = _pair(pack(n[mine.to_numpy()]), pack(entries.take(mine).flatten().to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([answer], pa.binary())], ["block", "bucket", "answer"])


class _Join:
    """From a block's row and the answers to its chunks, in order of buckets, one row per document."""

    def __init__(self, path: str, full: bool) -> None:
        self.path, self.full = path, full

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(self.path)
        last = b"%d" % own.end
        for _, table in runs(batches, "block"):
            docs, sizes = table["ids"][0].as_py(), np.array(table["sizes"][0].as_py(), np.int64)
            at = pa.array(unpack(table["places"][0].as_py()))
            parts = [tuple(map(unpack, _both(x.as_py()))) for x in table["answer"].slice(1)] or [(np.zeros(0, np.int64),) * 2]
            n, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(n) != table["listed"][0].as_py():
                raise RuntimeError("the documents changed between two reads")
            entries = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), pa.array(ids))
            taken = entries.take(at)  # the ids of all texts
            edges = np.concatenate([[0], np.cumsum(n[at.to_numpy()])])[np.concatenate([[0], np.cumsum(sizes)])]
            taken = taken.flatten()
            written, begin = _joined(own.decimal, taken)
            spoken, start = _joined(own.pieces, taken)
            written = [written[a:b] for a, b in itertools.pairwise(begin[edges].tolist())]
            spoken = [spoken[min(a + 1, b) : b] for a, b in itertools.pairwise(start[edges].tolist())]  # without the space before the text
            out = [docs, np.diff(edges) + 1, [hashlib.sha256(bytes(w) + last).hexdigest() for w in written], [hashlib.sha256(s).hexdigest() for s in spoken]]
            if self.full:
                ids = taken.to_numpy()
                out += [[[*ids[a:b].tolist(), own.end] for a, b in itertools.pairwise(edges.tolist())], [bytes(s).decode() for s in spoken]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=False)], _NAMES[: len(out)])


_NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]


def encode(docs: DataFrame, path: str, full: bool = True) -> DataFrame:
    """Encodes each text with an end id and decodes the ids: doc_id, n_tokens and digests.

    With ``full`` also ids (array of int) and decoded (string). The ids are those of the
    sentencepiece library for the whole text. Null counts as the empty text, whose only id
    is the end id; repeated rows give repeated rows; an empty table an empty result; other
    columns are not read.

    Documents are taken in blocks of about BLOCK bytes. The distinct chunks of all blocks
    meet in a table, dealt to buckets by hash, that segments each chunk once; the ids go
    back to the blocks and are joined by position there, and decoded. A block lists a chunk
    once however often it occurs, so a very frequent word is no hot group, and lists and
    places travel compressed. A task holds a block or a bucket; buckets are as many as four
    times the shuffle partitions. ``docs`` is read twice and must give the same rows in the
    same order, as files do; a block that differs between both stops the job.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = rows.mapInArrow(Task(_Blocks(4 * tasks, True)), _Blocks.LISTS).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    answers = listed.mapInArrow(Task(_Segment(path)), "block long, bucket int, answer binary")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = rows.mapInArrow(Task(_Blocks(4 * tasks, False)), _Blocks.HEADS)
    heads = heads.select("block", F.lit(0).alias("kind"), null("int", "bucket"), "ids", "sizes", "places", "listed", null("binary", "answer"))
    answers = answers.select("block", F.lit(1).alias("kind"), "bucket", null("array<long>", "ids"), null("array<int>", "sizes"), null("binary", "places"), null("long", "listed"), "answer")
    dealt = heads.unionByName(answers).repartition(tasks, "block").sortWithinPartitions("block", "kind", "bucket")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return dealt.mapInArrow(Task(_Join(path, full)), out)
