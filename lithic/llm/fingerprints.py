"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import Task
from lithic.llm.wordhash import slices, text_shingles

#: The share of all hashes that a sketch retains.
FRACTION = 1 / 4
WIDTH = 5


def sketches(texts: pa.Array, fraction: float = FRACTION, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the distinct shingle hashes below ``fraction`` of 2 ** 64, ascending, and the least hash of all.

    The least hash gives short texts a sketch too. Sketches stay mergeable: the union of
    two, without a least hash that is above the threshold and not the least of the union,
    is the sketch of both texts' shingles together.
    """
    hashes, first = text_shingles(texts, width)
    limit = np.uint64(min(int(fraction * 2**64), 2**64 - 1))
    low = hashes < limit
    kept, at = hashes[low], np.concatenate([[0], np.cumsum(low)])[first]
    out = []
    for i in range(len(first) - 1):
        own = np.unique(kept[at[i] : at[i + 1]])
        if not len(own) and first[i] < first[i + 1]:
            own = hashes[first[i] : first[i + 1]].min(keepdims=True)
        out.append(own)
    return out


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both < np.uint64(min(int(fraction * 2**64), 2**64 - 1))]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the other has too; 1 for two empty sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def to_text(sketch: np.ndarray) -> str:
    """16 hexadecimal digits for each hash."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def range_of(value: Column, bounds: list[int]) -> Column:
    """Number of the bounds that are at most ``value``, by binary search; null is -1."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    table = F.array(*[F.lit(b) for b in bounds]) if len(bounds) < 64 else F.lit(bounds)
    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = F.get(table, middle) <= value
        moved = F.struct(F.when(right, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(middle).alias("hi"))
        return F.when(at["lo"] < at["hi"], moved).otherwise(at)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), ends, halve)["lo"]
    return F.when(value.isNull(), -1).otherwise(found)


def compare_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (containment of the smaller sketch in the other).

    The edited text has the last floor(n_chars / 3) code points replaced by the first as
    many of the next document, which is that with the next lower doc_id; after the last
    comes the first. Null texts are empty; null ids come last; rows with equal ids follow
    in the order of their texts; a lone document is its own next; an empty table gives an
    empty result; other columns are not read.

    Ids are cut into ranges at quantiles; only these bounds and each range's highest id
    come to the driver, as many as there are ranges. The first document of a range is also
    sent to the range before it, so one shuffle of the texts gives every document its next
    one. A task reads its rows in order and holds one batch.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * tasks
    cuts = rows.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    bounds = sorted({int(c) for c in cuts})
    part = range_of(F.col("doc_id"), bounds)
    tops = rows.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted(((r["part"], r["top"]) for r in tops), reverse=True)
    before = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}  # of the first range, the last
    guest_in = F.create_map(*[x for k, v in before.items() if k is not None for x in (F.lit(k), F.lit(v))]) if any(k is not None for k in before) else None
    nulls_in = before.get(None)
    home = F.struct(part.cast("int").alias("part"), F.lit(0).alias("guest"))
    also = F.lit(None).cast("int") if guest_in is None else F.when(F.col("doc_id").isin([k for k in before if k is not None]), guest_in[F.col("doc_id")])
    if nulls_in is not None:
        also = F.when(F.col("doc_id").isNull(), F.lit(nulls_in)).otherwise(also)
    places = F.filter(F.array(home, F.struct(also.cast("int").alias("part"), F.lit(1).alias("guest"))), lambda p: p["part"].isNotNull())
    dealt = rows.select("doc_id", "text", F.inline(places)).repartition(tasks, "part")
    ordered = dealt.sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("part", "guest", "doc_id", "text").mapInArrow(Task(_edits), schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting = None  # the row whose next is not known yet: (part, id, text, sketch)
    for batch in batches:
        for piece in slices(batch):
            own = list(zip(piece["part"].to_pylist(), piece["guest"].to_pylist(), piece["doc_id"].to_pylist(), piece["text"].to_pylist(), sketches(piece["text"]), strict=True))
            rows, edited = [], []
            for part, guest, doc, text, sketch in own:
                if waiting is not None and waiting[0] == part:
                    _, was, before, old = waiting
                    third = len(before) // 3
                    rows.append((was, len(before), old, sketch))
                    edited.append(before[: len(before) - third] + text[:third])
                waiting = None if guest else (part, doc, text, sketch)
            if rows:
                new = sketches(pa.array(edited, pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([to_text(r[2]) for r in rows], pa.string()),
                        pa.array(list(map(to_text, new)), pa.string()),
                        pa.array([containment(r[2], n) for r, n in zip(rows, new, strict=True)], pa.float64()),
                        pa.array([containment(r[2], r[3]) for r in rows], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
