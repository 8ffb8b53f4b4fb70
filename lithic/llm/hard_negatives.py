"""Hard negatives: rows of other labels that score just below an anchor's nearest rows of its own label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm.common import Task, staged
from lithic.llm.topk import BLOCK_BYTES, FAN, matrix, scores

#: Candidates of a shard, whose scores for an anchor are sorted as a whole; PART anchors are multiplied at once.
SHARD, PART = 1 << 15, 64


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    Components become floor(scale * x), scores are integer inner products. Anchors are the
    rows whose vec_id is divisible by ``every``; an anchor's positives are its best other
    rows of the same label; the negatives of a positive are the best rows of other labels
    whose score is between ``low`` and ``high`` percent of the positive's. Higher scores come
    first, ties go to the smaller vec_id; ``rank`` counts from 1.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no
    part. Every other row is a candidate, also one that shares the anchor's id: rows are told
    apart by a number, so of equal anchors each gets its results. Shorter vectors count as
    ending in zeros. A positive with a score below zero has no negatives, as the limits cross.
    No rows, no anchors or a single label give no results. Other columns are ignored. Scores
    must fit 64 bits.

    Blocks of anchors meet shards of candidates in tiles. In a tile all scores of an anchor
    are sorted, by score and id; the rows of its own label are read from the top, and for
    each positive the first score below its upper limit is found by binary search. A tile
    gives as many rows of an anchor (or of a positive) as the whole may; these lists, runs
    of the anchor's full order, are merged in a tree. Positives must be known before their
    limits are, so tiles are multiplied twice; scores are never shuffled.
    """
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.forall(F.col("embedding"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    real = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound
    rows = vectors.where(real).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), whole.alias("v"))
    rows = staged(rows, "vectors")  # the numbers must not change
    anchors = rows.where(F.col("id") % every == 0)
    counted = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("asked"), F.max(F.size("v")).alias("width")).first()
    blocks = max(1, -(-8 * counted["asked"] * max(counted["width"] or 1, 1) // BLOCK_BYTES))
    shards = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted["rows"] // SHARD))

    def tiled(asked: DataFrame) -> DataFrame:
        """Both sides of each tile: a block of anchors once for each shard, a shard once for each block."""
        asked = asked.withColumn("side", F.lit(0)).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        given = rows.withColumn("side", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("shard", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)).cast("int"))
        both = asked.unionByName(given, allowMissingColumns=True).repartition(F.col("block"), F.col("shard"))
        return both.sortWithinPartitions("block", "shard", "side", "id", "row").select("block", "shard", "side", "row", "id", "label", "v", "limits")

    def merged(lists: DataFrame, of: list[str], k: int) -> DataFrame:
        """The k first rows of the lists of all shards, FAN lists at a time."""
        n = shards
        while n > FAN:
            n = -(-n // FAN)
            lists = _first(lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("long")), [*of, "shard"], k).drop("rank")
        return _first(lists, of, k)

    near = tiled(anchors.withColumn("limits", F.lit(None).cast("array<bigint>"))).mapInArrow(Task(_Tiles(_Positives(positives))), "shard long, anchor long, of long, id long, score long")
    near = staged(merged(near, ["anchor"], positives), "positives")
    limits = near.groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("limits"))  # as many as there are positives of an anchor
    asked = anchors.join(limits, F.col("row") == F.col("anchor")).drop("anchor")
    far = tiled(asked).mapInArrow(Task(_Tiles(_Negatives(negatives, low, high))), "shard long, anchor long, of long, id long, score long")
    far = merged(far, ["anchor", "of"], negatives).withColumnsRenamed({"of": "positive_score", "id": "negative_id", "score": "negative_score"})
    pairs = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(far, ["anchor", "positive_score"])
    named = pairs.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _first(lists: DataFrame, of: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.col("score").desc(), "id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Positives:
    """The first rows of the anchor's label."""

    def __init__(self, k: int) -> None:
        self.k = k

    def __call__(self, score: np.ndarray, ids: np.ndarray, same: np.ndarray, _: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        s, i = score[same], ids[same]
        order = np.lexsort((i, -s))[: self.k]
        yield 0, i[order], s[order]


class _Negatives:
    """For each score of a positive, the first rows of other labels between its limits."""

    def __init__(self, k: int, low: int, high: int) -> None:
        self.k, self.low, self.high = k, low, high

    def __call__(self, score: np.ndarray, ids: np.ndarray, same: np.ndarray, limits: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        s, i = score[~same], ids[~same]
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        for at in limits:
            most, least = self.high * at // 100, -(-self.low * at // 100)
            begin = np.searchsorted(-s, -most, "left")
            end = min(begin + self.k, np.searchsorted(-s, -least, "right"))
            if end > begin:
                yield at, i[begin:end], s[begin:end]


class _Tiles:
    """Runs over sorted rows: the anchors of a tile first, then its candidates."""

    def __init__(self, read: _Positives | _Negatives) -> None:
        self.read = read

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = (batch["block"].to_numpy().astype(np.int64) << 32) + batch["shard"].to_numpy()
            side = batch["side"].to_numpy()
            cuts = np.flatnonzero((np.diff(tile, prepend=tile[0] - 1) != 0) | (np.diff(side, prepend=side[0]) != 0))
            for a, b in zip(cuts, [*cuts[1:], len(tile)], strict=True):
                if tile[a] != at:
                    yield from self._tile(at, *held)
                    at, held = tile[a], ([], [])
                held[side[a]].append(batch.slice(a, b - a))
        yield from self._tile(at, *held)

    def _tile(self, at: int | None, asked: list[pa.RecordBatch], given: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates come in shards of bounded size; the numbers of a shard's rows are far from their order, so one large label spreads."""
        if not asked or not given:
            return
        table = pa.Table.from_batches(given)
        rows, ids = table["row"].to_numpy(), table["id"].to_numpy()
        labels, vectors = table["label"].combine_chunks(), matrix(table["v"].combine_chunks())
        codes = labels.dictionary_encode()
        names = {name: i for i, name in enumerate(codes.dictionary.to_pylist())}
        codes = codes.indices.to_numpy()
        for batch in asked:
            own, label, limits = batch["row"].to_numpy(), batch["label"].to_pylist(), batch["limits"].to_pylist()
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for first in range(0, len(own), PART):
                block = scores(matrix(batch["v"].slice(first, PART)), vectors)
                for k, line in enumerate(block, first):
                    other = rows != own[k]
                    same = codes == names.get(label[k], -1)
                    for of, found, score in self.read(line[other], ids[other], same[other], limits[k] or []):
                        if len(found):
                            out.append((own[k], of, found, score))
            if out:
                sizes = [len(x[2]) for x in out]
                repeated = lambda c: pa.array(np.repeat(np.array([x[c] for x in out], np.int64), sizes))  # noqa: B023, E731
                shard = pa.array(np.full(sum(sizes), int(at) % (1 << 32), np.int64))
                yield pa.RecordBatch.from_arrays([shard, repeated(0), repeated(1), pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out]))], ["shard", "anchor", "of", "id", "score"])


def relabelled(every: int = 7, labels: int = 10) -> Column:
    """Labels of which every seventh row's is moved to the next."""
    return F.when(F.col("vec_id") % every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))


def oracle() -> str:
    """DuckDB SQL that scores every pair of an anchor and a row."""
    return """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.id AS anchor_id, c.id AS id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v c ON a.id % 100 = 0 AND a.r <> c.r),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS n FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND p.n <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
