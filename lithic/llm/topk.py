"""Exact top-k search by tiled products of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm.common import Task

#: Bytes of the vectors of a block of queries; candidates in a tile; PART queries are multiplied at once.
BLOCK_BYTES, TILE = 64 << 20, 4096
PART = 512
#: Candidates of a shard, and lists that are merged at once.
SHARD, FAN = 1 << 17, 16
LISTS = "shard long, query_id long, turn long, vec_id long, score long, own boolean"


def matrix(values: pa.Array) -> np.ndarray:
    """Rows of a list array as one float64 matrix; shorter rows end in zeros."""
    ends = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(lengths), width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def scores(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Integer inner products as int64, exact: in float64 where no partial sum can pass 2 ** 53."""
    width = min(queries.shape[1], tile.shape[1])
    queries, tile = queries[:, :width], tile[:, :width]
    if not width:
        return np.zeros((len(queries), len(tile)), np.int64)
    most = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * width
    if most < 2**53:
        return (queries @ tile.T).astype(np.int64)
    return np.rint(queries).astype(np.int64) @ np.rint(tile).astype(np.int64).T


class Best:
    """The k best candidates of each query so far: higher score first, then smaller id."""

    def __init__(self, ids: np.ndarray, k: int, turns: np.ndarray | None = None, selves: np.ndarray | None = None) -> None:
        """With ``selves``, each query's product with itself, rows that share its id are candidates, too."""
        self.ids, self.k, self.turns, self.selves = ids, k, turns, selves
        self.score = np.zeros((len(ids), 0), np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.real = np.zeros((len(ids), 0), bool)

    def add(self, ids: np.ndarray, score: np.ndarray, rows: slice) -> tuple[np.ndarray, ...]:
        """The lists of the queries ``rows`` after a tile whose ids ascend: partial selection, then a merge."""
        own = ids[None, :] == self.ids[rows, None] if self.selves is None else np.zeros(score.shape, bool)
        kept = np.broadcast_to(np.arange(len(ids)), score.shape)
        if len(ids) > self.k + 1:
            if np.abs(score).max(initial=0) < 2**62 // len(ids):  # one number orders by score, then by place
                rank = score * len(ids) - kept
                rank[own] = np.iinfo(np.int64).min
                kept = np.argpartition(rank, len(ids) - self.k, axis=1)[:, -self.k :]
        take = lambda x: np.take_along_axis(np.broadcast_to(x, score.shape), kept, 1)
        s = np.concatenate([self.score[rows], take(score)], 1)
        f = np.concatenate([self.found[rows], take(ids[None, :])], 1)
        real = np.concatenate([self.real[rows], ~take(own)], 1)
        for by, kind in ((f, False), (s, True), (real, True)):  # the last sort counts most
            order = np.argsort(~by if kind else by, axis=1, kind="stable")
            s, f, real = (np.take_along_axis(x, order, 1) for x in (s, f, real))
        return s[:, : self.k], f[:, : self.k], real[:, : self.k]

    def rows(self, shard: int) -> pa.RecordBatch:
        held = self.real.sum(1)
        q, found, score = np.repeat(self.ids, held), self.found[self.real], self.score[self.real]
        turn = np.repeat(np.zeros(len(held), np.int64) if self.turns is None else self.turns, held)
        own = np.zeros(len(q), bool) if self.selves is None else (found == q) & (score == np.repeat(self.selves, held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), shard, np.int64)), pa.array(q), pa.array(turn), pa.array(found), pa.array(score), pa.array(own)], [c.split()[0] for c in LISTS.split(", ")])


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shards: int | None = None, each_row: bool = False) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by
    ``every``; all rows but those with the query's own id are candidates. Ties go to the
    smaller vec_id. Null vectors, and those with null or non-finite components, take no
    part, nor do rows without an id; shorter vectors count as ending in zeros; repeated
    candidates with one id are one row each; an empty table gives an empty result; other
    columns are ignored. Scores must fit 64 bits.

    Of query vectors that share an id the least is asked. With ``each_row`` every row is a
    query of its own and all other rows are its candidates, those with its id among them:
    k + 1 rows are kept of each list, and of those with the query's id and its product with
    itself, which are alike, one is the query.

    Query blocks and candidate shards meet in tiles: a block is sent once to each shard
    and a candidate once to each block (key: shard, block). A tile takes its candidates in
    batches and keeps k rows per query, its list. Lists are merged in a tree, FAN lists of a
    query at a time, so no task gets all lists of a query at once. Blocks follow from the
    bytes of the queries and shards from the number of candidates, at least one for each
    shuffle partition. Hash shards of rows cannot be skewed by one common vector.
    """
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.forall(F.col("embedding"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))
    queries = rows.where(F.col("id") % every == 0)
    own = F.col("vec_id").cast("long") % every == 0
    counted = vectors.agg(F.count("*").alias("rows"), F.sum(F.when(own, F.lit(1).cast("long"))).alias("asked"), F.max(F.size("embedding")).alias("width")).first()
    blocks = max(1, -(-8 * (counted["asked"] or 0) * max(counted["width"] or 1, 1) // BLOCK_BYTES))
    shards = shards or max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted["rows"] // SHARD))
    if each_row:
        alike = queries.groupBy("id", "v").agg(F.count("*").alias("copies"))
        alike = alike.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("v")).cast("long"))
        several = alike.where("copies > 1").select(F.col("id").alias("query_id"), "turn", "copies")
    else:
        alike = queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("turn", F.lit(0).cast("long"))
    asked = alike.select(F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "turn", "v")
    given = rows.select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), "id", F.lit(0).cast("long").alias("turn"), "v")
    tiles = asked.unionByName(given).repartition(F.col("block"), F.col("shard")).sortWithinPartitions("block", "shard", "side", "id")
    held = k + each_row
    lists = tiles.select("side", "block", "shard", "id", "turn", "v").mapInArrow(Task(_Tiles(held, each_row)), LISTS)
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = _best(lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("long")), ["query_id", "turn", "shard"], held).drop("rank")
    best = _best(lists, ["query_id", "turn"], held)
    if each_row:
        first = F.row_number().over(Window.partitionBy("query_id", "turn", "own").orderBy("rank"))
        best = _best(best.withColumn("first", first).where("NOT own OR first > 1").drop("rank", "first"), ["query_id", "turn"], k)
        best = best.join(several, ["query_id", "turn"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return best.select("query_id", "rank", "vec_id", "score")


def _best(lists: DataFrame, of: list[str], k: int) -> DataFrame:
    """The k best rows of each list."""
    order = Window.partitionBy(*of).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Tiles:
    """Runs over sorted rows: the queries of a tile first, then its candidates in batches."""

    def __init__(self, k: int, each_row: bool = False) -> None:
        self.k, self.each_row = k, each_row

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, turns, vectors, best = None, [], [], [], None
        for batch in batches:
            key = (batch["block"].to_numpy().astype(np.int64) << 32) + batch["shard"].to_numpy().astype(np.int64) * 2 + batch["side"].to_numpy()
            cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else []
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                tile, side = key[a] // 2, key[a] % 2
                if tile != at:
                    yield from self._out(best, at)
                    at, queries, turns, vectors, best = tile, [], [], [], None
                for c in range(a, b, TILE):
                    part = batch.slice(c, min(TILE, b - c))
                    ids, values = part["id"].to_numpy(), matrix(part["v"])
                    if side == 0:
                        queries.append(ids)
                        turns.append(part["turn"].to_numpy())
                        vectors.append(values)
                    elif queries:
                        if best is None:
                            width = max(v.shape[1] for v in vectors)
                            vectors = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors]
                            asked = np.concatenate(vectors)
                            selves = np.concatenate([scores(v[None], v[None])[0] for v in asked]) if self.each_row else None
                            best = Best(np.concatenate(queries), self.k, np.concatenate(turns), selves)
                        parts = [best.add(ids, scores(asked[i : i + PART], values), slice(i, i + PART)) for i in range(0, len(asked), PART)]
                        best.score, best.found, best.real = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield from self._out(best, at)

    def _out(self, best: Best | None, tile: int | None) -> Iterator[pa.RecordBatch]:
        if best is not None and best.real.any():
            yield best.rows(int(tile) % (1 << 31))


def oracle(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """DuckDB SQL that scores every pair."""
    return f"""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % {every} = 0 AND q.id <> c.id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
