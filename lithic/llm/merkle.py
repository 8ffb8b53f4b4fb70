"""Merkle manifest of a dataset: a tree of hashes per language, one over their roots, a proof for each row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm.common import Task, runs, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that one task orders and hashes, and runs of nodes that are merged at once.
RUN, FAN = 1 << 17, 64

_NODES = "tree string, total long, run long, level int, at long, hash binary"
_PATHS = "tree string, run long, level int, at long, shape binary, siblings binary"


def _hash(parts: list[bytes]) -> bytes:
    """The digest of some digests as lowercase hex text, one after the other."""
    return sha256(b"".join(parts).hex().encode()).digest()


def leaf(fields: list[Column]) -> Column:
    """The digest of values: ``-`` for a null, else the length in UTF-8 bytes, a colon, the value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256))


class Mountains:
    """A stack of completed nodes of one tree with ``total`` leaves, fed from left to right.

    A node is (level, at): the leaves from at * fanout ** level on. As in a counter with
    base ``fanout``, the last sibling of a run carries: the run's nodes leave the stack and
    their parent is pushed. The last run of a level is short, not padded. A run whose first
    siblings were never pushed stays, so what remains are the peaks of the part of the tree
    that was fed: few at each level, at either edge.
    """

    def __init__(self, fanout: int, total: int) -> None:
        self.fanout, self.widths = fanout, [total]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // fanout))
        self.stack: list[int] = []
        self.nodes: list[tuple[int, int, bytes]] = []  # records of nodes in the order of their completion
        self.up: list[tuple[int, int, int] | None] = []  # of each: record of the parent, place in its run, record of the run's first

    def push(self, level: int, at: int, hash_: bytes) -> None:
        self._record(level, at, hash_)
        while len(self.widths) > level + 1:
            count = at % self.fanout + 1
            run = self.stack[-count:]
            if at + 1 < self.widths[level] and count < self.fanout or len(run) < count or self.nodes[run[0]][:2] != (level, at - count + 1):
                return
            del self.stack[-count:]
            parent = len(self.nodes)
            for place, record in enumerate(run):
                self.up[record] = (parent, place, run)
            level, at = level + 1, at // self.fanout
            self._record(level, at, _hash([self.nodes[r][2] for r in run]))

    def _record(self, level: int, at: int, hash_: bytes) -> None:
        self.stack.append(len(self.nodes))
        self.nodes.append((level, at, hash_))
        self.up.append(None)

    def path(self, record: int) -> tuple[int, bytes, bytes]:
        """The peak above a record, and the way to it: (place, size) of each run as bytes, the siblings' digests."""
        shape, siblings = bytearray(), []
        while (step := self.up[record]) is not None:
            parent, place, run = step
            shape += bytes((place, len(run)))
            siblings += [self.nodes[r][2] for r in run if r != record]
            record = parent
        return record, bytes(shape), b"".join(siblings)


def fold(hash_: bytes, shape: bytes, siblings: bytes) -> bytes:
    """The root that a node with these siblings has."""
    at = 0
    for place, size in zip(shape[::2], shape[1::2], strict=True):
        others = [siblings[i : i + 32] for i in range(at, at + 32 * (size - 1), 32)]
        at += 32 * (size - 1)
        hash_ = _hash([*others[:place], hash_, *others[place:]])
    return hash_


def _climbed(fanout: int, table: pa.Table) -> tuple[Mountains, list[int]]:
    """The stack after the nodes of a run, and the record of each node."""
    mountains, records = Mountains(fanout, table["total"][0].as_py()), []
    for level, at, hash_ in zip(table["level"].to_pylist(), table["at"].to_pylist(), table["hash"].to_pylist(), strict=True):
        records.append(len(mountains.nodes))
        mountains.push(level, at, hash_)
    return mountains, records


def _peaks(fanout: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "key"):
            mountains, _ = _climbed(fanout, table)
            left = [mountains.nodes[r] for r in mountains.stack]
            tree, total, run = (table[c][0].as_py() for c in ("tree", "total", "run"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(left)), pa.array([total] * len(left), pa.int64()), pa.array([run] * len(left), pa.int64()), pa.array([n[0] for n in left], pa.int32()), pa.array([n[1] for n in left], pa.int64()), pa.array([n[2] for n in left], pa.binary())],
                ["tree", "total", "run", "level", "at", "hash"],
            )

    return step


def _split(table: pa.Table) -> tuple[dict[tuple[int, int], dict], pa.Table]:
    """Rows of a run: the paths above its peaks by (level, at), and its nodes."""
    above = table.filter(pa.compute.equal(table["side"], 0))
    return {(r["level"], r["at"]): r for r in above.to_pylist()}, table.filter(pa.compute.equal(table["side"], 1))


def _paths(fanout: int):
    """The way from each node to the root of its tree, from that inside its run and those above the run's peaks."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "key"):
            above, nodes = _split(table)
            mountains, records = _climbed(fanout, nodes)
            out = []
            for record in records:
                peak, shape, siblings = mountains.path(record)
                top = above.get(mountains.nodes[peak][:2], {"shape": b"", "siblings": b""})
                out.append((shape + top["shape"], siblings + top["siblings"]))
            own = [nodes[c].combine_chunks() for c in ("tree", "part", "level", "at")]
            yield from pa.Table.from_arrays([*own, pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["tree", "run", "level", "at", "shape", "siblings"]).to_batches()

    return step


def _proofs(fanout: int):
    """Proofs of leaves: what stands in the manifest."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "key"):
            above, nodes = _split(table)
            mountains, records = _climbed(fanout, nodes)
            out = []
            for record, changed in zip(records, nodes["changed"].to_pylist(), strict=True):
                peak, shape, siblings = mountains.path(record)
                top = above[mountains.nodes[peak][:2]]
                shape, siblings = shape + top["shape"], siblings + top["siblings"]
                own = mountains.nodes[record][2]
                found = fold(own if changed is None else changed, shape, siblings)
                out.append((own.hex(), top["subroot"].hex(), top["root"].hex(), sha256(siblings.hex().encode()).hexdigest(), found.hex(), found == top["root"]))
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield from pa.Table.from_arrays([nodes["doc_id"].combine_chunks(), *columns], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).to_batches()

    return step


def _fed(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes by tree and run, each run from left to right."""
    first = F.col("at") * F.pow(F.lit(fanout), F.col("level")).cast("long")
    keyed = nodes.withColumn("key", F.concat("tree", F.lit("\0"), F.col("run").cast("string"))).withColumn("first", first)
    return keyed.repartition("key").sortWithinPartitions("key", *(["side"] if "side" in nodes.columns else []), "first").drop("first")


def _joined(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """A run's nodes behind the paths of its peaks."""
    rows = nodes.withColumn("side", F.lit(1)).unionByName(above.withColumn("side", F.lit(0)), allowMissingColumns=True)
    return _fed(rows, fanout)


def climb(nodes: DataFrame, fanout: int, several: int) -> tuple[DataFrame, DataFrame]:
    """(tree, run, level, at, shape, siblings) of the nodes of ``several`` runs, and (tree, hash) of the roots.

    Each round merges FAN neighbouring runs into one and hands on its peaks; the ways back
    down are put together in the same groups.
    """
    if several == 1:  # every tree has been completed
        whole = nodes.select("tree", "run", "level", "at", F.lit(b"").alias("shape"), F.lit(b"").alias("siblings"))
        return whole, nodes.select("tree", "hash")
    grouped = nodes.withColumn("part", F.col("run")).withColumn("run", F.floor(F.col("run") / FAN).cast("long"))
    peaks = staged(_fed(grouped, fanout).select("key", *_columns(_NODES)).mapInArrow(Task(_peaks(fanout)), _NODES), "peaks")
    above, tops = climb(peaks, fanout, -(-several // FAN))
    rows = _joined(grouped, above, fanout).select("key", "side", "part", *_columns(_NODES), "shape", "siblings")
    return rows.mapInArrow(Task(_paths(fanout)), _PATHS), tops


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _ordered(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """``rows`` of trees as their leaves: run, level, at and total, in an order that begins with the tree.

    Rows are dealt in ranges of the whole order, so a large tree lies in many runs; a row per
    run and tree gives each its first number.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RUN))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("run", F.spark_partition_id().cast("long")), "leaves")
    held = dealt.groupBy("tree", "run").agg(F.count("*").alias("held"))
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("tree", "run", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(Window.partitionBy("tree")).alias("total"))
    here = Window.partitionBy("tree", "run").orderBy(*order)
    numbered = dealt.withColumn("place", F.row_number().over(here) - 1).join(starts, ["tree", "run"])
    return numbered.withColumn("at", (F.col("start") + F.col("place")).cast("long")).withColumn("level", F.lit(0)).drop("start", "place")


def _several(rows: DataFrame) -> int:
    return (rows.agg(F.max("run")).first()[0] or 0) + 1


def manifest(docs: DataFrame, changed: Column | None = None, fanout: int = 2) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of FIELDS. The leaves of each ``lang``, by doc_id, are the lowest
    level of a tree: runs of ``fanout`` nodes (the last one shorter) become their digest
    until one remains, the subroot. The subroots by lang are the leaves of one more tree,
    its top is the root. A proof is the siblings on the way up, those of one level from
    left to right. ``changed`` gives the digest of a row as it is verified where it is not
    null; ``folded_root`` is the root that it and the original siblings have.

    Null and empty values differ; a null lang is a lang, before all others; null ids come
    before all others; rows that share lang and id are ordered by their leaf, equal rows
    share their leaf and have proofs of their own; an empty table gives an empty result.
    Other columns are ignored.

    Only digests are shuffled, never texts. Rows are ordered in ranges of (lang, doc_id,
    leaf), a hot language being many ranges. Each range is hashed by a stack of mountains;
    the peaks of neighbouring ranges are merged FAN at a time in rounds, and the ways above
    them come back to the ranges. No task gets more than a range, FAN sets of peaks, or the
    range counts of one language.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("a run has 2 to 255 nodes")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf([F.col(c) for c in FIELDS]).alias("hash"),
        (F.lit(None).cast("binary") if changed is None else changed).alias("changed"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = staged(rows, "digests")
    leaves = _ordered(rows, ["tree", "doc_id", "hash", "_row"], rows.count()).select("doc_id", "changed", *_columns(_NODES))
    leaves = staged(leaves, "indexed")
    peaks = staged(_fed(leaves, fanout).select("key", *_columns(_NODES)).mapInArrow(Task(_peaks(fanout)), _NODES), "peaks")
    above, subroots = climb(peaks, fanout, _several(leaves))
    subroots = staged(subroots, "subroots")
    named = subroots.select(F.col("tree").alias("lang"), F.lit("").alias("tree"), "hash")
    langs = staged(_ordered(named, ["tree", "lang"], named.count()), "langs")
    firsts = staged(_fed(langs.select(*_columns(_NODES)), fanout).select("key", *_columns(_NODES)).mapInArrow(Task(_peaks(fanout)), _NODES), "peaks")
    beyond, root = climb(firsts, fanout, _several(langs))
    whole = _joined(langs.select(*_columns(_NODES)).withColumn("part", F.col("run")), beyond, fanout)
    up = whole.select("key", "side", "part", *_columns(_NODES), "shape", "siblings").mapInArrow(Task(_paths(fanout)), _PATHS)
    up = up.select("at", F.col("shape").alias("up_shape"), F.col("siblings").alias("up_siblings"))
    up = up.join(langs.select("at", F.col("lang").alias("tree"), F.col("hash").alias("subroot")), "at").withColumn("_top", F.lit(""))
    up = up.join(F.broadcast(root.select(F.col("tree").alias("_top"), F.col("hash").alias("root"))), "_top").drop("_top")  # one row
    above = above.join(up.drop("at"), "tree").select("tree", "run", "level", "at", F.concat("shape", "up_shape").alias("shape"), F.concat("siblings", "up_siblings").alias("siblings"), "subroot", "root")
    rows = _joined(leaves, above, fanout).select("key", "side", "doc_id", "changed", *_columns(_NODES), "shape", "siblings", "subroot", "root")
    kind = dict(leaves.dtypes)["doc_id"]
    return rows.mapInArrow(Task(_proofs(fanout)), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(every: int = 7) -> Column:
    """The digest of a row whose n_chars grew by one, where ``every`` divides the CRC-32 of its id; else null."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(hit, leaf([more if c == "n_chars" else F.col(c) for c in FIELDS]))


def oracle(every: int = 7) -> str:
    """DuckDB SQL for a fanout of two: levels by recursion, siblings by number, folding level by level."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    own = " || ".join(part(c) for c in FIELDS)
    other = " || ".join(part("(n_chars + 1)") if c == "n_chars" else part(c) for c in FIELDS)
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    return f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({own}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % {every} = 0 THEN sha256({other}) ELSE sha256({own}) END AS shown FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM rows_),
low(tree, level, pos, hash, held) AS (SELECT tree, 0, pos, leaf, total FROM leaves UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), CAST(ceil(any_value(held) / 2) AS BIGINT) FROM low WHERE held > 1 GROUP BY tree, level, pos // 2),
subroots AS (SELECT tree, hash AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS lang_at, count(*) OVER () AS langs FROM low WHERE held = 1),
high(level, pos, hash, held) AS (SELECT 0, lang_at, subroot, langs FROM subroots UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), CAST(ceil(any_value(held) / 2) AS BIGINT) FROM high WHERE held > 1 GROUP BY level, pos // 2),
steps AS (SELECT l.doc_id, l.leaf, l.tree, n.level, n.hash, xor(l.pos >> n.level, 1) < (l.pos >> n.level) AS before, n.held FROM leaves l JOIN low n ON n.tree = l.tree AND n.held > 1 AND n.pos = xor(l.pos >> n.level, 1)
  UNION ALL SELECT l.doc_id, l.leaf, l.tree, s.height + n.level, n.hash, xor(s.lang_at >> n.level, 1) < (s.lang_at >> n.level), n.held FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN high n ON n.held > 1 AND n.pos = xor(s.lang_at >> n.level, 1)),
proofs AS (SELECT doc_id, leaf, tree, sha256(string_agg(hash, '' ORDER BY level)) AS proof FROM steps GROUP BY ALL),
tops AS (SELECT max(level) AS top FROM high),
folded(doc_id, leaf, tree, level, hash) AS (SELECT doc_id, leaf, tree, 0, shown FROM leaves UNION ALL
  SELECT f.doc_id, f.leaf, f.tree, f.level + 1, CASE WHEN s.hash IS NULL THEN sha256(f.hash) WHEN s.before THEN sha256(s.hash || f.hash) ELSE sha256(f.hash || s.hash) END
  FROM folded f JOIN subroots r ON r.tree = f.tree CROSS JOIN tops t LEFT JOIN steps s ON s.tree = f.tree AND s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.leaf = f.leaf AND s.level = f.level WHERE f.level < r.height + t.top)
SELECT f.doc_id, f.leaf, r.subroot, h.hash AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = h.hash AS verified
FROM folded f JOIN subroots r ON r.tree = f.tree CROSS JOIN tops t JOIN high h ON h.held = 1 LEFT JOIN proofs p ON p.tree = f.tree AND p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.leaf = f.leaf
WHERE f.level = r.height + t.top
"""
