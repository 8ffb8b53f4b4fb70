"""Helpers that the corpus operators share: inputs, staged tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch. Texts may be long: a batch must fit a Python worker several times.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; Arrow batches of the session become small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent and the master is plain local mode is a
    temporary folder made, since then there is one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lithic-")
    return f"file://{_own}"


_own: str | None = None


def staged(df: DataFrame, name: str, partition_by: str | None = None, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts the lineage: executors that are lost later cost no recomputation of
    what came before. The folder goes with ``release`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lithic-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    if not _staged:
        atexit.register(release, spark)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


_staged: list[str] = []


def release(spark: SparkSession) -> None:
    """Removes all staged tables; for sessions that live on after their results are written. Results that are not yet written are lost."""
    while _staged:
        path = _staged.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone at exit
            pass


def word_count(text):
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def runs(batches, key: str, empty=None):
    """Record batches of rows sorted by ``key`` as one table per value: (value, table)."""
    import numpy as np
    import pyarrow as pa

    at, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if parts and values[a] != at:
                yield at, pa.Table.from_batches(parts)
                parts = []
            at = values[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield at, pa.Table.from_batches(parts)


def id_filter(ids: DataFrame, column: str, bits: int = 23):
    """A bit map of hashed ids as bytes: 2 ** bits bits, however many ids there are.

    It may let other ids pass, so it only thins rows before a join.
    """
    import numpy as np

    hit = ids.select((filter_slot(column, bits) + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))  # these functions count from 1
    out = np.zeros(-(-(1 << bits) // 32768) * 4096, np.uint8)
    for row in hit.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():  # at most 2 ** bits / 32768 rows
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        at = (row["bucket"] - 1) * 4096
        out[at : at + len(part)] |= part
    return out


def filter_slot(column: str, bits: int = 23):
    """The slot of an id in the bit map: bit (slot % 8) of byte (slot // 8), from 0 on."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))


class Task:
    """A function over record batches for mapInArrow that gives memory back when its task ends.

    Steps run one after the other in one Python worker.
    """

    def __init__(self, *steps) -> None:
        self.steps = steps

    def __call__(self, batches):
        try:
            for step in self.steps:
                batches = step(batches)
            yield from batches
        finally:
            _give_back()


def _give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system: workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
