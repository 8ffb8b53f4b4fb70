"""A corpus pipeline: toxic documents go, recurring lines go, near copies go, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import jaccard_join, line_templates, mixing, piece_codec, toxicity
from lithic.llm.common import staged, table
from lithic.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold.

    Null and empty texts score low and stay; equal rows go or stay together; no rows give none.
    """
    scored = toxicity.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep=True)
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; n_chars follows the text, where lines went.

    Null texts and rows without an id stay as they are; no document goes, though its text may become empty.
    """
    done = line_templates.drop_recurring(docs.select(*COLUMNS))
    changed = F.when(F.size("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents that with the smallest id.

    Rows that share an id or have none are documents of their own here, so one row of each
    component stays. The first row of an id counts as that id, other rows come after all ids.
    Null texts and texts without words are near nothing and stay; no rows give none.
    """
    docs = docs.select(*COLUMNS)
    repeated = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"))
    repeated = staged(repeated, "repeated")
    rows = docs.withColumn("_row", F.col("doc_id").cast("long"))
    if not repeated.isEmpty():
        last = docs.agg(F.max("doc_id")).first()[0] or 0
        odd = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").withColumn("_row", F.monotonically_increasing_id() + F.lit(max(int(last), 0) + 1))
        odd = staged(odd, "odd")  # the numbers must not change
        first = odd.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_row").alias("_first")).withColumnRenamed("doc_id", "_id")
        odd = odd.join(first, F.col("doc_id") == F.col("_id"), "left").withColumn("_row", F.when(F.col("_row") == F.col("_first"), F.col("doc_id").cast("long")).otherwise(F.col("_row")))
        rows = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").unionByName(odd.select(*COLUMNS, "_row"))
    copies = jaccard_join.join(rows.select(F.col("_row").alias("doc_id"), "text")).where("component_id <> doc_id").select(F.col("doc_id").alias("_copy")).distinct()
    return rows.join(copies, F.col("_row") == F.col("_copy"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, its columns repeated.

    A null source is a source; texts without words weigh nothing and are still dealt; no rows give none.
    """
    mixed = mixing.mix(docs, carry=("text", "lang", "source", "n_chars"))
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text; a null text counts as empty; no rows give none."""
    return piece_codec.encode(docs, piece_model(), full=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The trained stage and the tokenizer have no SQL form; a test holds run() against each stage by hand on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
