"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and encoding, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm import bpe, mixing, near_dedup, quality, secrets
from tabforge.llm.common import bound_batches, delete, scratch, table, work_path, written
from tabforge.llm.queries import TARGETS, TOKENIZER, trusted

#: Near-duplicates: words of a shingle and similarity.
WORDS, SIMILARITY = 5, 0.8
#: Ids of dropped documents of which so many at most are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return quality.judged(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays; documents without doc_id stay.

    Rows that share a doc_id are one document: those of equal text are repeats, of which the one that is least as JSON
    stays; those of different texts all stay or all go, since each text is the only one of its kind.
    """
    with scratch(spark):
        groups = near_dedup.near_groups(docs, words=WORDS, similarity=SIMILARITY)
        gone = written(groups.filter("NOT kept").select("doc_id").distinct(), "gone", outer=True)
        again = written(groups.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again", outer=True)
    ids = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x.hint("merge")
    out = docs.join(ids(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return out
    again = ids(again)
    order = W.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*docs.columns)))
    once = out.join(again, "doc_id", "left_semi").withColumn("\0row", F.row_number().over(order)).filter(F.col("\0row") == 1)
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    bound_batches(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the languages' token totals meet the target shares; each stays at least once."""
    mixed, _ = mixing.mixture(docs, trusted(table(spark, sf_dir, "labels")), TARGETS, least=1.0)
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("\0copy")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    bound_batches(spark)
    return bpe.encoded_and_checked(docs, TOKENIZER, keep=["doc_id", "lang", "source"])


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scan", mask_secrets), ("mixing", mix_domains), ("bpe encoding", encode)]

#: Signatures, iterated links and byte pairs aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of documents."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        delete(spark, before)  # the rows of the stage before are done with
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
