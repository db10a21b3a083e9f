"""Token counts of documents in flat token files without an index, by a separator scan.

A flat file is the ids of its documents one after the other in little-endian words of fixed width, each document closed
by the end-of-document id.  Files are cut into blocks; each block is searched for that id in one vectorised comparison,
by itself and in parallel.  A prefix scan over one summary row per block then gives every block the place of the last
separator before it and the number of documents before it, so that documents which reach over blocks are whole.

A file is one row when it is read, so shards should be of at most some hundred MB; the writer makes one of each partition
of its input.  Defined results: a document without ids counts 0; ids after the last separator are a document that isn't
closed; an empty file has no documents; bytes beyond the last whole word are an error, and so is a width that doesn't hold
every id; equal documents are counted each; a null text is a document of no ids; columns besides the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm import bpe
from tabforge.llm.common import small_batches, sub_batches, written

#: Bytes of a block, and blocks that a worker gets at once.
BLOCK_BYTES, BLOCKS_AT_ONCE = 1 << 19, 4


def write_flat(docs: DataFrame, path: str, vocabulary: str, end_of_document: int, width: int = 2, text_col: str = "text") -> None:
    """Encodes the texts (null: empty) and writes flat files under path, in the order of the rows.

    A text that holds the end-of-document string has that id inside and so reads back as several documents.
    """
    kind = f"<u{width}"
    if max(end_of_document + 1, len(bpe.tokenizer(vocabulary).pieces)) > 2 ** (8 * width):
        raise ValueError(f"ids of this vocabulary don't fit in {width} bytes")

    def run(batches):
        tokens = bpe.tokenizer(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in sub_batches(texts, bpe.BATCH_CHARS):
                raw = [np.asarray(x, kind).tobytes() for x in tokens.encode_batch(texts[i:j])]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["raw"])

    close = end_of_document.to_bytes(width, "little").decode("latin-1")
    ids = docs.select(F.col(text_col).cast("string")).mapInArrow(bpe.forgetful(run), "raw binary")
    # The text writer puts out a string's bytes as they are, and the separator after each row.
    ids.select(F.col("raw").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", close).option("compression", "none").text(path)


def blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, length, block and bytes of every block of the flat files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    n = F.ceil(F.col("length") / block_bytes).cast("int")
    # Cut before rows are multiplied, so that no block carries its whole file.
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: F.substring(F.col("content"), b * block_bytes + 1, F.lit(block_bytes)))
    return files.select(F.col("path").alias("file"), "length", F.posexplode(cut).alias("block", "bytes"))


def separators(cut: DataFrame, end_of_document: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, tokens (in the file), block and ends: places in the file of the block's separators."""
    kind, words = f"<u{width}", block_bytes // width

    def run(batches):
        for b in batches:
            first = b.column(2).to_numpy().astype(np.int64) * words
            ends = [at + np.flatnonzero(np.frombuffer(raw.as_buffer(), kind) == end_of_document) for at, raw in zip(first, b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ends, pa.list_(pa.int64()))], names=["file", "tokens", "block", "ends"])

    return cut.select("file", (F.col("length") / width).cast("long").alias("tokens"), "block", "bytes").mapInArrow(run, "file string, tokens long, block int, ends array<bigint>")


def counted(marks: DataFrame) -> DataFrame:
    """file, ordinal (from 0), start, n_tokens and closed of every document: block boundaries stitched by a prefix scan."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")
    n = F.size("ends")
    m = marks.withColumn("last", F.when(n > 0, F.element_at("ends", -1)))
    m = m.select(
        "file", "tokens", "ends",
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
        F.coalesce(F.sum(n.cast("long")).over(before), F.lit(0)).alias("docs_before"),
        (F.col("block") == F.max("block").over(whole)).alias("is_last"),
    )
    closed = m.select("file", "ends", "previous", "docs_before", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("previous")) + 1
    rows = closed.select("file", (F.col("docs_before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = F.when(n > 0, F.element_at("ends", -1)).otherwise(F.col("previous")) + 1
    rest = m.filter("is_last").select("file", (F.col("docs_before") + n).alias("ordinal"), tail.alias("start"), (F.col("tokens") - tail).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return rows.union(rest)


def count_tokens(spark: SparkSession, path: str, end_of_document: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document of the flat files under path: file, ordinal, start, n_tokens, closed."""
    with small_batches(spark, BLOCKS_AT_ONCE):
        marks = written(separators(blocks(spark, path, block_bytes), end_of_document, width, block_bytes), "separators")
    return counted(marks)
