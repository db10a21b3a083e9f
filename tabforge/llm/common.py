"""Helpers that several corpus operators share: work tables, let-bindings and word splitting in column expressions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the controls from tab to carriage return.
WORD_SPACE = " \t\n\x0b\f\r"
_SPLIT = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for work tables: spark.checkpoint.dir; only where that is unset and Spark runs in this one process
    (tests), a local folder is set.  On a cluster without that setting each executor would write to its own disk: an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tabforge-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Work tables by scope: the process's own first, then those of the open scratch() blocks.
_scopes: list[list[str]] = [[]]


def work_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new place in the shared folder for a work table or archive, of the open scope or, if outer, of that around it."""
    path = f"{shared_dir(spark)}/tabforge-work/{uuid.uuid4().hex}-{name}"
    _scopes[-2 if outer and len(_scopes) > 1 else -1].append(path)
    return path


def written(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is read column by column."""
    path = work_path(df.sparkSession, name, outer)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> int:
    """Deletes work tables through Hadoop's file system, wherever the shared folder is; returns how many."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the work tables that are written while it is open once it closes, but for those written as outer ones: these
    are what the frame that goes out still reads."""
    _scopes.append([])
    try:
        yield
    finally:
        delete(spark, _scopes.pop())


def clear_work(spark: SparkSession) -> int:
    """Deletes the work tables that this process has written and not yet deleted; to be called once the frames that read
    them are done with.  Returns how many there were."""
    paths, _scopes[0] = _scopes[0], []
    return delete(spark, paths)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """While it is open, queries that run hand Python at most so many rows at once: bounds a worker's memory where rows are
    large.  The session's own setting holds again after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bound_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lets the session hand Python at most so many rows at once from now on, for frames that are run after the caller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def tidy(run):
    """A function over batches that gives a finished task's memory back, since its worker process idles on beside others."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body uses it many times, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text that isn't null, in order."""
    return let(F.btrim(text, F.lit(WORD_SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _SPLIT, -1)))


def sub_batches(texts: list, most: int = 1_000_000):
    """Slices of a list of texts of about so many characters each; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
