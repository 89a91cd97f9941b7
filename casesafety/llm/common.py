"""What the operators share: tables staged in the shared folder and cheap per-document hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than ASCII white space, as ``bytes.split()`` finds them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local one in local mode, and an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


_FOLDER: ContextVar[str | None] = ContextVar("folder of the run", default=None)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark reads it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What is staged within goes to one folder, which is deleted at the end. Results have to be written before that."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    outer = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(outer)
        drop_folder(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder (or that of the run, see ``run_folder``) and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_and_told(df: DataFrame, name: str, *told: Column) -> tuple[DataFrame, dict]:
    """``staged``, with aggregates (named columns) of the written rows. (An Observation would save the job, but a session that has used one can't run ML's transformers any more.)"""
    table = staged(df, name)
    return table, table.agg(*told).first().asDict()


def n_words(text):
    """Number of words; a null text has none. The cast keeps null when the column is not a string."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def text_hash():
    """A 64-bit hash of the column ``text``, which tells apart rows that share a doc_id or have none; a null text has one of its own."""
    return F.xxhash64(F.col("text").cast("string"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (finaliser with fixed odd multipliers)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))

