"""A corpus pipeline of five stages over ``documents``; each stage's rows are written as Parquet and read again for the next.

Both classifiers learn from the labels outside the rows that their queries hold out (crc32 of the id), so a third of the
labelled documents can tell how good the stages are. A null or empty text gets the classifiers' score for no n-grams, and goes or stays by it;
it is a near-duplicate of other empty texts, holds no benchmark item, and is never taken by the mix. Rows without an id, rows that
share one and rows that repeat are rows of their own up to near-duplicates, where one of equal texts stays. Ties go by id, then
by a hash of the text. Texts are read whole, however long. An empty table stays empty. Extra columns come through all stages as they are,
whatever they are called, but for those that the last stage adds: size, source_size, target and taken replace columns of these names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casesafety.llm import decontaminate, mixing, quality, simhash, toxicity
from casesafety.llm.common import drop_folder, run_folder, shared_dir, table, text_hash
from casesafety.llm.features import lower_char_ngrams, shape_and_char_ngrams
from casesafety.llm.nbsvm import scorer

#: Documents scored at or above this are rejected as toxic; those scored below the other are rejected as bad.
TOXIC_FROM, GOOD_FROM = 0.3, 0.5


def _learned(spark: SparkSession, sf_dir: str, by: int, held: int) -> DataFrame:
    """The labels outside the held-out rows."""
    return table(spark, sf_dir, "labels").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by)) != held)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, _learned(spark, sf_dir, 4, 2))
    return docs.where(scorer(docs, model, lower_char_ngrams)(F.col("text").cast("string")) < TOXIC_FROM)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, _learned(spark, sf_dir, 3, 1))
    return docs.where(scorer(docs, model, shape_and_char_ngrams)(F.col("text").cast("string")) >= GOOD_FROM)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, simhash.near_duplicates(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each (repeats counted)."""
    taken = mixing.mix(docs.select("doc_id", "source", "text", text_hash().alias("key")), keys=("key",))
    # Rows are known by doc_id (null included), source and text; those equal in all three are numbered in the same order on either side.
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("from"), text_hash().alias("hash"))
    left = left.select("*", F.xxhash64("id", "from", "hash").alias("known")).withColumn("copy", F.row_number().over(Window.partitionBy("known").orderBy("id", "from", "hash")))
    right = taken.select("*", F.xxhash64("doc_id", "source", "key").alias("its")).withColumn("number", F.row_number().over(Window.partitionBy("its").orderBy("doc_id", "source", "key", F.desc("taken")))).where("taken > 0")
    # One key of the join, the windows' own, so that texts are shuffled once.
    same = (F.col("known") == F.col("its")) & (F.col("copy") - F.col("number") == 0)
    added = ("size", "source_size", "target", "taken")
    return left.join(right, same).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


STAGES = [
    ("toxicity", not_toxic),
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
]

#: SQL has no way to fit the two classifiers; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has staged goes once its rows are written, and those once the next stage's are; the last stage's input and tables stay, since the result reads them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        written = f"{shared_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
        with run_folder(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(written)
        docs = spark.read.schema(rows.schema).parquet(written)
        if before:
            drop_folder(spark, before)
        before = written
