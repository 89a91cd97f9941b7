"""Run records: which one was in force when a score was made, and what that says about a model over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bootstrap

#: Parts that a model's scores are dealt to, so that a model with most of the scores is no task of its own.
PARTS = 64


def as_of(scores: DataFrame, records: DataFrame, time: str, since: str = "evaluation_date", by: str = "model_id", parts: int = PARTS) -> DataFrame:
    """``scores`` with a struct ``record``: the columns of the record of the same ``by`` that was the last to begin at or before ``time``.

    One sort, no range join: scores and records (few, each sent to all parts of its model) stand in one order and a score takes the last record in front of
    it. A record counts from its own moment on. Of records that begin together the one whose columns are greatest counts, nulls being least. Scores
    without a time, without a ``by`` or before the first record have a null record; records without either are left out.
    """
    known = records.where(F.col(since).isNotNull() & F.col(by).isNotNull())
    record = F.struct(*records.columns)
    row = scores.select(F.col(by).alias("_by"), F.col(time).cast("timestamp").alias("_at"), F.lit(1).alias("_kind"), F.pmod(F.xxhash64(*[c for c, t in scores.dtypes if not t.startswith(("map", "variant"))]), F.lit(parts)).cast("int").alias("_part"), F.struct("*").alias("_row"), F.lit(None).cast(known.select(record.alias("r")).schema["r"].dataType).alias("_record"))
    begun = known.select(F.col(by).alias("_by"), F.col(since).cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(None).cast(row.schema["_row"].dataType).alias("_row"), record.alias("_record"))
    order = [F.col("_at").asc_nulls_first(), "_kind", *[F.col(f"_record.{c}").asc_nulls_first() for c, t in records.dtypes if not t.startswith(("map", "variant"))]]
    before = Window.partitionBy("_by", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = row.unionByName(begun).withColumn("_last", F.last("_record", ignorenulls=True).over(before)).where("_kind = 1")
    taken = F.when(F.col("_at").isNotNull() & F.col("_by").isNotNull(), F.col("_last"))
    return met.select("_row.*", taken.alias("record"))


def records_by_model(scores: DataFrame, records: DataFrame, time: str = "evaluation_date") -> DataFrame:
    """``as_of`` for scores with a column ``time``; scores without one take their model's record, and it is an error if a model has records of several dates."""
    if time in scores.columns:
        return as_of(scores, records, time)
    per = records.groupBy("model_id").agg(F.count_distinct("evaluation_date").alias("dates"))
    for r in per.where("dates > 1").orderBy("model_id").limit(1).collect():
        raise ValueError(f"model {r['model_id']} has records of {r['dates']} dates, so scores need a column {time} to tell which one they belong to")
    one = records.where("model_id is not null").groupBy(F.col("model_id").alias("_model")).agg(F.max(F.struct(*[c for c, t in records.dtypes if not t.startswith(("map", "variant"))])).alias("record"))
    return scores.join(one, F.col("model_id") == F.col("_model"), "left").drop("_model")


def with_record_date(scores: DataFrame) -> DataFrame:
    """``scores`` with the date of their record as evaluation_date; those without a record are left out."""
    return scores.where("record is not null").withColumn("evaluation_date", F.col("record.evaluation_date"))


def retrieval_pairs(scores: DataFrame, cluster: str = "anchor_id", value: str = "cscs") -> DataFrame:
    """(model_id, case_id, cluster, score_a, score_b): a case's mean score in runs with retrieval and in runs without, as their records say; null where there are none."""
    with_it = F.col("record.retrieval_config").isNotNull()
    known = scores.where("record is not null")
    return known.groupBy("model_id", "case_id").agg(F.max(cluster).alias(cluster), F.avg(F.when(with_it, F.col(value))).alias("score_a"), F.avg(F.when(~with_it, F.col(value))).alias("score_b"))


def retrieval_effect(scores: DataFrame, cluster: str = "anchor_id", value: str = "cscs", n_boot: int = 5000, seed: int = 2026) -> DataFrame:
    """(model_id, mean_difference, ci_2_5, ci_97_5): what retrieval adds to a model's score, over the cases that it was asked both ways."""
    return bootstrap.bootstrap_by_group(retrieval_pairs(scores, cluster, value), ("model_id",), cluster, n_boot, seed)
