"""Reading reviewed predictions and writing scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_half_even
from ..schemas import PENALTIES, PREDICTION_KEY


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed scores as strings; short rows have null cells."""
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE")


def written_scores(scores: DataFrame, weights: dict[str, int] = PENALTIES) -> DataFrame:
    """The key columns there are, the composite rounded to two places, and the weights that it was made with as JSON (``{"minor":1,...}``)."""
    keys = [c for c in PREDICTION_KEY if c in scores.columns]
    made_with = F.to_json(F.struct(*[F.lit(w).alias(x) for x, w in weights.items()]))
    return scores.select(*keys, round_half_even(F.col("cscs"), 2).alias("cscs"), made_with.alias("weights"))


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet", weights: dict[str, int] = PENALTIES) -> None:
    """``written_scores``, to a new folder."""
    written_scores(scores, weights).write.format(fmt).option("header", True).save(path)


def write_batch(rows: DataFrame, path: str, batch: int) -> int:
    """Writes a batch of rows to its own folder below ``path`` and gives their number. Written again, it replaces its own rows only.

    The batch counts as written once its line stands in the manifest (``path``/manifest), which comes last; ``read_batches`` reads no other.
    """
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    n = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows/batch={batch}").count()
    line = rows.sparkSession.range(1).select(F.lit(batch).cast("long").alias("id"), F.lit(n).cast("long").alias("n"))
    line.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/part={batch}")
    return n


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that were written to their end, with their number ``batch``; an error if a batch hasn't the rows that its line tells."""
    whole = spark.read.parquet(f"{path}/manifest").select("id", "n")
    rows = spark.read.parquet(f"{path}/rows").withColumn("batch", F.col("batch").cast("long"))
    known = rows.join(F.broadcast(whole.select(F.col("id").alias("batch"))), "batch", "left_semi")
    per = known.groupBy("batch").agg(F.count("*").alias("found"))
    for r in whole.join(per, F.col("id") == F.col("batch"), "left").where("coalesce(found, 0) != n").limit(1).collect():
        raise ValueError(f"batch {r['id']} has {r['found']} rows where {r['n']} were written")
    return known
