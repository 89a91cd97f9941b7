"""Joins of predictions with cases and of models with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PREDICTION_KEY


def attach_cases(scores: DataFrame, cases: DataFrame, columns: tuple[str, ...] = ("anchor_id", "domain", "variant", "source_type")) -> DataFrame:
    """Scores with their cases' facts. Spark broadcasts the cases while they are small and shuffles beyond that (splitting hot cases)."""
    facts = [c for c in columns if c in cases.columns]
    return scores.drop(*facts).join(cases.select("case_id", *facts), "case_id")


def unknown_cases(preds: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, n) of predictions that have no case."""
    return preds.groupBy("case_id").agg(F.count("*").alias("n")).join(cases.select("case_id"), "case_id", "left_anti")


def unscored_cases(cases: DataFrame, preds: DataFrame) -> DataFrame:
    """(model_id, case_id) of cases that a model has no prediction for.

    Models are few; each case gets the array of those that scored it and keeps the others, so cases are shuffled once and
    no product of models and cases is joined.
    """
    scored = preds.groupBy("case_id").agg(F.collect_set("model_id").alias("done"))
    models = preds.agg(F.collect_set("model_id").alias("models"))
    open_ = cases.select("case_id").distinct().join(scored, "case_id", "left").join(F.broadcast(models))
    rest = F.array_except("models", F.coalesce("done", F.array().cast("array<string>")))
    return open_.select(F.explode(rest).alias("model_id"), "case_id")


def pair_models(scores: DataFrame, model_a: str, model_b: str, on: tuple[str, ...] = ("case_id", "run_id"), cluster: str = "anchor_id", value: str = "cscs", carried: tuple[str, ...] = ()) -> DataFrame:
    """(on, cluster, score_a, score_b, carried), one shuffle; an item that one model lacks has null there. ``carried`` columns are facts of the item; of several values the last is taken."""
    of = lambda m: F.max(F.when(F.col("model_id") == m, F.col(value)))
    return scores.where(F.col("model_id").isin(model_a, model_b)).groupBy(*on).agg(F.max(cluster).alias(cluster), of(model_a).alias("score_a"), of(model_b).alias("score_b"), *[F.max(c).alias(c) for c in carried])


def duplicate_predictions(preds: DataFrame) -> DataFrame:
    """(keys, n) of predictions that stand more than once, by the key columns there are."""
    return preds.groupBy(*[c for c in PREDICTION_KEY if c in preds.columns]).agg(F.count("*").alias("n")).where("n > 1")


def pairing_faults(scores: DataFrame, cases: DataFrame) -> dict[str, DataFrame]:
    """What a comparison would silently leave out or choose from: predictions of unknown cases, repeated predictions, repeated cases."""
    again = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")
    return {"unknown_cases": unknown_cases(scores, cases), "duplicate_predictions": duplicate_predictions(scores), "duplicate_cases": again}


def write_and_require_none(faults: dict[str, DataFrame], out: str) -> None:
    """Writes each table of faults below ``out``; an error that names those that aren't empty, with a row of each."""
    found = []
    for name, df in faults.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        for r in df.sparkSession.read.parquet(f"{out}/{name}").limit(1).collect():
            found.append(f"{name} ({', '.join(map(str, r))})")
    if found:
        raise ValueError(f"scores and cases don't fit, see {out}: {'; '.join(found)}")
