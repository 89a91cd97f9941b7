"""Reports that are kept up to date: a mergeable state for each model and date, so that new scores are added without reading old ones again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("model_id", "evaluation_date")
#: Registers of the sketch of cases as a power of two (error about 0.8 %), and k of the quantile sketch (rank error about 0.5 %).
CASES, QUANTILES = 14, 800


def state_of(scores: DataFrame) -> DataFrame:
    """(model_id, evaluation_date, n, mean, m2, low, high, cases, quantiles) of new scores: the moments, and sketches of the cases and of the composite. Scores that are null or NaN take no part."""
    x = F.col("cscs")
    known = scores.where(x.isNotNull() & ~F.isnan(x))
    return known.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("*")).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.hll_sketch_agg("case_id", F.lit(CASES)).alias("cases"), F.kll_sketch_agg_double(x.cast("double"), F.lit(QUANTILES)).alias("quantiles"),
    )


def kept(state: DataFrame, path: str) -> DataFrame:
    """``state`` written to ``path`` and read back, so that what merges it doesn't read the scores again."""
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def merged(*states: DataFrame) -> DataFrame:
    """One state of several, in any order. Squares are merged about the common mean, so that a large mean costs no digits."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    parts = every.select(*[F.col(c).alias(f"_{c}") for c in KEYS], "n", "mean", "m2")
    mean = parts.groupBy(*[f"_{c}" for c in KEYS]).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    m2 = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    moments = mean.select(*[f"_{c}" for c in KEYS], "n", "mean", m2.alias("m2"))
    whole = every.groupBy(*KEYS).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("cases").alias("cases"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS]
    return whole.join(moments, same).select(*KEYS, "n", "mean", "m2", "low", "high", "cases", "quantiles")


def report(state: DataFrame) -> DataFrame:
    """(model_id, evaluation_date, n, mean_cscs, sd_cscs, low, high, n_cases, median): exact but for n_cases and median, which come from sketches."""
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return state.select(*KEYS, "n", F.col("mean").alias("mean_cscs"), sd.alias("sd_cscs"), "low", "high", F.hll_sketch_estimate("cases").alias("n_cases"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)).alias("median"))
