"""Scoring of predictions as they arrive. Scoring is row by row, so it runs unchanged on a stream; cases are a static side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairing import attach_cases
from ..operators.scoring import quarantined, score


def read_prediction_stream(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """CSV files that arrive in ``folder``, all cells as strings, in the order of ``columns``."""
    return spark.readStream.csv(folder, schema=", ".join(f"`{c}` string" for c in columns), header=True, mode="PERMISSIVE")


def start_scoring(preds: DataFrame, cases: DataFrame | None, scores_path: str, rejects_path: str, checkpoint: str, once: bool = False) -> list[StreamingQuery]:
    """Two queries: good rows scored (and joined with ``cases``) to ``scores_path``, bad rows to ``rejects_path``; exactly once by Spark's file sink."""
    scored = score(preds, on_error="quarantine")
    scored = attach_cases(scored, cases) if cases is not None else scored

    def start(df: DataFrame, path: str, name: str) -> StreamingQuery:
        out = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}")
        return (out.trigger(availableNow=True) if once else out).start()

    return [start(scored, scores_path, "scores"), start(quarantined(preds), rejects_path, "rejects")]
