"""spark-submit jobs/score_predictions.py PREDICTIONS_CSV OUT_DIR [raise|quarantine]: writes scores, and the cells that can't be scored.

'raise' (the default) fails on the first bad row, after the tables of bad cells are written; 'quarantine' leaves bad rows out.
"""

import sys

from pyspark.sql import SparkSession

from casesafety.operators import scoring
from casesafety.sources import predictions


def main(path: str, out: str, on_error: str = "raise") -> None:
    spark = SparkSession.builder.appName("score_predictions").getOrCreate()
    preds = predictions.read_predictions(spark, path)
    scoring.rating_violations(preds).write.parquet(f"{out}/rating_violations")
    scoring.danger_count_violations(preds).write.parquet(f"{out}/danger_count_violations")
    predictions.write_scores(scoring.score(preds, on_error=on_error), f"{out}/scores")


if __name__ == "__main__":
    main(*sys.argv[1:])
