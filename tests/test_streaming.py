"""Repeated predictions on a stream, and tables of batches."""

import pytest
from pyspark.sql import functions as F

from casesafety.operators import pairing, scoring
from casesafety.schemas import DIMENSIONS
from casesafety.sources import predictions
from casesafety.streaming.repeats import start_scoring_once_each
from casesafety.streaming.scoring import read_prediction_stream

NAMES = ["case_id", "model_id", "run_id", *DIMENSIONS]
FILES = {
    "a": ["c1,m,r,2,2,2,2,2,2", "c2,m,r,2,2,2,2,2,1", "c1,m,r,1,1,1,1,1,1"],
    "b": ["c1,m,r,2,2,2,2,2,2", "c3,m,r,2,2,2,2,2,9", "c1,n,r,0,0,0,0,0,0"],
    "c": ["c2,m,r,2,2,2,2,2,1", "c4,m,,2,2,2,2,2,2", "c4,m,,2,2,2,2,2,2"],
}


def write(folder, name):
    (folder / f"{name}.csv").write_text("\n".join([",".join(NAMES), *FILES[name]]) + "\n")


@pytest.mark.parametrize("order", ["abc", "cba", "bca"])
def test_batches_in_any_order_give_what_a_batch_query_gives(spark, tmp_path, order):
    """Each file is a batch of its own, after a restart from the checkpoint."""
    folder = tmp_path / "in"
    folder.mkdir()
    cases = spark.createDataFrame([(f"c{k}", f"A{k}") for k in range(1, 5)], "case_id string, anchor_id string")
    paths = [str(tmp_path / x) for x in ("scores", "rejects", "checkpoint")]
    for name in order:
        write(folder, name)
        start_scoring_once_each(read_prediction_stream(spark, str(folder), NAMES), cases, *paths, once=True).awaitTermination(120)
    scores, rejects = (predictions.read_batches(spark, p) for p in paths[:2])
    whole = predictions.read_predictions(spark, str(folder))
    keys = ["case_id", "model_id", "run_id"]
    want = sorted(map(tuple, pairing.duplicate_predictions(whole).collect()), key=str)
    again = rejects.where("reason = 'repeated'").groupBy(*keys).agg((F.count("*") + 1).alias("n"))
    assert sorted(map(tuple, again.collect()), key=str) == want and len(want) == 3
    assert rejects.where("reason != 'repeated'").select("case_id").collect() == [("c3",)]
    assert sorted(map(str, scores.select(*keys).collect())) == sorted(map(str, scoring.score(whole, on_error="quarantine").select(*keys).distinct().collect()))
    assert {r["anchor_id"] for r in scores.collect()} == {"A1", "A2", "A4"} and len({r["batch"] for r in rejects.collect()}) == 3
    assert scores.first()["weights"] == '{"minor":1,"moderate":3,"severe":6}'


def test_a_batch_that_failed_is_not_read_and_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    assert predictions.write_batch(spark.range(3), path, 0) == 3
    broken = spark.range(0, 40, 1, 4).select(F.when(F.col("id") < 35, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        predictions.write_batch(broken, path, 1)
    assert sorted(r["id"] for r in predictions.read_batches(spark, path).collect()) == [0, 1, 2]
    for _ in range(2):  # run again, and once more
        predictions.write_batch(spark.range(10, 14), path, 1)
        got = predictions.read_batches(spark, path)
        assert sorted((r["batch"], r["id"]) for r in got.collect()) == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11), (1, 12), (1, 13)]
    predictions.write_batch(spark.range(0), path, 1)
    assert sorted(r["id"] for r in predictions.read_batches(spark, path).collect()) == [0, 1, 2]
    spark.range(99).write.mode("overwrite").parquet(f"{path}/rows/batch=0")
    with pytest.raises(ValueError, match="batch 0"):
        predictions.read_batches(spark, path)
