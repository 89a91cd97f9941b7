import itertools

import pytest
from pyspark.sql import functions as F

from casesafety.operators import scoring
from casesafety.schemas import DIMENSIONS, PENALTIES
from casesafety.sources import predictions
from casesafety.streaming.scoring import read_prediction_stream, start_scoring


def frame(spark, ratings, **danger):
    row = {"case_id": "c", **dict(zip(DIMENSIONS, map(str, ratings), strict=False)), **danger}
    return spark.createDataFrame([row], ", ".join(f"{k} string" for k in row))


def test_perfect_and_partial_sums(spark):
    assert scoring.score(frame(spark, [2] * 6)).first()["cscs"] == 100.0
    r = scoring.score(frame(spark, [0, 1, 2, 0, 1, 2])).first()
    assert (r["raw_score"], r["cscs"]) == (6.0, 50.0)


#: Up to twice each level: the penalty by adding up, the composite by the formula.
LEVELS = [[level for level, n in zip(PENALTIES, times, strict=True) for _ in range(n)] for times in itertools.product(range(3), repeat=3)]


@pytest.mark.parametrize("levels", [*LEVELS, None])
def test_penalties(spark, levels):
    want = sum(PENALTIES[x] for x in levels or [])
    df = spark.createDataFrame([(levels,)], "levels array<string>").select(scoring.danger_penalty_from_list(F.col("levels")).alias("p"), scoring.composite(F.lit(12.0), scoring.danger_penalty_from_list(F.col("levels"))).alias("c"), scoring.unknown_levels(F.col("levels")).alias("u"))
    r = df.first()
    assert r["p"] == want and r["c"] == pytest.approx(max(0, 12 - want) / 0.12, abs=1e-12) and not r["u"]


def test_unknown_level(spark):
    r = spark.createDataFrame([(["minor", "grave"],)], "l array<string>").select(scoring.unknown_levels(F.col("l")), scoring.danger_penalty_from_list(F.col("l"))).first()
    assert r[0] is True and r[1] is None


OUTSIDE = [f"{sign}{x}" for x in ("1e-6", "0.5", "1e300") for sign in ("-",)] + [repr(2 + 2.0**-k) for k in (1, 20, 51)] + ["nan", "+inf", "-infinity", " 7 "]
NO_NUMBERS = ["two", "1,5", "1d", "2F", "0x2", "1_1", "--1", "1 2", "½"]


@pytest.mark.parametrize("dimension", DIMENSIONS)
def test_bad_ratings_are_named(spark, dimension):
    wanted = dict.fromkeys(OUTSIDE, "out_of_range") | dict.fromkeys(NO_NUMBERS, "not_a_number") | dict.fromkeys(["", "  ", None], "missing")
    rows = frame(spark, [2] * 6).drop("case_id", dimension).crossJoin(spark.createDataFrame([(str(k), v) for k, v in enumerate(wanted)], f"case_id string, {dimension} string"))
    found = {r["case_id"]: (r["dimension"], r["reason"]) for r in scoring.rating_violations(rows).collect()}
    assert found == {str(k): (dimension, wanted[v]) for k, v in enumerate(wanted)}
    assert scoring.score(rows, on_error="quarantine").count() == 0 and scoring.quarantined(rows).count() == len(wanted)
    with pytest.raises(Exception, match="bad rating"):
        scoring.score(rows.limit(1)).collect()
    assert scoring.rating_violations(frame(spark, [2] * 6).drop(dimension)).first()["reason"] == "missing"


def test_cells_are_read_by_their_type(spark):
    """Numbers as they are, texts as people write them: the same scores either way."""
    texts = frame(spark, [0, 1, 2, 2, 1, 0], danger_minor="1", danger_moderate="", danger_severe="-4")
    numbers = texts.select("case_id", *[F.col(d).cast(t).alias(d) for d, t in zip(DIMENSIONS, ("int", "bigint", "double", "float", "smallint", "double"), strict=True)], F.col("danger_minor").cast("int").alias("danger_minor"), F.lit(None).cast("bigint").alias("danger_moderate"), F.lit(-4).cast("tinyint").alias("danger_severe"))
    want = scoring.score(texts).select("raw_score", "danger_penalty", "cscs").collect()
    assert scoring.score(numbers).select("raw_score", "danger_penalty", "cscs").collect() == want and want[0]["danger_penalty"] == 1.0
    assert "rlike" not in scoring.score(numbers)._jdf.queryExecution().optimizedPlan().toString().lower()
    for bad in (float("nan"), 2.5, -1.0, None):
        assert scoring.score(numbers.withColumn("disposition", F.lit(bad).cast("double")), on_error="quarantine").count() == 0
    whole = numbers.withColumn("danger_minor", F.lit(2.0))  # a double is no whole number, whatever its value
    assert scoring.score(whole, on_error="quarantine").count() == 0 and scoring.danger_count_violations(whole).first()["level"] == "minor"


def test_counts(spark):
    assert scoring.score(frame(spark, [2] * 6, danger_minor="-3", danger_severe="")).first()["danger_penalty"] == 0
    bad = frame(spark, [2] * 6, danger_minor="2.0")
    assert scoring.danger_count_violations(bad).first()["level"] == "minor"


def test_csv_round_trip(spark, tmp_path):
    names = ["case_id", *DIMENSIONS, "danger_minor", "danger_moderate", "danger_severe", "reviewer_notes"]
    rows = ["row-1,2,2,2,2,2,2,,,,", "row-2,2,2,2,2,2,1,2,1,,", "row-3,2,2,2,2,2,2,,,3,", "row-4,2,2,2,2,2,2"]
    (tmp_path / "p.csv").write_text("\n".join([",".join(names), *rows]) + "\n")
    preds = predictions.read_predictions(spark, str(tmp_path / "p.csv"))
    predictions.write_scores(scoring.score(preds), str(tmp_path / "out"))
    got = {r["case_id"]: r["cscs"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"row-1": 100.0, "row-2": 50.0, "row-3": 0.0, "row-4": 100.0}


def test_stream_scores_like_a_batch(spark, tmp_path):
    names = ["case_id", "model_id", "run_id", *DIMENSIONS]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(",".join(names) + "\nc1,m,r,2,2,2,2,2,2\nc2,m,r,2,2,2,2,2,9\n")
    cases = spark.createDataFrame([("c1", "A1")], "case_id string, anchor_id string")
    for q in start_scoring(read_prediction_stream(spark, str(tmp_path / "in"), names), cases, str(tmp_path / "s"), str(tmp_path / "r"), str(tmp_path / "c"), once=True):
        q.awaitTermination(60)
    assert [(r["case_id"], r["cscs"], r["anchor_id"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [("c1", 100.0, "A1")]
    assert spark.read.parquet(str(tmp_path / "r")).first()["case_id"] == "c2"


def test_weights_constant(spark):
    df = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 1)], "run_id string, w int").select("run_id", F.struct("w").alias("weights"))
    assert [r["run_id"] for r in scoring.weights_constant_check(df).collect()] == ["r1"]
