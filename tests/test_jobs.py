"""The jobs from files to tables; ``validate_cases`` has its test in test_cases.py."""

import json

import pytest
from pyspark.sql import functions as F

from casesafety.schemas import DIMENSIONS
from jobs import compare_models, report_outcomes, score_predictions, train_classifier

DANGER = ["danger_minor", "danger_moderate", "danger_severe"]


def test_score_predictions(spark, tmp_path):
    rows = ["k1,m,r,2,1,2,1,2,1,1,,", "k2,m,r,2,2,2,2,2,2,,,1"]
    (tmp_path / "p.csv").write_text("\n".join([",".join(["case_id", "model_id", "run_id", *DIMENSIONS, *DANGER]), *rows]) + "\n")
    score_predictions.main(str(tmp_path / "p.csv"), str(tmp_path / "out"))
    got = {r["case_id"]: (r["cscs"], json.loads(r["weights"])) for r in spark.read.parquet(str(tmp_path / "out/scores")).collect()}
    assert got == {"k1": (66.67, {"minor": 1, "moderate": 3, "severe": 6}), "k2": (50.0, {"minor": 1, "moderate": 3, "severe": 6})}
    (tmp_path / "bad.csv").write_text((tmp_path / "p.csv").read_text() + "k3,m,r,2,1,2,1,2,3,,,\nk4,m,r,2,1,2,1,2,2,,,x\n")
    with pytest.raises(Exception, match="bad rating or count: k[34]"):
        score_predictions.main(str(tmp_path / "bad.csv"), str(tmp_path / "raised"))
    assert spark.read.parquet(str(tmp_path / "raised/rating_violations")).first()["case_id"] == "k3"
    score_predictions.main(str(tmp_path / "bad.csv"), str(tmp_path / "kept"), "quarantine")
    assert spark.read.parquet(str(tmp_path / "kept/scores")).count() == 2 and spark.read.parquet(str(tmp_path / "kept/danger_count_violations")).first()["level"] == "severe"


def tables(spark, tmp_path, models="ab", dates=("2026-01-01",)):
    """Cases of three variants for each of eight anchors and a score of each model for each, by date."""
    variants = ("base", "missing_critical", "counterfactual")
    cases = [(f"c{a}{v[0]}", f"A{a}", "case_report_derived", f"d{a % 2}", v, None) for a in range(8) for v in variants] + [("g1", None, "guideline_control", "d0", "guideline_control", "indicated")]
    scores = []
    for d, date in enumerate(dates):
        for k, m in enumerate(models):
            for i, c in enumerate(cases):
                scores.append((c[0], m, f"r{d}", date, *[float((i + k + j) % 3) for j in range(6)], i % 2, 0, 0, float((i * 7 + k * 20 + d * 30) % 90), 8.0, 1.0))
    names = "case_id string, model_id string, run_id string, evaluation_date string, " + ", ".join(f"{x} double" for x in DIMENSIONS) + ", " + ", ".join(f"{x} int" for x in DANGER) + ", cscs double, raw_score double, danger_penalty double"
    frame = spark.createDataFrame(scores, names).withColumn("evaluation_date", F.col("evaluation_date").cast("date"))
    known = spark.createDataFrame(cases, "case_id string, anchor_id string, source_type string, domain string, variant string, antibiotic_target string")
    return frame, known


def saved(tmp_path, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(str(tmp_path / name))
    return [str(tmp_path / name) for name in frames]


def test_compare_models(spark, tmp_path):
    scores, cases = tables(spark, tmp_path, "abc")
    s, c = saved(tmp_path, scores=scores, cases=cases.union(cases.limit(1).withColumn("case_id", F.lit("open"))))
    compare_models.main(s, c, str(tmp_path / "two"), "a", "b")
    whole = spark.read.parquet(str(tmp_path / "two/all")).first()
    own = scores.join(cases.where("anchor_id is not null"), "case_id").groupBy().pivot("model_id").agg(F.avg("cscs")).first()
    assert whole["mean_difference"] == pytest.approx(own["a"] - own["b"]) and whole["ci_2_5"] <= whole["mean_difference"] <= whole["ci_97_5"]
    assert {r["domain"] for r in spark.read.parquet(str(tmp_path / "two/by_domain")).collect()} == {"d0", "d1"}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "two/unscored_cases")).collect()} == {(m, "open") for m in "abc"}
    compare_models.main(s, c, str(tmp_path / "every"))
    assert spark.read.parquet(str(tmp_path / "every/all")).count() == 3
    for name, bad in (("duplicate_predictions", scores.union(scores.limit(1))), ("unknown_cases", scores.withColumn("case_id", F.concat("case_id", F.lit("x"))))):
        (b,) = saved(tmp_path, bad=bad)
        with pytest.raises(ValueError, match=name):
            compare_models.main(b, c, str(tmp_path / name), "a", "b")
    (twice,) = saved(tmp_path, twice=cases.union(cases.limit(1)))
    with pytest.raises(ValueError, match="duplicate_cases"):
        compare_models.main(s, twice, str(tmp_path / "dc"), "a", "b")


def test_report_outcomes(spark, tmp_path):
    scores, cases = tables(spark, tmp_path, "ab", ("2026-01-05", "2026-02-05"))
    runs = [("a", "p", "2026-01-05", "x", None), ("a", "p", "2026-02-01", "x", "index"), ("b", None, "2026-01-01", "x", None), ("b", "p", "2026-03-01", "x", None)]
    records = spark.createDataFrame(runs, "model_id string, provider string, evaluation_date string, prompt string, retrieval_config string").withColumns({"evaluation_date": F.col("evaluation_date").cast("date"), "decoding_params": F.create_map(F.lit("t"), F.lit("1")), "n_runs": F.lit(1)})
    s, c, r = saved(tmp_path, scores=scores, cases=cases, runs=records)
    report_outcomes.main(s, c, r, str(tmp_path / "out"))
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    mean = {(m, d): v for m, d, v in scores.groupBy("model_id", "evaluation_date").agg(F.avg("cscs")).collect()}
    by_date = {(x["model_id"], str(x["evaluation_date"])): x for x in read("longitudinal").collect()}
    first, last = (mean["a", d] for d in sorted({d for _, d in mean}))
    assert set(by_date) == {("a", "2026-01-05"), ("a", "2026-02-01"), ("b", "2026-01-01")}
    assert by_date["a", "2026-01-05"]["mean_cscs"] == pytest.approx(first) and by_date["a", "2026-02-01"]["change"] == pytest.approx(last - first)
    assert by_date["b", "2026-01-01"]["n"] == 50
    assert [tuple(x) for x in read("run_record_violations").collect()] == [("b", "provider")]
    effect = read("retrieval_effect").collect()
    assert [x["model_id"] for x in effect] == ["a"]
    met = scores.join(cases.where("anchor_id is not null"), "case_id").where("model_id = 'a'").groupBy("run_id").agg(F.avg("cscs")).collect()
    assert effect[0]["mean_difference"] == pytest.approx(dict(map(tuple, met))["r1"] - dict(map(tuple, met))["r0"])
    assert read("score_summary").where("grouping = 3").count() == 2 and read("stewardship_by_target").count() == 2
    (undated,) = saved(tmp_path, undated=scores.drop("evaluation_date"))
    with pytest.raises(ValueError, match="model a has records of 2 dates"):
        report_outcomes.main(undated, c, r, str(tmp_path / "o2"))
    (one,) = saved(tmp_path, one=records.where("evaluation_date < '2026-01-06'"))
    report_outcomes.main(undated, c, one, str(tmp_path / "o3"))
    assert {x["n"] for x in spark.read.parquet(str(tmp_path / "o3/longitudinal")).collect()} == {50}
    (bad,) = saved(tmp_path, bad=scores.union(scores.limit(2)))
    with pytest.raises(ValueError, match="duplicate_predictions"):
        report_outcomes.main(bad, c, r, str(tmp_path / "o4"))


def test_train_classifier(spark, tmp_path):
    rows = [(i, f"call the clinic now {i % 7}" if i % 3 else f"wait it out {i % 7}", int(i % 3 == 0) if i % 5 else None) for i in range(60)]
    (r,) = saved(tmp_path, responses=spark.createDataFrame(rows, "response_id long, text string, label int"))
    train_classifier.main(r, str(tmp_path / "out"))
    got = {x["response_id"]: x["predicted"] for x in spark.read.parquet(str(tmp_path / "out/predictions")).collect()}
    assert len(got) == 60 and all(got[i] == int(i % 3 == 0) for i in range(60))
