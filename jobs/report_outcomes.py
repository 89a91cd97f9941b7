"""spark-submit jobs/report_outcomes.py SCORES CASES RUNS OUT_DIR: every report on scored predictions (Parquet; scores with ratings and counts, runs with evaluation_date).

A score belongs to its model's run record of its own evaluation_date, or the last one before; without that column each model must have records of one date only.
Predictions of unknown cases, repeated predictions and repeated cases are written to OUT_DIR and fail the job.
"""

import sys

from pyspark.sql import SparkSession

from casesafety.operators import pairing, reports, runs, variants


def main(scores_path: str, cases_path: str, runs_path: str, out: str) -> None:
    spark = SparkSession.builder.appName("report_outcomes").getOrCreate()
    cases, records = spark.read.parquet(cases_path), spark.read.parquet(runs_path)
    scored = spark.read.parquet(scores_path)
    pairing.write_and_require_none(pairing.pairing_faults(scored, cases), out)
    scores = pairing.attach_cases(scored, cases).persist()
    targets = cases.select("case_id", "antibiotic_target")
    known = runs.records_by_model(scores, records)
    paired = variants.pair_variants(scores)
    tables = {
        "score_summary": reports.score_summary(scores),
        "dimension_means": reports.dimension_means(scores),
        "outcome_rates": reports.outcome_rates(scores),
        "counterfactual_delta": reports.counterfactual_delta(scores),
        "run_consistency": reports.run_consistency(scores),
        "longitudinal": reports.longitudinal(runs.with_record_date(known)),
        "run_record_violations": reports.run_record_violations(records),
        "stewardship_by_target": reports.stewardship_by_target(scores.join(targets, "case_id")),
        "variant_pairs": paired,
        "unscored_cases": pairing.unscored_cases(cases, scores),
    }
    if "retrieval_config" in records.columns:
        tables["retrieval_effect"] = runs.retrieval_effect(known)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    scores.unpersist()


if __name__ == "__main__":
    main(*sys.argv[1:])
