"""spark-submit jobs/compare_models.py SCORES CASES OUT_DIR [MODEL...]: paired cluster bootstrap over all cases and by domain (both inputs Parquet).

Two models are compared over their common items; with more than two, or none named (all there are), each two of them are compared over the items that all have.
Predictions of unknown cases, repeated predictions and repeated cases are written to OUT_DIR and fail the job; cases that a model lacks are written.
"""

import sys

from pyspark.sql import SparkSession

from casesafety.operators import bootstrap, pairing


def main(scores_path: str, cases_path: str, out: str, *models: str) -> None:
    spark = SparkSession.builder.appName("compare_models").getOrCreate()
    cases, scores = spark.read.parquet(cases_path), spark.read.parquet(scores_path)
    pairing.write_and_require_none(pairing.pairing_faults(scores, cases), out)
    pairing.unscored_cases(cases, scores).write.mode("overwrite").parquet(f"{out}/unscored_cases")
    joined = pairing.attach_cases(scores, cases)
    if len(models) == 2:
        pairs = pairing.pair_models(joined, *models).join(cases.select("case_id", "domain"), "case_id").persist()
        bootstrap.paired_cluster_bootstrap(pairs).write.mode("overwrite").parquet(f"{out}/all")
        bootstrap.bootstrap_by_group(pairs, ("domain",)).write.mode("overwrite").parquet(f"{out}/by_domain")
        pairs.unpersist()
    else:
        bootstrap.compare_models(joined, list(models) or None).write.mode("overwrite").parquet(f"{out}/all")


if __name__ == "__main__":
    main(*sys.argv[1:])
