"""spark-submit jobs/validate_cases.py CASES_DIR ANCHORS_CSV GUIDELINES_CSV OUT_DIR [CASES ANCHORS CONTROLS]: writes every violation, one table for each kind of rule.

Then it fails, with shard, line and reason, if a record is invalid, and with the table's name if a rule of the whole set is
broken or one of the numbers expected (of cases, anchors and controls) isn't met.
"""

import sys

from pyspark.sql import SparkSession

from casesafety.operators import integrity, validation
from casesafety.sources import cases as sources


def main(cases_dir: str, anchors_csv: str, guidelines_csv: str, out: str, *expected: str) -> None:
    spark = SparkSession.builder.appName("validate_cases").getOrCreate()
    lines = sources.read_case_lines(spark, cases_dir).persist()
    sources.assert_shards_exist(lines)
    cases = sources.parse_cases(lines).persist()
    anchors, guidelines = sources.read_anchors(spark, anchors_csv), sources.read_guidelines(spark, guidelines_csv)
    tables = {
        "violations": validation.case_violations(lines),
        "duplicate_ids": integrity.duplicate_ids(cases),
        "anchor_set_diff": integrity.anchor_set_diff(cases, anchors),
        "incomplete_triplets": integrity.incomplete_triplets(cases),
        "control_violations": integrity.control_violations(cases),
        "guideline_orphans": integrity.guideline_ref_orphans(cases, guidelines),
        "anchor_consistency": integrity.anchor_consistency(cases, anchors),
        "variant_pairs": integrity.variant_pair_violations(cases),
    }
    if expected:
        n_cases, n_anchors, n_controls = map(int, expected)
        tables["row_count"] = integrity.row_count_check(cases, n_cases).where("not ok")
        tables["counts"] = integrity.count_checks(cases, n_anchors, n_controls).where("not ok")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    integrity.composition(cases).write.mode("overwrite").parquet(f"{out}/composition")
    cases.unpersist()
    lines.unpersist()
    validation.require_valid(spark.read.parquet(f"{out}/violations"))
    broken = [name for name in tables if not spark.read.parquet(f"{out}/{name}").isEmpty()]
    if broken:
        raise ValueError(f"rules of the whole set are broken, see {out}: {', '.join(broken)}")


if __name__ == "__main__":
    main(*sys.argv[1:])
