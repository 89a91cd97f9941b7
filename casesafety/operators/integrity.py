"""Rules over the whole set of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import COUNTERFACTUAL_TEMPLATE, MISSING_TEMPLATE, STRING_ARRAYS

DERIVED, CONTROL = "case_report_derived", "guideline_control"


def duplicate_ids(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")


def row_count_check(cases: DataFrame, expected: int) -> DataFrame:
    """(expected, actual, ok)."""
    return cases.agg(F.count("*").alias("actual")).select(F.lit(expected).cast("long").alias("expected"), "actual", (F.col("actual") == expected).alias("ok"))


def composition(cases: DataFrame, by: tuple[str, ...] = ("source_type", "variant", "domain")) -> DataFrame:
    """(field, value, n): one pass with a grouping set for each field; null values are counted, too."""
    n = len(by)
    sets = cases.groupingSets([[c] for c in by], *by).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    alone = lambda i: F.col("g") == (1 << n) - 1 - (1 << (n - 1 - i))
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(by):
        field, value = F.when(alone(i), F.lit(c)).otherwise(field), F.when(alone(i), F.col(c).cast("string")).otherwise(value)
    return sets.select(field.alias("field"), value.alias("value"), "n")


def anchor_set_diff(cases: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, side): 'cases' for anchors that only derived cases have, 'manifest' for those that only the manifest has."""
    used = cases.where(F.col("source_type") == DERIVED).select("anchor_id").where("anchor_id is not null").distinct()
    listed = anchors.select("anchor_id").where("anchor_id is not null").distinct()
    only = lambda a, b, side: a.join(b, "anchor_id", "left_anti").withColumn("side", F.lit(side))
    return only(used, listed, "cases").unionByName(only(listed, used, "manifest"))


def incomplete_triplets(cases: DataFrame) -> DataFrame:
    """(anchor_id, n_base, n_missing, n_cf, n_other) of anchors without exactly one of the three variants, or with another one.

    Derived cases without an anchor are reported as one group, of the null anchor; they are summed before they are shuffled.
    """
    is_a = lambda v: F.count_if(F.col("variant") == v)
    known = F.coalesce(F.col("variant").isin("base", "missing_critical", "counterfactual"), F.lit(False))
    per = cases.where(F.col("source_type") == DERIVED).groupBy("anchor_id").agg(is_a("base").alias("n_base"), is_a("missing_critical").alias("n_missing"), is_a("counterfactual").alias("n_cf"), F.count_if(~known).alias("n_other"))
    return per.where("anchor_id is null or not (n_base = 1 and n_missing = 1 and n_cf = 1 and n_other = 0)")


def control_violations(cases: DataFrame) -> DataFrame:
    """Rows that are not derived from case reports and aren't proper controls without an anchor."""
    derived = F.col("source_type").eqNullSafe(DERIVED)
    proper = F.col("source_type").eqNullSafe(CONTROL) & F.col("variant").eqNullSafe(CONTROL) & F.col("anchor_id").isNull()
    return cases.where(~derived & ~proper).select("case_id", "source_type", "variant", "anchor_id")


def count_checks(cases: DataFrame, expected_anchors: int, expected_controls: int) -> DataFrame:
    """(name, expected, actual, ok) for the number of anchors of derived cases and of controls."""
    derived = F.col("source_type") == DERIVED
    got = cases.agg(F.count_distinct(F.when(derived, F.col("anchor_id"))).alias("a"), F.count_if(F.col("source_type") == CONTROL).alias("c"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).cast("long").alias("expected"), F.col(c).alias("actual")) for n, e, c in (("anchors", expected_anchors, "a"), ("controls", expected_controls, "c"))])
    return got.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.expected") == F.col("r.actual")).alias("ok"))


def guideline_ref_orphans(cases: DataFrame, guidelines: DataFrame) -> DataFrame:
    """(case_id, guideline_id) of references that the manifest doesn't have; Spark broadcasts the manifest while it is small."""
    return cases.select("case_id", F.explode("guideline_refs").alias("guideline_id")).join(guidelines.select("guideline_id"), "guideline_id", "left_anti").select("case_id", "guideline_id")


def anchor_consistency(cases: DataFrame, anchors: DataFrame) -> DataFrame:
    """(case_id, anchor_id, field) where a base case differs from its anchor's record."""
    same = (("domain", "domain"), ("source_url", "url"), ("vignette", "source_summary"), ("reference_diagnosis", "candidate_diagnosis"))
    base = cases.where(F.col("variant") == "base").alias("c").join(anchors.alias("a"), F.col("c.anchor_id") == F.col("a.anchor_id"))
    wrong = F.filter(F.array(*[F.when(~F.col(f"c.{x}").eqNullSafe(F.col(f"a.{y}")), F.lit(x)) for x, y in same]), lambda f: f.isNotNull())
    return base.select("c.case_id", "c.anchor_id", F.explode(wrong).alias("field"))


def variant_pair_violations(cases: DataFrame) -> DataFrame:
    """(case_id, anchor_id, field) where a missing-information or counterfactual case doesn't follow from its base."""
    kept = ("domain", "source_url", "reference_diagnosis", *STRING_ARRAYS)
    base = cases.where((F.col("variant") == "base") & F.col("anchor_id").isNotNull())
    other = cases.where(F.col("variant").isin("missing_critical", "counterfactual"))
    pairs = other.alias("o").join(base.alias("b"), F.col("o.anchor_id") == F.col("b.anchor_id"))
    missing = F.col("o.variant") == "missing_critical"
    text = F.when(missing, F.concat(F.col("b.vignette"), F.lit(MISSING_TEMPLATE[0]), F.col("o.withheld_feature"), F.lit(MISSING_TEMPLATE[1])))
    text = text.otherwise(F.concat(F.col("b.vignette"), F.lit(COUNTERFACTUAL_TEMPLATE[0]), F.col("o.counterfactual_change"), F.lit(COUNTERFACTUAL_TEMPLATE[1])))
    checks = [F.when(~F.col(f"o.{x}").eqNullSafe(F.col(f"b.{x}")), F.lit(x)) for x in kept]
    checks += [
        F.when(~F.col("o.vignette").eqNullSafe(text), F.lit("vignette")),
        F.when(missing & ~F.coalesce(F.array_contains("b.critical_features", F.col("o.withheld_feature")), F.lit(False)), F.lit("withheld_feature")),
    ]
    return pairs.select("o.case_id", "o.anchor_id", F.explode(F.filter(F.array(*checks), lambda f: f.isNotNull())).alias("field"))
