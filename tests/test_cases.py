import json

import pytest

from casesafety.operators import integrity, validation, variants
from casesafety.sources import cases as sources


def record(**kw):
    base = {"case_id": "CR1-BASE", "anchor_id": "A1", "source_type": "case_report_derived", "domain": "d", "variant": "base", "vignette": "Text one.", "reference_diagnosis": None, "reference_management": ["m"], "critical_features": ["f"], "danger_if_missed": ["x"]}
    return {k: v for k, v in (base | kw).items() if v != "absent"}


def shards(tmp_path, *files):
    for k, rows in enumerate(files):
        (tmp_path / f"cases-{k:04}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(tmp_path)


@pytest.mark.parametrize(
    ("change", "rule", "field"),
    [
        ({"source_type": "registry_extract"}, "bad_enum", "source_type"),
        ({"source_type": None}, "bad_enum", "source_type"),
        ({"variant": "baseline"}, "bad_enum", "variant"),
        ({"variant": 2}, "bad_enum", "variant"),
        ({"vignette": 7}, "bad_type_string", "vignette"),
        ({"domain": {"name": "d"}}, "bad_type_string", "domain"),
        ({"case_id": None}, "bad_type_string", "case_id"),
        ({"anchor_id": False}, "bad_type_nullable", "anchor_id"),
        ({"reference_diagnosis": ["d"]}, "bad_type_nullable", "reference_diagnosis"),
        ({"reference_management": [{"step": 1}]}, "bad_array_items", "reference_management"),
        ({"critical_features": [True]}, "bad_array_items", "critical_features"),
        ({"danger_if_missed": ["a", None]}, "bad_array_items", "danger_if_missed"),
        ({"critical_features": "f"}, "bad_array_items", "critical_features"),
        ({"case_id": ""}, "empty_value", "case_id"),
        ({"vignette": ""}, "empty_value", "vignette"),
        ({"domain": "absent"}, "missing_required", "domain"),
    ],
)
def test_one_mutation_breaks_one_rule(spark, tmp_path, change, rule, field):
    lines = sources.read_case_lines(spark, shards(tmp_path, [record()], [record(case_id="CR2"), record(**change)]))
    got = [(r["path"][-10:], r["line_no"], r["rule"], r["field"]) for r in validation.case_violations(lines).collect()]
    assert got == [("0001.jsonl", 2, rule, field)]
    assert validation.first_violation(validation.case_violations(lines)).first()["rule"] == rule


@pytest.mark.parametrize("change", [{}, {"critical_features": []}, {"critical_features": "absent"}, {"anchor_id": "absent"}, {"extra": 1}, {"vignette": " "}])
def test_allowed_records(spark, tmp_path, change):
    assert validation.case_violations(sources.read_case_lines(spark, shards(tmp_path, [record(**change)]))).count() == 0


def test_lines(spark, tmp_path):
    (tmp_path / "cases-1.jsonl").write_bytes(b'{"case_id": "a", "case_id": "b"}\r\n\r\n[1]\n{"case_id": \nlast')
    lines = sources.read_case_lines(spark, str(tmp_path))
    assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == [1, 2, 3, 4, 5]
    rules = {(r["line_no"], r["rule"]) for r in validation.case_violations(lines).collect()}
    assert rules == {(1, "missing_required"), (2, "blank_line"), (3, "malformed_json"), (4, "malformed_json"), (5, "malformed_json")}
    assert (2, "blank_line") not in {(r["line_no"], r["rule"]) for r in validation.case_violations(lines, strict=False).collect()}
    assert validation.case_violations(lines).where("line_no = 1").first()["case_id"] == "b"
    with pytest.raises(FileNotFoundError):
        sources.assert_shards_exist(sources.read_case_lines(spark, str(tmp_path), "none-*.jsonl"))


def test_line_numbers_run_over_splits(spark, tmp_path):
    for name, n in (("cases-1.jsonl", 5000), ("cases-2.jsonl", 37), ("other.jsonl", 3)):
        (tmp_path / name).write_bytes(b"".join(b"%d%s" % (k, b"\r\n" if k % 3 else b"\n") for k in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "999b")
    try:
        lines = sources.read_case_lines(spark, str(tmp_path))
        got = lines.collect()
        assert lines.rdd.getNumPartitions() > 4 and len(got) == 5037 and all(r["line"] == str(r["line_no"]) for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parsing_skips_or_raises(spark, tmp_path):
    lines = sources.read_case_lines(spark, shards(tmp_path, [record(), "[1]", "", '{"case_id": ', record(case_id="CR2", domain="absent")]))
    kept = sources.parse_cases(lines)
    assert [(r["line_no"], r["case_id"]) for r in kept.orderBy("line_no").collect()] == [(1, "CR1-BASE"), (5, "CR2")]
    assert integrity.control_violations(kept).count() == 0
    for line, what in ((2, "2: not a JSON object"), (4, "4: not a JSON object"), (5, "5: missing fields: domain")):
        with pytest.raises(Exception, match=what):
            sources.parse_cases(lines.where(f"line_no = {line}"), on_error="raise").collect()
    assert sources.parse_cases(lines.where("line_no = 1"), on_error="raise").count() == 1


def test_duplicate_keys_do_not_depend_on_the_session(spark, tmp_path):
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    found = validation.case_violations(sources.read_case_lines(spark, shards(tmp_path, ['{"case_id": "a", "case_id": "b"}'])))
    assert spark.conf.get(name) == before
    spark.conf.set(name, "false")
    assert [(r["rule"], r["case_id"]) for r in found.collect()] == [("missing_required", "b")]
    spark.conf.set(name, before)


def test_validation_job_fails_with_the_reason(spark, tmp_path):
    from jobs import validate_cases

    good = [record(case_id=f"CR1-{x}", variant=v, vignette="Text one." + e, **kw) for x, v, e, kw in (("BASE", "base", "", {}), ("MISS", "missing_critical", " The case record does not report f.", {"withheld_feature": "f"}), ("CF", "counterfactual", " Same case, except: g.", {"counterfactual_change": "g"}))]
    good += [record(case_id="G1", anchor_id=None, source_type="guideline_control", variant="guideline_control")]
    (tmp_path / "a.csv").write_text("anchor_id,domain,title,url,pmcid,source_summary,candidate_diagnosis\nA1,d,t,,p,Text one.,\n")
    (tmp_path / "g.csv").write_text("guideline_id,organization,title,year,url,use\n")

    def run(name, rows, *expected):
        (tmp_path / name).mkdir()
        validate_cases.main(shards(tmp_path / name, rows), str(tmp_path / "a.csv"), str(tmp_path / "g.csv"), str(tmp_path / f"{name}-out"), *expected)

    run("good", good, "4", "1", "1")
    with pytest.raises(ValueError, match=r"cases-0000.jsonl:5: bad_enum variant"):
        run("enum", [*good, record(case_id="CR9", variant="x")])
    with pytest.raises(ValueError, match="row_count"):
        run("count", good, "110", "1", "1")
    with pytest.raises(ValueError, match="duplicate_ids"):
        run("twice", [*good, good[0]])
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        validate_cases.main(str(tmp_path / "empty"), str(tmp_path / "a.csv"), str(tmp_path / "g.csv"), str(tmp_path / "o"))


def test_manifests(spark, tmp_path):
    (tmp_path / "a.csv").write_text('anchor_id,domain,title,url,pmcid,source_summary,candidate_diagnosis\nA1,d,"One, two",u,p,s,c\n')
    (tmp_path / "g.csv").write_text("guideline_id,organization,title,year,url,use\nG1,o,t,2020,u,x\n")
    assert sources.read_anchors(spark, str(tmp_path / "a.csv")).first()["title"] == "One, two"
    assert sources.read_guidelines(spark, str(tmp_path / "g.csv")).first()["year"] == 2020


def test_integrity(spark, tmp_path):
    rows = [record(case_id="CR1-BASE"), record(case_id="CR1-MISS", variant="missing_critical"), record(case_id="CR1-CF", variant="counterfactual"), record(case_id="CR2", anchor_id="A2"), record(case_id="CR2", anchor_id="A2"), record(case_id="G1", anchor_id="A9", source_type="guideline_control", variant="guideline_control", guideline_refs=["G1", "G2"])]
    cases = sources.parse_cases(sources.read_case_lines(spark, shards(tmp_path, rows)))
    assert [tuple(r) for r in integrity.duplicate_ids(cases).collect()] == [("CR2", 2)]
    assert integrity.row_count_check(cases, 6).first()["ok"] and not integrity.row_count_check(cases, 7).first()["ok"]
    assert [tuple(r) for r in integrity.incomplete_triplets(cases).collect()] == [("A2", 2, 0, 0, 0)]
    assert [r["case_id"] for r in integrity.control_violations(cases).collect()] == ["G1"]
    anchors = spark.createDataFrame([("A1",), ("A3",)], "anchor_id string")
    assert sorted(map(tuple, integrity.anchor_set_diff(cases, anchors).collect())) == [("A2", "cases"), ("A3", "manifest")]
    assert [tuple(r) for r in integrity.guideline_ref_orphans(cases, spark.createDataFrame([("G1",)], "guideline_id string")).collect()] == [("G1", "G2")]
    assert {(r["field"], r["value"]): r["n"] for r in integrity.composition(cases).collect()}["variant", "base"] == 3


def test_variants_follow_their_base(spark, tmp_path):
    cases = sources.parse_cases(sources.read_case_lines(spark, shards(tmp_path, [record()]))).drop("path", "line_no")
    edits = spark.createDataFrame([("A1", None, "the fever is gone")], "anchor_id string, withheld_feature string, counterfactual_change string")
    built = variants.expand_variants(cases, edits)
    assert {r["case_id"]: r["vignette"] for r in built.collect()} == {"CR1-MISS": "Text one. The case record does not report f.", "CR1-CF": "Text one. Same case, except: the fever is gone."}
    assert integrity.variant_pair_violations(cases.unionByName(built)).count() == 0
    assert [r["case_id"] for r in variants.expand_variants(cases).collect()] == ["CR1-MISS"]
