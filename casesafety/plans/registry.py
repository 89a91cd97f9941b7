"""Registered queries over the derived tables, and the DuckDB text of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import round_half_even
from ..operators import agreement, bootstrap, classifier, integrity, pairing, reports, running, runs, scoring, validation, variants
from ..schemas import DIMENSIONS
from ..sources import cases as case_sources
from ..sources import predictions as prediction_sources
from ..sources.shared import shared_folder
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
N_BOOT = 5000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})  # 0.0 for -0.0


PRED, CASES, LINES, RAW, RESP = map(fx.duck, (fx.PREDICTIONS, fx.CASES, fx.LINES, fx.RAW_PREDICTIONS, fx.RESPONSES))
RAW_SUM = " + ".join(DIMENSIONS)
PENALTY = "(greatest(danger_minor, 0) + 3 * greatest(danger_moderate, 0) + 6 * greatest(danger_severe, 0))"
SCORED = f"SELECT *, {RAW_SUM} AS raw_score, CAST({PENALTY} AS DOUBLE) AS danger_penalty, 100.0::DOUBLE * greatest(0.0::DOUBLE, {RAW_SUM} - {PENALTY}) / 12 AS cscs FROM ({PRED})"
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
GRAMS = f"SELECT response_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT response_id, {TOKENS} AS t FROM ({RESP}))"
COUNTS = f"SELECT response_id, term, count(*) AS tf FROM ({GRAMS}) GROUP BY response_id, term"
VOCABULARY = f"SELECT term, df, tf, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM ({COUNTS}) GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 30000)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return fx.derived(spark, d, fx.PREDICTIONS)


def scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(predictions(spark, d))


def cases(spark: SparkSession, d: str) -> DataFrame:
    return fx.derived(spark, d, fx.CASES)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return fx.derived(spark, d, fx.LINES)


def raw_predictions(spark: SparkSession, d: str) -> DataFrame:
    return fx.derived(spark, d, fx.RAW_PREDICTIONS)


def responses(spark: SparkSession, d: str) -> DataFrame:
    return fx.derived(spark, d, fx.RESPONSES)


# Sources and record rules.
@query(
    "parse_cases",
    f"""SELECT line_no, line ->> '$.case_id' AS case_id, line ->> '$.anchor_id' AS anchor_id, line ->> '$.source_type' AS source_type, line ->> '$.domain' AS domain,
    line ->> '$.variant' AS variant, line ->> '$.vignette' AS vignette, array_to_string(CAST(line ->> '$.reference_management[*]' AS VARCHAR[]), ',') AS reference_management
    FROM ({LINES}) WHERE json_valid(line) AND json_type(line) = 'OBJECT'""",
)
def parse_cases(spark, d):
    parsed = case_sources.parse_cases(lines(spark, d))
    return parsed.select("line_no", "case_id", "anchor_id", "source_type", "domain", "variant", "vignette", F.coalesce(F.array_join("reference_management", ","), F.lit("")).alias("reference_management"))


def _shards(spark, d) -> DataFrame:
    """The lines, written as shards to the shared folder and read back: (place, line), place by shard and line number over all shards."""
    path = shared_folder(spark, "shards")
    whole = lines(spark, d)
    whole.repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select("line").write.text(path)
    return case_sources.read_case_lines(spark, path, "part-*.txt")


@query("read_case_lines", f"SELECT CAST(row_number() OVER (ORDER BY line_no) AS INTEGER) AS place, line FROM ({LINES})")
def read_case_lines(spark, d):
    read = _shards(spark, d)
    sizes = read.groupBy("path").agg(F.max("line_no").alias("size"))
    before = sizes.select(F.col("path").alias("shard"), (F.sum("size").over(Window.orderBy("path")) - F.col("size")).alias("before"))  # a row for each shard
    return read.join(F.broadcast(before), F.col("path") == F.col("shard")).select((F.col("before") + F.col("line_no")).cast("int").alias("place"), "line")


@query("shards_exist", f"SELECT count(*) AS lines FROM ({LINES})")
def shards_exist(spark, d):
    read = _shards(spark, d)
    case_sources.assert_shards_exist(read)
    return read.agg(F.count("*").alias("lines"))


_ANCHOR_ROWS = """SELECT concat('A', cast(c_custkey AS varchar(20))) AS anchor_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS domain, concat('"', c_name, '", ', c_mktsegment) AS title, concat('https://example.org/', cast(c_custkey AS varchar(20))) AS url,
    cast(c_nationkey AS varchar(20)) AS pmcid, concat('first line, ', c_name, chr(10), 'second "line"') AS source_summary, c_name AS candidate_diagnosis FROM {customer}"""


@query("read_anchors", fx.duck(_ANCHOR_ROWS))
def read_anchors(spark, d):
    path = shared_folder(spark, "anchors")
    fx.derived(spark, d, _ANCHOR_ROWS).write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", None).option("emptyValue", "").csv(path)
    return case_sources.read_anchors(spark, path)


_GUIDELINE_ROWS = "SELECT concat('G', cast(n_nationkey AS varchar(20))) AS guideline_id, n_name AS organization, concat(n_name, ', ', n_name) AS title, cast(1990 + n_nationkey AS int) AS year, concat('https://example.org/', cast(n_regionkey AS varchar(20))) AS url, 'control' AS use FROM {nation}"


@query("read_guidelines", fx.duck(_GUIDELINE_ROWS))
def read_guidelines(spark, d):
    path = shared_folder(spark, "guidelines")
    fx.derived(spark, d, _GUIDELINE_ROWS).write.option("header", True).csv(path)
    return case_sources.read_guidelines(spark, path)


_RAW_COLUMNS = ("case_id", "model_id", "run_id", *DIMENSIONS, "danger_minor", "danger_moderate", "danger_severe")


@query("read_predictions", f"SELECT {', '.join(f'nullif({c}, {chr(39) * 2}) AS {c}' for c in _RAW_COLUMNS)} FROM ({RAW})")
def read_predictions(spark, d):
    """White space around a value stays."""
    path = shared_folder(spark, "predictions")
    raw_predictions(spark, d).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return prediction_sources.read_predictions(spark, path)


@query("write_scores", f"""SELECT case_id, model_id, run_id, round_even(cscs, 2) AS cscs, '{{"minor":1,"moderate":3,"severe":6}}' AS weights FROM ({SCORED})""")
def write_scores(spark, d):
    path = shared_folder(spark, "scores")
    prediction_sources.write_scores(scores(spark, d), path)
    return spark.read.parquet(path)


@query("write_batches", f"""SELECT case_id, model_id, run_id, round_even(cscs, 2) AS cscs, CAST(CASE WHEN model_id = 'm0' THEN 0 ELSE 1 END AS BIGINT) AS batch FROM ({SCORED})""")
def write_batches(spark, d):
    """Two batches; the second is written twice, with other rows first."""
    path = shared_folder(spark, "batches")
    written = prediction_sources.written_scores(scores(spark, d)).drop("weights")
    for batch, model in ((0, "m0"), (1, "m0"), (1, "m1")):
        prediction_sources.write_batch(written.where(F.col("model_id") == model), path, batch)
    return prediction_sources.read_batches(spark, path)


_OBJECT = f"l AS (SELECT *, CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN line END AS j FROM ({LINES}))"
_HAS = "list_contains(json_keys(j), '{0}')"


def _rule(rule: str, field: str, condition: str) -> str:
    return f"SELECT path, line_no, j ->> '$.case_id' AS case_id, '{rule}' AS rule, {field} AS field FROM l WHERE {condition}"


_REQUIRED = "list_sort(list_filter(['case_id', 'domain', 'source_type', 'variant', 'vignette'], lambda x: NOT list_contains(json_keys(j), x)))"
RULE_SQL = {
    "blank_line": _rule("blank_line", "''", "trim(line) = ''"),
    "malformed_json": _rule("malformed_json", "''", "trim(line) <> '' AND j IS NULL"),
    "missing_required": _rule("missing_required", f"array_to_string({_REQUIRED}, ',')", f"j IS NOT NULL AND len({_REQUIRED}) > 0"),
    "bad_enum": " UNION ALL ".join(_rule("bad_enum", f"'{x}'", f"{_HAS.format(x)} AND coalesce(j ->> '$.{x}', '?') NOT IN {allowed}") for x, allowed in (("source_type", "('case_report_derived', 'guideline_control')"), ("variant", "('base', 'missing_critical', 'counterfactual', 'guideline_control')"))),
    "bad_type_string": " UNION ALL ".join(_rule("bad_type_string", f"'{x}'", f"{_HAS.format(x)} AND json_type(j, '$.{x}') <> 'VARCHAR'") for x in ("case_id", "domain", "vignette")),
    "bad_type_nullable": " UNION ALL ".join(_rule("bad_type_nullable", f"'{x}'", f"{_HAS.format(x)} AND json_type(j, '$.{x}') NOT IN ('VARCHAR', 'NULL')") for x in ("anchor_id", "reference_diagnosis")),
    "bad_array_items": " UNION ALL ".join(_rule("bad_array_items", f"'{x}'", f"{_HAS.format(x)} AND (json_type(j, '$.{x}') <> 'ARRAY' OR len(list_filter(json_type(j, '$.{x}[*]'), lambda t: t <> 'VARCHAR')) > 0)") for x in ("reference_management", "critical_features", "danger_if_missed")),
    "empty_value": " UNION ALL ".join(_rule("empty_value", f"'{x}'", f"j ->> '$.{x}' = ''") for x in ("case_id", "vignette")),
}


def _with_rules(*rules: str) -> str:
    return f"WITH {_OBJECT} " + " UNION ALL ".join(RULE_SQL[r] for r in rules)


def _violations(spark, d, *rules: str) -> DataFrame:
    found = validation.case_violations(lines(spark, d)).drop("message")
    return found.where(F.col("rule").isin(*rules)) if rules else found


for _name, _rules in {
    "case_violations": tuple(RULE_SQL),
    "malformed_lines": ("blank_line", "malformed_json"),
    "missing_required": ("missing_required",),
    "bad_enum": ("bad_enum",),
    "type_violations": ("bad_type_string", "bad_type_nullable", "bad_array_items"),
    "empty_value": ("empty_value",),
}.items():
    query(_name, _with_rules(*_rules))(lambda spark, d, r=_rules: _violations(spark, d, *r))


@query("first_violation", f"SELECT path, line_no, case_id, rule, field FROM ({_with_rules(*RULE_SQL)}) ORDER BY path, line_no, rule, field LIMIT 1")
def first_violation(spark, d):
    return validation.first_violation(validation.case_violations(lines(spark, d))).drop("message")


# Integrity of the whole set.
@query("duplicate_ids", f"SELECT case_id, count(*) AS n FROM (SELECT case_id FROM ({CASES}) UNION ALL SELECT concat(CASE WHEN doc_id % 7 = 6 THEN 'GC' ELSE 'CR' END, cast(doc_id AS varchar)) FROM documents WHERE doc_id % 50 = 0) GROUP BY case_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    again = fx.CASES + " WHERE doc_id % 50 = 0"
    return integrity.duplicate_ids(cases(spark, d).unionByName(fx.derived(spark, d, again)))


@query("row_count_check", f"SELECT CAST(110 AS BIGINT) AS expected, count(*) AS actual, count(*) = 110 AS ok FROM ({CASES})")
def row_count_check(spark, d):
    return integrity.row_count_check(cases(spark, d), 110)


@query("composition", " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM ({CASES}) GROUP BY {c}" for c in ("source_type", "variant", "domain")))
def composition(spark, d):
    return integrity.composition(cases(spark, d))


_ANCHORS = "SELECT DISTINCT anchor_id FROM ({0}) WHERE anchor_id IS NOT NULL AND cast(substr(anchor_id, 2) AS bigint) % 5 <> 0 UNION ALL SELECT 'A-EXTRA' AS anchor_id"
_USED = f"SELECT DISTINCT anchor_id FROM ({CASES}) WHERE source_type = 'case_report_derived' AND anchor_id IS NOT NULL"


def anchors(spark, d):
    return fx.derived(spark, d, _ANCHORS.replace("{0}", fx.CASES))


@query("anchor_set_diff", f"SELECT anchor_id, 'cases' AS side FROM (({_USED}) EXCEPT ({_ANCHORS.format(CASES)})) UNION ALL SELECT anchor_id, 'manifest' AS side FROM (({_ANCHORS.format(CASES)}) EXCEPT ({_USED}))")
def anchor_set_diff(spark, d):
    return integrity.anchor_set_diff(cases(spark, d), anchors(spark, d))


@query(
    "incomplete_triplets",
    f"""SELECT * FROM (SELECT anchor_id, count(*) FILTER (variant = 'base') AS n_base, count(*) FILTER (variant = 'missing_critical') AS n_missing, count(*) FILTER (variant = 'counterfactual') AS n_cf,
    count(*) FILTER (variant NOT IN ('base', 'missing_critical', 'counterfactual')) AS n_other FROM ({CASES}) WHERE source_type = 'case_report_derived' GROUP BY anchor_id)
    WHERE anchor_id IS NULL OR NOT (n_base = 1 AND n_missing = 1 AND n_cf = 1 AND n_other = 0)""",
)
def incomplete_triplets(spark, d):
    return integrity.incomplete_triplets(cases(spark, d))


@query("control_violations", f"SELECT case_id, source_type, variant, anchor_id FROM ({CASES}) WHERE source_type IS DISTINCT FROM 'case_report_derived' AND NOT (source_type = 'guideline_control' AND variant = 'guideline_control' AND anchor_id IS NULL)")
def control_violations(spark, d):
    return integrity.control_violations(cases(spark, d))


@query(
    "count_checks",
    f"""WITH c AS (SELECT count(DISTINCT anchor_id) FILTER (source_type = 'case_report_derived') AS a, count(*) FILTER (source_type = 'guideline_control') AS g FROM ({CASES}))
    SELECT 'anchors' AS name, CAST(30 AS BIGINT) AS expected, a AS actual, a = 30 AS ok FROM c UNION ALL SELECT 'controls', CAST(20 AS BIGINT), g, g = 20 FROM c""",
)
def count_checks(spark, d):
    return integrity.count_checks(cases(spark, d), 30, 20)


@query("guideline_orphans", f"SELECT case_id, guideline_id FROM (SELECT case_id, unnest(['en', reference_diagnosis]) AS guideline_id FROM ({CASES}) WHERE variant = 'guideline_control') WHERE guideline_id NOT IN ('en', 'de', 'fr')")
def guideline_orphans(spark, d):
    referring = cases(spark, d).where("variant = 'guideline_control'").withColumn("guideline_refs", F.array(F.lit("en"), F.col("reference_diagnosis")))
    manifest = spark.sql("SELECT explode(array('en', 'de', 'fr')) AS guideline_id")
    return integrity.guideline_ref_orphans(referring, manifest)


# An anchor's record, as its first base case has it; every seventh differs.
_ANCHOR_RECORDS = "SELECT anchor_id, domain, url, CASE WHEN cast(substr(anchor_id, 2) AS bigint) % 7 = 0 THEN 'other' ELSE source_summary END AS source_summary, candidate_diagnosis FROM (SELECT anchor_id, min(domain) AS domain, min(concat('u', anchor_id)) AS url, min(vignette) AS source_summary, min(reference_diagnosis) AS candidate_diagnosis FROM ({0}) WHERE variant = 'base' GROUP BY anchor_id)"
_FULL_CASES = "SELECT *, concat('u', anchor_id) AS source_url FROM ({0})"


def _derived_from_cases(spark, d, sql: str) -> DataFrame:
    return fx.derived(spark, d, sql.replace("{0}", fx.CASES))


@query(
    "anchor_consistency",
    f"""WITH c AS ({_FULL_CASES.format(CASES)}), a AS ({_ANCHOR_RECORDS.format(CASES)}), j AS (SELECT c.case_id, c.anchor_id, c.domain IS DISTINCT FROM a.domain AS d, c.source_url IS DISTINCT FROM url AS u, vignette IS DISTINCT FROM source_summary AS v,
    reference_diagnosis IS DISTINCT FROM candidate_diagnosis AS r FROM c JOIN a ON c.anchor_id = a.anchor_id WHERE variant = 'base')
    SELECT case_id, anchor_id, 'domain' AS field FROM j WHERE d UNION ALL SELECT case_id, anchor_id, 'source_url' FROM j WHERE u UNION ALL SELECT case_id, anchor_id, 'vignette' FROM j WHERE v UNION ALL SELECT case_id, anchor_id, 'reference_diagnosis' FROM j WHERE r""",
)
def anchor_consistency(spark, d):
    return integrity.anchor_consistency(_derived_from_cases(spark, d, _FULL_CASES), _derived_from_cases(spark, d, _ANCHOR_RECORDS))


# Base cases with features and a change each, one for an anchor.
_BASES = "SELECT concat('CR', cast(doc_id AS varchar(20)), '-BASE') AS case_id, concat('A', cast(doc_id AS varchar(20))) AS anchor_id, 'case_report_derived' AS source_type, source AS domain, 'base' AS variant, text AS vignette, lang AS reference_diagnosis, concat('feature ', lang) AS feature, CASE WHEN doc_id % 5 > 0 THEN concat('change ', source) END AS change FROM {documents}"
_BASES_SQL = fx.duck(_BASES)


def _expanded(spark, d) -> tuple[DataFrame, DataFrame]:
    base = fx.derived(spark, d, _BASES).withColumns({"critical_features": F.array("feature", F.lit("second")), "reference_management": F.array(F.lit("m")), "danger_if_missed": F.array(F.lit("x")), "source_url": F.col("anchor_id")})
    edits = base.select("anchor_id", F.lit(None).cast("string").alias("withheld_feature"), F.col("change").alias("counterfactual_change"))
    return base.drop("feature", "change"), variants.expand_variants(base.drop("feature", "change"), edits)


_EXPANDED = f"""SELECT replace(case_id, '-BASE', '-MISS') AS case_id, anchor_id, 'missing_critical' AS variant, vignette || ' The case record does not report ' || feature || '.' AS vignette, feature AS withheld_feature, CAST(NULL AS VARCHAR) AS counterfactual_change, domain, reference_diagnosis FROM ({_BASES_SQL})
    UNION ALL SELECT replace(case_id, '-BASE', '-CF'), anchor_id, 'counterfactual', vignette || ' Same case, except: ' || change || '.', NULL, change, domain, reference_diagnosis FROM ({_BASES_SQL}) WHERE change IS NOT NULL"""


@query("expand_variants", f"SELECT case_id, anchor_id, variant, vignette, withheld_feature, counterfactual_change FROM ({_EXPANDED})")
def expand_variants(spark, d):
    return _expanded(spark, d)[1].select("case_id", "anchor_id", "variant", "vignette", "withheld_feature", "counterfactual_change")


@query(
    "variant_pairs",
    f"""WITH o AS (SELECT case_id, anchor_id, CASE WHEN length(vignette) % 3 = 0 THEN 1 ELSE 0 END AS t, CASE WHEN length(vignette) % 4 = 0 AND variant = 'missing_critical' THEN 1 ELSE 0 END AS w, variant FROM ({_EXPANDED}))
    SELECT case_id, anchor_id, 'domain' AS field FROM o WHERE t = 1 UNION ALL SELECT case_id, anchor_id, 'vignette' FROM o WHERE w = 1 UNION ALL SELECT case_id, anchor_id, 'withheld_feature' FROM o WHERE w = 1""",
)
def variant_pairs(spark, d):
    base, built = _expanded(spark, d)
    wrong = F.length("vignette") % 4 == 0
    changed = built.withColumns({"domain": F.when(F.length("vignette") % 3 == 0, F.concat("domain", F.lit("x"))).otherwise(F.col("domain")), "withheld_feature": F.when(wrong & (F.col("variant") == "missing_critical"), "none").otherwise(F.col("withheld_feature"))})
    return integrity.variant_pair_violations(base.withColumns({"withheld_feature": F.lit(None).cast("string"), "counterfactual_change": F.lit(None).cast("string")}).unionByName(changed))


# Scoring.
@query(
    "rating_violations",
    "SELECT case_id, model_id, run_id, dimension, value, CASE WHEN trim(value) = '' THEN 'missing' WHEN try_cast(value AS DOUBLE) IS NULL THEN 'not_a_number' ELSE 'out_of_range' END AS reason FROM ("
    + " UNION ALL ".join(f"SELECT case_id, model_id, run_id, '{x}' AS dimension, {x} AS value FROM ({RAW})" for x in DIMENSIONS)
    + ") WHERE NOT coalesce(try_cast(value AS DOUBLE) BETWEEN 0 AND 2, false)",
)
def rating_violations(spark, d):
    return scoring.rating_violations(raw_predictions(spark, d))


@query(
    "danger_count_violations",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT case_id, model_id, run_id, '{x}' AS level, danger_{x} AS value FROM ({RAW})" for x in ("minor", "moderate", "severe")) + ") WHERE value <> '' AND NOT regexp_matches(trim(value), '^[+-]?[0-9]+$')",
)
def danger_count_violations(spark, d):
    return scoring.danger_count_violations(raw_predictions(spark, d))


@query(
    "quarantined_score",
    f"""SELECT case_id, CAST(r AS DOUBLE) AS raw_score, CAST(p AS DOUBLE) AS danger_penalty, 100.0::DOUBLE * greatest(0.0::DOUBLE, r - p) / 12 AS cscs FROM (
    SELECT case_id, {" + ".join(f"try_cast({x} AS DOUBLE)" for x in DIMENSIONS)} AS r, greatest(coalesce(try_cast(danger_minor AS INT), 0), 0) + 6 * greatest(coalesce(try_cast(danger_severe AS INT), 0), 0) AS p, * FROM ({RAW})
    WHERE try_cast(diagnostic_reasoning AS DOUBLE) BETWEEN 0 AND 2 AND try_cast(uncertainty AS DOUBLE) BETWEEN 0 AND 2 AND danger_minor <> '2.0' AND danger_severe <> 'x')""",
)
def quarantined_score(spark, d):
    return scoring.score(raw_predictions(spark, d), on_error="quarantine").select("case_id", "raw_score", "danger_penalty", "cscs")


_LEVELS = fx.duck(fx.LEVELS)


@query("penalty_from_list", f"SELECT id, CASE WHEN bool_or(l = 'grave') THEN NULL ELSE CAST(sum(CASE l WHEN 'minor' THEN 1 WHEN 'moderate' THEN 3 ELSE 6 END) AS INTEGER) END AS penalty, bool_or(l = 'grave') AS unknown FROM (SELECT id, unnest(levels) AS l FROM ({_LEVELS})) GROUP BY id")
def penalty_from_list(spark, d):
    return fx.derived(spark, d, fx.LEVELS).select("id", scoring.danger_penalty_from_list(F.col("levels")).alias("penalty"), scoring.unknown_levels(F.col("levels")).alias("unknown"))


@query("score", f"SELECT case_id, model_id, run_id, raw_score, danger_penalty, cscs, round_even(cscs, 2) AS cscs_2 FROM ({SCORED})")
def score(spark, d):
    return scores(spark, d).select("case_id", "model_id", "run_id", "raw_score", "danger_penalty", "cscs", round_half_even(F.col("cscs"), 2).alias("cscs_2"))


@query("mean_cscs_by_model", f"SELECT model_id, count(*) AS n, round(avg(cscs), 6) AS mean_cscs FROM ({SCORED}) GROUP BY model_id")
def mean_cscs_by_model(spark, d):
    return scores(spark, d).groupBy("model_id").agg(F.count("*").alias("n"), F.round(F.avg("cscs"), 6).alias("mean_cscs"))


@query("weights_constant_check", f"SELECT run_id, count(DISTINCT domain) AS n_weight_sets FROM ({PRED}) GROUP BY run_id HAVING count(DISTINCT domain) > 1")
def weights_constant_check(spark, d):
    return scoring.weights_constant_check(predictions(spark, d).select("run_id", F.struct(F.col("domain").alias("w")).alias("weights")))


# Joins.
_FACTS = f"SELECT DISTINCT case_id, anchor_id, domain, variant, source_type FROM ({PRED})"


def facts(spark, d):
    return predictions(spark, d).select("case_id", "anchor_id", "domain", "variant", "source_type").distinct()


@query("attach_cases", f"SELECT s.case_id, s.model_id, s.run_id, s.cscs, c.anchor_id, c.domain, c.variant, c.source_type FROM ({SCORED}) s JOIN ({_FACTS}) c ON s.case_id = c.case_id")
def attach_cases(spark, d):
    return pairing.attach_cases(scores(spark, d), facts(spark, d)).select("case_id", "model_id", "run_id", "cscs", "anchor_id", "domain", "variant", "source_type")


@query("unknown_cases", f"SELECT case_id, count(*) AS n FROM ({PRED}) WHERE case_id NOT IN (SELECT case_id FROM ({_FACTS}) WHERE variant <> 'base') GROUP BY case_id")
def unknown_cases(spark, d):
    return pairing.unknown_cases(predictions(spark, d), facts(spark, d).where("variant <> 'base'"))


_SOME = "NOT (model_id = 'm0' AND variant = 'base') AND domain <> '5-LOW'"


@query("unscored_cases", f"SELECT model_id, case_id FROM (SELECT DISTINCT model_id FROM ({PRED}) WHERE {_SOME}) m CROSS JOIN ({_FACTS}) c WHERE NOT EXISTS (SELECT 1 FROM ({PRED}) p WHERE {_SOME} AND p.model_id = m.model_id AND p.case_id = c.case_id)".replace("SELECT model_id, case_id FROM", "SELECT m.model_id, c.case_id FROM", 1))
def unscored_cases(spark, d):
    return pairing.unscored_cases(facts(spark, d), predictions(spark, d).where(_SOME))


_PAIRS = f"SELECT case_id, run_id, max(anchor_id) AS anchor_id, max(domain) AS domain, max(CASE WHEN model_id = 'm0' THEN cscs END) AS score_a, max(CASE WHEN model_id = 'm1' THEN cscs END) AS score_b FROM ({SCORED}) GROUP BY case_id, run_id"


def pairs(spark, d):
    return pairing.pair_models(scores(spark, d), "m0", "m1")


@query("pair_models", f"SELECT case_id, run_id, anchor_id, score_a, score_b FROM ({_PAIRS})")
def pair_models(spark, d):
    return pairs(spark, d)


_VARIANT_PAIRS = f"SELECT * FROM (SELECT anchor_id, model_id, run_id, max(CASE WHEN variant = 'base' THEN cscs END) AS \"left\", max(CASE WHEN variant = 'counterfactual' THEN cscs END) AS \"right\" FROM ({SCORED}) WHERE anchor_id IS NOT NULL GROUP BY ALL) WHERE \"left\" IS NOT NULL AND \"right\" IS NOT NULL"


@query("pair_variants", _VARIANT_PAIRS)
def pair_variants(spark, d):
    return variants.pair_variants(scores(spark, d))


@query("duplicate_predictions", f"SELECT case_id, model_id, run_id, count(*) AS n FROM (SELECT case_id, model_id, run_id FROM ({PRED}) UNION ALL SELECT case_id, model_id, run_id FROM ({PRED}) WHERE domain = '1-URGENT') GROUP BY ALL HAVING count(*) > 1")
def duplicate_predictions(spark, d):
    p = predictions(spark, d)
    return pairing.duplicate_predictions(p.unionByName(p.where("domain = '1-URGENT'")))


# Bootstrap.
_STATS = f"SELECT anchor_id AS cluster, sum(score_a - score_b) AS s, count(*) AS n FROM ({_PAIRS}) WHERE score_a IS NOT NULL AND score_b IS NOT NULL AND anchor_id IS NOT NULL GROUP BY anchor_id"


def _mixed(x: str) -> str:
    for shift, by in zip((16, 15), bootstrap.MIX, strict=True):
        x = f"((xor({x}, {x} >> {shift}) * {by}) & {bootstrap.MASK})"
    return f"xor({x}, {x} >> 15)"


def _number(text: str, slot: str) -> str:
    """A number of 32 bits of a digest's text and a slot."""
    keys = [f"CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT)" for at in (1, 9)]
    one, two = (_mixed(f"xor({k}, ({slot} * {by}) & {bootstrap.MASK})") for k, by in zip(keys, bootstrap.SPREAD, strict=True))
    return f"(({one} + {two}) & {bootstrap.MASK})"


def _drawn(stats: str, by: str = "") -> str:
    """Clusters c with their number k in order, and draws d of such numbers for each replicate."""
    key, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    one, two = (_mixed(f"xor({k}, (j * {by_}) & {bootstrap.MASK})") for k, by_ in zip(("one", "two"), bootstrap.SPREAD, strict=True))
    return f"""c AS (SELECT *, row_number() OVER ({part} ORDER BY cluster) - 1 AS k, count(*) OVER ({part}) AS size FROM ({stats})),
    h AS (SELECT {key}size, b, CAST('0x' || substr(md5('2026|' || b), 1, 8) AS BIGINT) AS one, CAST('0x' || substr(md5('2026|' || b), 9, 8) AS BIGINT) AS two FROM (SELECT DISTINCT {key}size FROM c WHERE size > 1), (SELECT unnest(range({N_BOOT})) AS b)),
    d AS (SELECT {key}b, ((({one} + {two}) & {bootstrap.MASK}) * size) >> 32 AS k FROM (SELECT *, unnest(range(size)) AS j FROM h))"""


def _draws(stats: str, by: str = "") -> str:
    same = f"AND d.{by} = c.{by}" if by else ""
    return f"""WITH {_drawn(stats, by)}
    SELECT {f"d.{by}, " if by else ""}b, round(sum(s), 6) / sum(n) AS diff FROM d JOIN c ON d.k = c.k {same} GROUP BY ALL"""


@query("cluster_stats", f"SELECT cluster, round(s, 6) + 0.0 AS s, n FROM ({_STATS})")
def cluster_stats(spark, d):
    return rounded(bootstrap.cluster_stats(pairs(spark, d)), "s")


@query("require_clusters", f"SELECT count(*) AS clusters FROM ({_STATS})")
def require_clusters(spark, d):
    return spark.createDataFrame([(bootstrap.require_clusters(bootstrap.cluster_stats(pairs(spark, d))),)], "clusters long")


@query("mean_difference", f"SELECT round(sum(s) / sum(n), 6) AS mean_difference FROM ({_STATS})")
def mean_difference(spark, d):
    return rounded(bootstrap.mean_difference(bootstrap.cluster_stats(pairs(spark, d))), "mean_difference")


@query("bootstrap_diffs", f"SELECT CAST(b AS INTEGER) AS b, round(diff, 6) + 0.0 AS diff FROM ({_draws(_STATS)})")
def bootstrap_diffs(spark, d):
    """Sums are rounded before they are divided, so that the order of their addition doesn't show."""
    sums = bootstrap.resampled_sums(bootstrap.cluster_stats(pairs(spark, d)), N_BOOT)
    return rounded(sums.select("b", (F.round("s", 6) / F.col("n")).alias("diff")), "diff")


@query("bootstrap_ci", f"SELECT (SELECT round(sum(s) / sum(n), 6) FROM ({_STATS})) AS mean_difference, round(quantile_cont(diff, 0.025), 6) AS ci_2_5, round(quantile_cont(diff, 0.975), 6) AS ci_97_5 FROM ({_draws(_STATS)})")
def bootstrap_ci(spark, d):
    return rounded(bootstrap.paired_cluster_bootstrap(pairs(spark, d), n_boot=N_BOOT), "mean_difference", "ci_2_5", "ci_97_5")


_STATS_BY = f"SELECT domain, anchor_id AS cluster, sum(score_a - score_b) AS s, count(*) AS n FROM ({_PAIRS}) WHERE score_a IS NOT NULL AND score_b IS NOT NULL AND anchor_id IS NOT NULL GROUP BY domain, anchor_id"


@query(
    "bootstrap_by_group",
    f"SELECT m.domain, round(mean_difference, 6) AS mean_difference, round(ci_2_5, 6) AS ci_2_5, round(ci_97_5, 6) AS ci_97_5 FROM (SELECT domain, sum(s) / sum(n) AS mean_difference FROM ({_STATS_BY}) GROUP BY domain) m JOIN (SELECT domain, quantile_cont(diff, 0.025) AS ci_2_5, quantile_cont(diff, 0.975) AS ci_97_5 FROM ({_draws(_STATS_BY, 'domain')}) GROUP BY domain) c ON m.domain = c.domain",
)
def bootstrap_by_group(spark, d):
    of = pairing.pair_models(scores(spark, d), "m0", "m1", carried=("domain",))
    return rounded(bootstrap.bootstrap_by_group(of, ("domain",), n_boot=N_BOOT), "mean_difference", "ci_2_5", "ci_97_5")


@query("bootstrap_counts", f"SELECT CAST(b AS INTEGER) AS b, count AS drawn FROM (SELECT unnest(range({N_BOOT})) AS b), (SELECT count(DISTINCT case_id) AS count FROM ({_PAIRS}) WHERE score_a IS NOT NULL AND score_b IS NOT NULL)")
def bootstrap_counts(spark, d):
    """Draws of each replicate when cases, dealt to blocks, are the clusters: as many as there are cases."""
    stats = bootstrap.cluster_stats(pairs(spark, d), "case_id").withColumn("one", F.lit(1.0))
    clusters = bootstrap.Clusters(spark, (), ("s", "n", "one"), None, bootstrap.written(stats, "clusters"))
    return bootstrap.replicates(clusters, N_BOOT).select("b", F.col("one").cast("long").alias("drawn"))


_PANEL = fx.duck(fx.PANEL)
_MODELS = range(4)
_TWO = [(i, j) for i in _MODELS for j in _MODELS if i < j]
_ITEMS = f"SELECT case_id, max(anchor_id) AS cluster, {', '.join(f'max(CASE WHEN model_id = {chr(39)}m{k}{chr(39)} THEN cscs END) AS m{k}' for k in _MODELS)} FROM ({_PANEL}) GROUP BY case_id"
_MODEL_SUMS = f"SELECT cluster, {', '.join(f'sum(m{k}) AS m{k}' for k in _MODELS)}, count(*) AS n FROM ({_ITEMS}) WHERE cluster IS NOT NULL AND {' AND '.join(f'm{k} IS NOT NULL' for k in _MODELS)} GROUP BY cluster"


def _each_two(of: str, more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {more}'m{i}' AS model_a, 'm{j}' AS model_b, (m{i} - m{j}) / n AS diff FROM {of}" for i, j in _TWO)


@query(
    "compare_models",
    f"""WITH {_drawn(_MODEL_SUMS)}, r AS (SELECT b, {', '.join(f'sum(m{k}) AS m{k}' for k in _MODELS)}, sum(n) AS n FROM d JOIN c ON d.k = c.k GROUP BY b), w AS (SELECT {', '.join(f'sum(m{k}) AS m{k}' for k in _MODELS)}, sum(n) AS n FROM c),
    p AS ({_each_two("r", "b, ")}), whole AS ({_each_two("w")}), q AS (SELECT model_a, model_b, stddev_samp(diff) AS se, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi FROM p GROUP BY ALL),
    k AS (SELECT model_a, model_b, whole.diff AS mean, se, lo, hi FROM whole JOIN q USING (model_a, model_b)), t AS (SELECT b, max(abs(diff - mean) / se) AS t FROM p JOIN k USING (model_a, model_b) GROUP BY b), z AS (SELECT quantile_cont(t, 0.95) AS z FROM t)
    SELECT model_a, model_b, round(mean, 6) AS mean_difference, round(lo, 6) AS ci_2_5, round(hi, 6) AS ci_97_5, round(mean - z * se, 5) AS low, round(mean + z * se, 5) AS high FROM k, z""",
)
def compare_models(spark, d):
    found = bootstrap.compare_models(fx.derived(spark, d, fx.PANEL), n_boot=N_BOOT)
    return rounded(rounded(found, "mean_difference", "ci_2_5", "ci_97_5"), "low", "high", places=5)


_WEIGHT = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in bootstrap.POISSON)
_WEIGHED = f"""WITH c AS ({_STATS}), u AS (SELECT s, n, b, {_number("'2026|' || cluster", "b")} AS u FROM c, (SELECT unnest(range({N_BOOT})) AS b)), w AS (SELECT s, n, b, {_WEIGHT} AS w FROM u)
    SELECT b, sum(w * s) / sum(w * n) AS diff FROM w GROUP BY b HAVING sum(w * n) > 0"""


@query("poisson_bootstrap", f"SELECT (SELECT round(sum(s) / sum(n), 6) FROM ({_STATS})) AS mean_difference, round(quantile_cont(diff, 0.025), 6) AS ci_2_5, round(quantile_cont(diff, 0.975), 6) AS ci_97_5 FROM ({_WEIGHED})")
def poisson_bootstrap(spark, d):
    return rounded(bootstrap.poisson_bootstrap(pairs(spark, d), n_boot=N_BOOT), "mean_difference", "ci_2_5", "ci_97_5")


# Text features and the classifier.
@query("tokenize", f"SELECT response_id, array_to_string({TOKENS}, ' ') AS tokens FROM ({RESP})")
def tokenize(spark, d):
    return responses(spark, d).select("response_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


@query("ngram_counts", COUNTS)
def ngram_counts(spark, d):
    return tx.term_counts(responses(spark, d), "response_id", "text")


@query("vocabulary", f"SELECT term, df, tf, CAST(idx AS INTEGER) AS idx FROM ({VOCABULARY})")
def vocabulary(spark, d):
    return tx.vocabulary_of_totals(tx.term_totals(responses(spark, d), "response_id", "text"))


@query("vocabulary_of_candidates", f"SELECT term, df, tf, CAST(idx AS INTEGER) AS idx FROM ({VOCABULARY})")
def vocabulary_of_candidates(spark, d):
    return tx.vocabulary_of_texts(responses(spark, d), "response_id", "text")


@query(
    "tfidf",
    f"""WITH c AS ({COUNTS}), v AS ({VOCABULARY}), n AS (SELECT count(*) AS n FROM ({RESP})), r AS (SELECT response_id, idx, c.tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM c JOIN v ON c.term = v.term, n)
    SELECT response_id, CAST(idx AS INTEGER) AS idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY response_id)), 6) AS value FROM r""",
)
def tfidf(spark, d):
    rows = responses(spark, d)
    vocab = tx.vocabulary_of_totals(tx.term_totals(rows, "response_id", "text"))
    return rounded(tx.tfidf(tx.term_counts(rows, "response_id", "text"), vocab, rows.count(), "response_id"), "value")


@query("class_weights", f"SELECT label, n, round(total / (classes * n), 6) AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS classes FROM ({RESP}) WHERE label IS NOT NULL GROUP BY label)")
def class_weights(spark, d):
    return rounded(classifier.class_weights(responses(spark, d)), "weight")


@query("fit_guard", f"SELECT label, count(*) AS n FROM ({RESP}) WHERE label IS NOT NULL GROUP BY label")
def fit_guard(spark, d):
    """The labels that training is allowed on."""
    every = responses(spark, d)
    classifier.fit_guard(every)
    return every.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@query("safety_predictions")
def safety_predictions(spark, d):
    """Fitted on the labelled responses; every document is scored."""
    every = responses(spark, d)
    return classifier.predict_safety(classifier.fit_safety_classifier(every), every)


# Reports.
@query(
    "score_summary",
    f"""SELECT model_id, domain, variant, CAST(GROUPING(model_id, domain, variant) AS INTEGER) AS "grouping", count(*) AS n, round(avg(cscs), 6) AS mean_cscs, round(stddev_samp(cscs), 6) AS sd_cscs, round(avg(raw_score), 6) AS mean_raw, round(avg(danger_penalty), 6) AS mean_penalty
    FROM ({SCORED}) GROUP BY GROUPING SETS ((model_id, domain, variant), (model_id, domain), (model_id, variant), (model_id))""",
)
def score_summary(spark, d):
    return rounded(reports.score_summary(scores(spark, d)), "mean_cscs", "sd_cscs", "mean_raw", "mean_penalty")


@query("dimension_means", f"SELECT model_id, {', '.join(f'round(avg({x}) / 2, 6) AS {x}' for x in DIMENSIONS)} FROM ({PRED}) GROUP BY model_id")
def dimension_means(spark, d):
    return rounded(reports.dimension_means(predictions(spark, d)), *DIMENSIONS)


def _rate(condition: str, name: str) -> str:
    return f"round(avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0 END), 6) AS {name}"


@query(
    "outcome_rates",
    f"""SELECT model_id, {_rate('disposition = 2', 'disposition_accuracy')}, round(avg(CASE WHEN variant = 'missing_critical' THEN CASE WHEN uncertainty = 2 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS appropriate_uncertainty,
    {_rate('danger_minor > 0 OR danger_moderate > 0 OR danger_severe > 0', 'dangerous_action_rate')}, {_rate('danger_minor > 0', 'minor_rate')}, {_rate('danger_moderate > 0', 'moderate_rate')}, {_rate('danger_severe > 0', 'severe_rate')} FROM ({PRED}) GROUP BY model_id""",
)
def outcome_rates(spark, d):
    return rounded(reports.outcome_rates(predictions(spark, d)), "disposition_accuracy", "appropriate_uncertainty", "dangerous_action_rate", "minor_rate", "moderate_rate", "severe_rate")


@query("cf_delta", f'SELECT model_id, count(*) AS n_pairs, round(avg("right" - "left"), 6) AS mean_delta FROM ({_VARIANT_PAIRS}) GROUP BY model_id')
def cf_delta(spark, d):
    return rounded(reports.counterfactual_delta(scores(spark, d)), "mean_delta")


@query("cf_sensitivity", f'SELECT model_id, count(*) AS n, {_rate(chr(34) + "right" + chr(34) + " < " + chr(34) + "left" + chr(34), "sensitivity")} FROM ({_VARIANT_PAIRS}) GROUP BY model_id')
def cf_sensitivity(spark, d):
    paired = variants.pair_variants(scores(spark, d)).withColumn("passed", F.col("right") < F.col("left"))
    return rounded(reports.counterfactual_sensitivity(paired), "sensitivity")


@query(
    "run_consistency",
    f"""SELECT model_id, count(*) AS n_cases, round(avg(runs), 6) AS mean_runs, round(avg(sd), 6) AS mean_sd, round(avg(spread), 6) AS mean_range, {_rate('vectors = 1', 'identical_share')} FROM (
    SELECT model_id, case_id, count(*) AS runs, stddev_samp(cscs) AS sd, max(cscs) - min(cscs) AS spread, count(DISTINCT concat_ws('|', {", ".join(DIMENSIONS)})) AS vectors FROM ({SCORED}) GROUP BY model_id, case_id) WHERE runs > 1 GROUP BY model_id""",
)
def run_consistency(spark, d):
    return rounded(reports.run_consistency(scores(spark, d)), "mean_runs", "mean_sd", "mean_range", "identical_share")


_LONG = " UNION ALL ".join(f"SELECT model_id, case_id, anchor_id, '{x}' AS dimension, {x} AS value FROM ({PRED})" for x in DIMENSIONS)
_VALUES = f"""v AS (SELECT model_id, dimension, case_id, value, max(anchor_id) AS cluster, count(*) AS n FROM ({_LONG}) GROUP BY ALL), k AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY model_id, dimension, case_id) AS m FROM v) WHERE m > 1)"""


def _alpha(rows: str) -> str:
    """Alpha of squared differences of the values x in ``rows`` (model_id, dimension, case_id, x, n)."""
    return f"""SELECT model_id, dimension, count(*) AS n_cases, sum(m) AS n_values, 1 - sum((m * xx - x * x) / (m - 1)) / ((sum(m) * sum(xx) - sum(x) * sum(x)) / (sum(m) - 1)) AS alpha
    FROM (SELECT model_id, dimension, case_id, CAST(sum(n) AS DOUBLE) AS m, sum(n * x) AS x, sum(n * x * x) AS xx FROM ({rows}) GROUP BY ALL) GROUP BY ALL"""


@query(
    "run_agreement",
    f"""WITH {_VALUES}, r AS (SELECT model_id, dimension, value, sum(total) OVER (PARTITION BY model_id, dimension ORDER BY value) - total / 2 AS x FROM (SELECT model_id, dimension, value, sum(n) AS total FROM k GROUP BY ALL)),
    a AS ({_alpha("SELECT *, value AS x FROM k")}), o AS ({_alpha("SELECT k.*, r.x FROM k JOIN r USING (model_id, dimension, value)")}),
    w AS (SELECT model_id, dimension, sum((m * m - same) / (m - 1)) AS within FROM (SELECT model_id, dimension, case_id, CAST(max(m) AS DOUBLE) AS m, sum(n * n) AS same FROM k GROUP BY ALL) GROUP BY ALL),
    z AS (SELECT model_id, dimension, CAST(sum(total) AS DOUBLE) AS n, sum(total * total) AS same FROM (SELECT model_id, dimension, value, sum(n) AS total FROM k GROUP BY ALL) GROUP BY ALL)
    SELECT model_id, dimension, a.n_cases, CAST(a.n_values AS BIGINT) AS n_values, round(a.alpha, 6) AS "interval", round(o.alpha, 6) AS ordinal, round(1 - within / ((n * n - same) / (n - 1)), 6) AS nominal
    FROM a JOIN o USING (model_id, dimension) JOIN w USING (model_id, dimension) JOIN z USING (model_id, dimension)""",
)
def run_agreement(spark, d):
    return rounded(agreement.agreement_of_scores(predictions(spark, d)), *agreement.METRICS)


@query(
    "running_report",
    f"SELECT model_id, strftime(evaluation_date, '%Y-%m-%d') AS evaluation_date, count(*) AS n, round(avg(cscs), 6) AS mean_cscs, round(stddev_samp(cscs), 6) AS sd_cscs, min(cscs) AS low, max(cscs) AS high, true AS cases_near, true AS median_near FROM ({SCORED}) GROUP BY ALL",
)
def running_report(spark, d):
    """Three states merged; the sketches are held to their bounds: 3 % of the number of cases, 2 % of the ranks."""
    every = running.kept(scores(spark, d).select(*running.KEYS, "case_id", "cscs"), shared_folder(spark, "scored"))  # each score is computed once
    parts = [running.kept(running.state_of(every.where(F.pmod(F.xxhash64("case_id"), F.lit(3)) == k)), shared_folder(spark, "state")) for k in range(3)]
    found = running.kept(running.report(running.merged(running.merged(parts[2], parts[0]), parts[1])), shared_folder(spark, "report"))
    same = [F.col("e.model_id") == F.col("f.model_id"), F.col("e.evaluation_date") == F.col("f.evaluation_date")]
    exact = every.alias("e").join(F.broadcast(found.select("model_id", "evaluation_date", "median")).alias("f"), same).groupBy("e.model_id", "e.evaluation_date").agg(
        F.count_distinct("case_id").alias("cases"), F.avg((F.col("cscs") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("cscs") <= F.col("median")).cast("double")).alias("upto")
    )
    met = found.join(exact, list(running.KEYS)).withColumns({"cases_near": F.abs(F.col("n_cases") - F.col("cases")) <= 0.03 * F.col("cases") + 1, "median_near": (F.col("below") <= 0.52) & (F.col("upto") >= 0.48)})
    return rounded(met.drop("n_cases", "median", "cases", "below", "upto"), "mean_cscs", "sd_cscs").withColumn("evaluation_date", F.date_format("evaluation_date", "yyyy-MM-dd"))


@query(
    "longitudinal",
    f"""SELECT model_id, CAST(evaluation_date AS VARCHAR)[1:10] AS evaluation_date, n, round(m, 6) AS mean_cscs, round(m - lag(m) OVER (PARTITION BY model_id ORDER BY evaluation_date), 6) AS change FROM (
    SELECT model_id, evaluation_date, count(*) AS n, avg(cscs) AS m FROM ({SCORED}) GROUP BY ALL)""",
)
def longitudinal(spark, d):
    return rounded(reports.longitudinal(scores(spark, d)), "mean_cscs", "change").withColumn("evaluation_date", F.date_format("evaluation_date", "yyyy-MM-dd"))


_RECORDS = fx.duck(fx.RECORDS)
_AS_OF = f"""SELECT s.*, r.evaluation_date AS record_date, r.prompt, r.retrieval_config, r.model_id IS NOT NULL AS known FROM (SELECT *, 100.0::DOUBLE * greatest(0.0::DOUBLE, {RAW_SUM} - {PENALTY}) / 12 AS cscs FROM ({fx.duck(fx.DATED)})) s
    ASOF LEFT JOIN (SELECT * FROM ({_RECORDS}) QUALIFY row_number() OVER (PARTITION BY model_id, evaluation_date ORDER BY prompt DESC) = 1) r ON s.model_id = r.model_id AND s.scored_on >= r.evaluation_date"""


def dated_scores(spark, d):
    return runs.as_of(scoring.score(fx.derived(spark, d, fx.DATED)), fx.derived(spark, d, fx.RECORDS), "scored_on")


@query("as_of_records", f"SELECT case_id, model_id, run_id, strftime(record_date, '%Y-%m-%d') AS record_date, prompt, retrieval_config FROM ({_AS_OF})")
def as_of_records(spark, d):
    return dated_scores(spark, d).select("case_id", "model_id", "run_id", F.date_format("record.evaluation_date", "yyyy-MM-dd").alias("record_date"), "record.prompt", "record.retrieval_config")


@query("longitudinal_by_record", f"SELECT model_id, strftime(record_date, '%Y-%m-%d') AS evaluation_date, n, round(m, 6) AS mean_cscs, round(m - lag(m) OVER (PARTITION BY model_id ORDER BY record_date), 6) AS change FROM (SELECT model_id, record_date, count(*) AS n, avg(cscs) AS m FROM ({_AS_OF}) WHERE known GROUP BY ALL)")
def longitudinal_by_record(spark, d):
    dated = runs.with_record_date(dated_scores(spark, d).drop("evaluation_date"))
    return rounded(reports.longitudinal(dated), "mean_cscs", "change").withColumn("evaluation_date", F.date_format("evaluation_date", "yyyy-MM-dd"))


#: Each case is asked twice, half a year apart, so that records with and without retrieval are met.
_TWICE = "CASE WHEN run_id = 'r0' THEN scored_on ELSE CAST(scored_on + INTERVAL 180 DAY AS DATE) END"
_RETRIEVAL = f"""SELECT * FROM (SELECT model_id, case_id, max(anchor_id) AS anchor_id, avg(CASE WHEN retrieval_config IS NOT NULL THEN cscs END) AS score_a, avg(CASE WHEN retrieval_config IS NULL THEN cscs END) AS score_b
    FROM ({_AS_OF.replace("s.scored_on >= r", _TWICE.replace("run_id", "s.run_id").replace("scored_on", "s.scored_on") + " >= r")}) WHERE known GROUP BY ALL)"""
_RETRIEVAL_STATS = f"SELECT model_id, anchor_id AS cluster, sum(score_a - score_b) AS s, count(*) AS n FROM ({_RETRIEVAL}) WHERE score_a IS NOT NULL AND score_b IS NOT NULL AND anchor_id IS NOT NULL GROUP BY ALL"


@query(
    "retrieval_effect",
    f"SELECT m.model_id, round(mean_difference, 6) AS mean_difference, round(ci_2_5, 6) AS ci_2_5, round(ci_97_5, 6) AS ci_97_5 FROM (SELECT model_id, sum(s) / sum(n) AS mean_difference FROM ({_RETRIEVAL_STATS}) GROUP BY model_id) m JOIN (SELECT model_id, quantile_cont(diff, 0.025) AS ci_2_5, quantile_cont(diff, 0.975) AS ci_97_5 FROM ({_draws(_RETRIEVAL_STATS, 'model_id')}) GROUP BY model_id) c ON m.model_id = c.model_id",
)
def retrieval_effect(spark, d):
    made = fx.derived(spark, d, fx.DATED).withColumn("scored_on", F.when(F.col("run_id") == "r0", F.col("scored_on")).otherwise(F.date_add("scored_on", 180)))
    known = runs.as_of(scoring.score(made), fx.derived(spark, d, fx.RECORDS), "scored_on")
    return rounded(runs.retrieval_effect(known, n_boot=N_BOOT), "mean_difference", "ci_2_5", "ci_97_5")


_RUNS = fx.duck(fx.RUNS)


@query("run_record_violations", f"SELECT model_id, 'provider' AS field FROM ({_RUNS}) WHERE provider IS NULL UNION ALL SELECT model_id, 'evaluation_date' FROM ({_RUNS}) WHERE evaluation_date IS NULL UNION ALL SELECT model_id, 'decoding_params' FROM ({_RUNS}) WHERE decoding IS NULL")
def run_record_violations(spark, d):
    records = fx.derived(spark, d, fx.RUNS)
    return reports.run_record_violations(records.withColumn("decoding_params", F.when(F.col("decoding").isNotNull(), F.create_map("decoding", F.lit("1")))))


@query("stewardship_by_target", f"SELECT antibiotic_target, model_id, count(*) AS n, round(avg(antibiotic_stewardship), 6) AS mean_stewardship FROM ({PRED}) WHERE source_type = 'guideline_control' AND antibiotic_target IS NOT NULL GROUP BY ALL")
def stewardship_by_target(spark, d):
    return rounded(reports.stewardship_by_target(predictions(spark, d)), "mean_stewardship")
