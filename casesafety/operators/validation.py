"""Record rules. Every rule is one column, so a line is parsed once and all its violations are found in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources.cases import BLANK, with_parsed


def _found(condition: Column, rule: str, field: Column | str, message: str) -> Column:
    named = F.lit(field) if isinstance(field, str) else field
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), named.alias("field"), F.lit(message).alias("message")))


def record_rules(strict: bool = True) -> list[Column]:
    """Columns over (line, v variant, keys): a struct where the rule is broken, else null."""
    has = lambda x: F.array_contains("keys", x)
    value = lambda x: F.try_variant_get("v", f"$.{x}", "string")
    kind = lambda x: F.schema_of_variant(F.try_variant_get("v", f"$.{x}", "variant"))
    blank = F.col("line").rlike(BLANK)
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, schemas.REQUIRED)), F.col("keys")))
    rules = [_found(blank, "blank_line", "", "blank line")] if strict else []
    rules += [
        _found(~blank & F.col("keys").isNull(), "malformed_json", "", "not a JSON object"),
        _found(F.size(missing) > 0, "missing_required", F.array_join(missing, ","), "required fields are missing"),
    ]
    rules += [_found(has(x) & ~F.coalesce(value(x).isin(*allowed), F.lit(False)), "bad_enum", x, "value not allowed") for x, allowed in schemas.ENUMS.items()]
    rules += [_found(has(x) & (kind(x) != "STRING"), "bad_type_string", x, "not a string") for x in schemas.STRINGS]
    rules += [_found(has(x) & ~kind(x).isin("STRING", "VOID"), "bad_type_nullable", x, "neither a string nor null") for x in schemas.NULLABLE_STRINGS]
    for x in schemas.STRING_ARRAYS:
        items = F.try_variant_get("v", f"$.{x}", "array<variant>")
        other = F.exists(items, lambda i: F.schema_of_variant(i) != "STRING")
        rules.append(_found(has(x) & (~kind(x).startswith("ARRAY<") | F.coalesce(other, F.lit(False))), "bad_array_items", x, "not an array of strings"))
    rules += [_found(value(x) == "", "empty_value", x, "empty") for x in schemas.NOT_EMPTY]
    return rules


def case_violations(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(path, line_no, case_id, rule, field, message) for each broken rule of ``lines`` (path, line_no, line).

    ``strict`` reports blank lines, which are skipped otherwise. Of a key given twice in a record the last counts.
    """
    parsed = with_parsed(lines.select("path", "line_no", "line"))
    broken = F.explode(F.filter(F.array(*record_rules(strict)), lambda r: r.isNotNull())).alias("r")
    return parsed.select("path", "line_no", F.try_variant_get("v", "$.case_id", "string").alias("case_id"), broken).select("path", "line_no", "case_id", "r.*")


def first_violation(violations: DataFrame) -> DataFrame:
    """The violation of the smallest path and line (ties: rule, then field), as at most one row."""
    return violations.orderBy("path", "line_no", "rule", "field").limit(1)


def require_valid(violations: DataFrame) -> None:
    """An error that names shard, line, rule and field of the first violation, if there is one."""
    for r in first_violation(violations).collect():  # one row at most
        raise ValueError(f"{r['path']}:{r['line_no']}: {r['rule']} {r['field']} ({r['message']})")
