"""Reading case shards and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

BLANK = r"^\s*$"
#: Splits whose starts are broadcast, at most: a hundred bytes each.
BROADCAST_SPLITS = 200_000


def read_case_lines(spark: SparkSession, path: str, glob: str = "cases-*.jsonl") -> DataFrame:
    """(path, line_no, line) of every shard, line numbers from 1.

    Shards are read in splits, however large they are. Ids rise within a split, so a line's number is its place there and
    the lines of the shard's splits before it, which are counted first, a number for each split. These few numbers are sent to the
    lines, so lines are not shuffled; beyond ``BROADCAST_SPLITS`` splits Spark chooses the join.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(at.alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = lines.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("at.path").orderBy("at.split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("at", "first", before.alias("before"))
    starts = F.broadcast(starts) if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS else starts
    return lines.join(starts, "at").select("at.path", (F.col("id") - F.col("first") + F.col("before") + 1).cast("int").alias("line_no"), "line")


def assert_shards_exist(lines: DataFrame) -> None:
    """Spark reads no rows where no file matches; that is an error here."""
    if lines.isEmpty():
        raise FileNotFoundError("no case shards found")


def with_parsed(lines: DataFrame) -> DataFrame:
    """``lines`` with the line as a VARIANT ``v`` and its ``keys``, both null unless it is a JSON object. Of a key given twice the last counts."""
    name, conf = "spark.sql.variant.allowDuplicateKeys", lines.sparkSession.conf
    before = conf.get(name)
    conf.set(name, "true")
    try:  # the option is read while the expression is resolved, here
        parsed = lines.withColumns({"v": F.try_parse_json("line"), "keys": F.json_object_keys("line")})
        parsed.schema  # noqa: B018
    finally:
        conf.set(name, before)
    whole = F.col("v").isNotNull() & F.col("keys").isNotNull()
    return parsed.withColumns({"v": F.when(whole, F.col("v")), "keys": F.when(whole, F.col("keys"))})


def parse_cases(lines: DataFrame, on_error: str = "skip") -> DataFrame:
    """Typed cases, with path and line_no where there are; blank lines are skipped.

    on_error: 'skip' leaves malformed lines out (``validation.case_violations`` reports them); 'raise' fails the job on the
    first line met that is malformed or lacks a required field, and names path, line and fields.
    """
    keep = [c for c in ("path", "line_no") if c in lines.columns]
    parsed = with_parsed(lines.where(~F.col("line").rlike(BLANK)))
    case = F.from_json("line", schemas.CASES)
    if on_error == "skip":
        parsed = parsed.where("keys is not null")
    else:
        missing = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, schemas.REQUIRED)), F.col("keys"))), ", ")
        what = F.when(F.col("keys").isNull(), "not a JSON object").otherwise(F.concat(F.lit("missing fields: "), missing))
        bad = F.raise_error(F.concat_ws(":", *[F.col(c).cast("string") for c in keep], F.concat(F.lit(" "), what)))
        case = F.when(F.col("keys").isNotNull() & (missing == ""), case).otherwise(bad)
    return parsed.select(*keep, case.alias("c")).select(*keep, "c.*")


def _manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    return _manifest(spark, path, schemas.ANCHORS)


def read_guidelines(spark: SparkSession, path: str) -> DataFrame:
    return _manifest(spark, path, schemas.GUIDELINES)
