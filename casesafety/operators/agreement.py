"""Krippendorff's alpha between repeated runs, from sums by case; no runs are paired. Its use here is this library's own: the protocol asks for consistency without defining it.

A case that a model was run on m > 1 times gives m values. Alpha is 1 - D_o / D_e, the mean disagreement of two values of one case over that of any two
values. Cases whose values are alike give the same terms, so they are counted by their shape, that is, their different values with the times that each was given; the rest is done
on shapes. For squared differences both follow from counts, sums and sums of squares; for equal-or-not from the counts of equal values; for ordinal values
they are squared differences of mid-ranks, that is, of how many values are smaller plus half of those that are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DIMENSIONS
from ..sources.shared import shared_folder
from . import bootstrap

METRICS = ("interval", "ordinal", "nominal")


def case_values(scores: DataFrame, columns: tuple[str, ...] = DIMENSIONS, cluster: str = "anchor_id") -> DataFrame:
    """(model_id, dimension, case_id, cluster, value, n): how often a value was given for a case, of cases with more than one value. Null and NaN are no values."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("value")) for c in columns])
    long = scores.select("model_id", "case_id", F.col(cluster).alias("cluster"), F.explode(cells).alias("c")).select("model_id", "case_id", "cluster", "c.*")
    counted = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("model_id", "dimension", "case_id", "value").agg(F.max("cluster").alias("cluster"), F.count("*").alias("n"))
    of_case = Window.partitionBy("model_id", "dimension", "case_id")
    return counted.withColumns({"m": F.sum("n").over(of_case), "cluster": F.max("cluster").over(of_case)}).where("m > 1").select("model_id", "dimension", "case_id", "cluster", "value", "n", "m")


def shapes_of_values(values: DataFrame) -> DataFrame:
    """(model_id, dimension, shape, cases): how many cases have a shape, the sorted array of (value, n); from ``case_values``."""
    per = values.groupBy("model_id", "dimension", "case_id").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("shape"))
    return per.groupBy("model_id", "dimension", "shape").agg(F.count("*").alias("cases"))


def shapes_of_scores(scores: DataFrame, columns: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``shapes_of_values`` from scores. Rows are shuffled once, as they are: a case's different rows are counted, then cases with the same rows, and only these are taken apart by dimension."""
    cells = [F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)]
    rows = scores.select("model_id", "case_id", *cells).repartition("model_id", "case_id")
    alike = rows.groupBy("model_id", "case_id", *[f"v{k}" for k in range(len(columns))]).agg(F.count("*").alias("n"))
    row = F.struct(*[f"v{k}" for k in range(len(columns))], "n")
    whole = alike.groupBy("model_id", "case_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).groupBy("model_id", "rows").agg(F.count("*").alias("cases"))

    def shape(k: int):
        """The k-th values in order with how often they stand there; equal ones stand next to each other and are added up."""
        given = F.filter(F.transform("rows", lambda r: F.struct(r[f"v{k}"].alias("value"), r["n"].alias("n"))), lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]))
        return F.transform(F.array_sort(F.array_distinct(F.transform(given, lambda x: x["value"]))), lambda v: F.struct(v.alias("value"), F.aggregate(given, F.lit(0).cast("long"), lambda a, x: a + F.when(x["value"] == v, x["n"]).otherwise(0)).alias("n")))

    cut = whole.select("model_id", "cases", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), shape(k).alias("shape")) for k, c in enumerate(columns)])).alias("s"))
    some = cut.select("model_id", "s.dimension", "s.shape", "cases").where(F.aggregate("shape", F.lit(0).cast("long"), lambda a, x: a + x["n"]) > 1)
    return some.groupBy("model_id", "dimension", "shape").agg(F.sum("cases").alias("cases"))


def agreement_of_shapes(shapes: DataFrame) -> DataFrame:
    """``agreement`` from shapes, which are written once."""
    path = shared_folder(shapes.sparkSession, "shapes")
    shapes.where(F.col("model_id").isNotNull()).write.parquet(path)
    kept = shapes.sparkSession.read.schema(shapes.schema).parquet(path).withColumn("id", F.monotonically_increasing_id())
    keys = ("model_id", "dimension")
    values = kept.select(*keys, "id", "cases", F.inline("shape"))
    totals = values.groupBy(*keys, "value").agg(F.sum(F.col("cases") * F.col("n")).alias("all"))
    ranks = totals.select(*keys, "value", (F.sum("all").over(Window.partitionBy(*keys).orderBy("value")) - F.col("all") / 2).alias("rank"))  # few different values of a model and dimension

    def part(x) -> tuple:
        return F.sum(F.col("n") * x), F.sum(F.col("n") * x * x)

    (x, xx), (r, rr) = part(F.col("value")), part(F.col("rank"))
    per = values.join(ranks, [*keys, "value"]).groupBy(*keys, "id").agg(F.max("cases").alias("cases"), F.sum("n").alias("m"), x.alias("x"), xx.alias("xx"), r.alias("r"), rr.alias("rr"), F.sum(F.col("n") * F.col("n")).alias("same"))

    def all_of(c):
        return F.sum(F.col("cases") * c)

    m = F.col("m")
    squares = [((m * F.col(two) - F.col(one) * F.col(one)) / (m - 1)) for one, two in (("x", "xx"), ("r", "rr"))]
    whole = per.groupBy(*keys).agg(
        F.sum("cases").alias("n_cases"), all_of(m).alias("n"), *[all_of(F.col(c)).alias(c) for c in ("x", "xx", "r", "rr")], all_of(squares[0]).alias("x_within"), all_of(squares[1]).alias("r_within"),
        all_of((m * m - F.col("same")) / (m - 1)).alias("within"),
    )
    alike = totals.groupBy(*keys).agg(F.sum(F.col("all").cast("double") * F.col("all")).alias("same"))
    n = F.col("n").cast("double")

    def alpha(one: str, two: str):
        between = (n * F.col(two) - F.col(one) * F.col(one)) / (n - 1)
        return F.when(between > 1e-9 * n * F.col(two), 1 - F.col(f"{one}_within") / between)

    apart = (n * n - F.col("same")) / (n - 1)
    found = whole.join(alike, list(keys))
    return found.select(*keys, "n_cases", F.col("n").alias("n_values"), alpha("x", "xx").alias("interval"), alpha("r", "rr").alias("ordinal"), F.when(apart > 0, 1 - F.col("within") / apart).alias("nominal"))


def agreement(values: DataFrame) -> DataFrame:
    """(model_id, dimension, n_cases, n_values, interval, ordinal, nominal) from ``case_values``; alpha is null where all values are equal."""
    return agreement_of_shapes(shapes_of_values(values))


def agreement_of_scores(scores: DataFrame, columns: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``agreement`` from scores, without a row for each value of a case."""
    return agreement_of_shapes(shapes_of_scores(scores, columns))


def agreement_interval(values: DataFrame, n_boot: int = 5000, seed: int = 2026) -> DataFrame:
    """(model_id, dimension, alpha, ci_2_5, ci_97_5): alpha of squared differences with the interval of a bootstrap of the clusters, whose sums are the parts of alpha. Cases without a cluster take no part; replicates in which all values are equal don't count."""
    keys, parts = ("model_id", "dimension"), ("n", "x", "xx", "within")
    known = values.where(F.col("cluster").isNotNull() & F.col("model_id").isNotNull())
    per = known.groupBy(*keys, "cluster", "case_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("x"), F.sum(F.col("n") * F.col("value") * F.col("value")).alias("xx"))
    per = per.withColumn("within", (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) / (F.col("n") - 1))
    clusters = bootstrap.gathered(per.groupBy(*keys, "cluster").agg(*[F.sum(c).cast("double").alias(c) for c in parts]), keys, parts)
    between = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) / (F.col("n") - 1)
    alpha = F.when(between > 1e-9 * F.col("n") * F.col("xx"), 1 - F.col("within") / between)
    drawn = bootstrap.replicates(clusters, n_boot, seed).select(*keys, alpha.alias("diff")).where("diff is not null")
    return clusters.totals().select(*keys, alpha.alias("alpha")).join(bootstrap.percentile_ci(drawn, keys), list(keys))
