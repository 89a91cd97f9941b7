"""Paired cluster bootstrap of mean score differences.

A replicate draws as many clusters as there are, with replacement, and takes the mean over the drawn rows. Sums and
counts of each cluster suffice for that, so a replicate is a row of counts times the table of the clusters' sums; several models' sums
are more columns of that table.

Up to ``BROADCAST_CLUSTERS`` clusters go to every task, which draws whole replicates as arrays. A draw is a number of 32 bits made
of (seed, replicate, slot): two keys of 32 bits each from a digest of seed and replicate, mixed with the slot by two different
one-to-one functions and added up. So the interval is the same for any partitioning, replicates of different seeds have nothing in
common, and draws within a replicate repeat as chance has it.

More clusters are dealt to blocks by a hash, and how many of a replicate's draws fall into a block is dealt down a tree: at each
node a binomial of the draws there goes to the left half of its blocks. A node's numbers follow from (seed, node) alone, so each task finds
those of its block by itself; within the block the draws are made among its clusters. No row is made for a draw: a block gives one row of sums for each
replicate. The replicates aren't those of the other way, but are distributed alike, and are the same for any partitioning.

A group of ``by`` with fewer than two clusters has no interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder

#: Clusters that are broadcast to the draws at most.
BROADCAST_CLUSTERS = 1_000_000
#: Clusters of a block about, when there are more (so few that their counts stay in the cache); replicates whose counts are laid out at a time;
#: clusters that are weighed at a time; slots that are drawn at a time.
BLOCK, REPLICATES, CHUNK, SLOTS = 1 << 15, 64, 128, 1 << 14
#: Multipliers of a 32-bit mixing function and of the slots for either key; below 2^31 and 2^32, so that no product leaves 64 bits. Fixed values.
MIX, SPREAD, MASK = (569420461, 1935289751), (2654435769, 2246822519), 4294967295
#: A Poisson(1) weight is the number of these that a number of 32 bits reaches.
POISSON = tuple(int(2**32 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(12))


def drop_incomplete(pairs: DataFrame, cluster: str = "anchor_id", score_a: str = "score_a", score_b: str = "score_b") -> DataFrame:
    """Rows with both scores (null and NaN count as missing) and a cluster."""
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return pairs.where(there(score_a) & there(score_b) & F.col(cluster).isNotNull())


def cluster_stats(pairs: DataFrame, cluster: str = "anchor_id", by: tuple[str, ...] = (), score_a: str = "score_a", score_b: str = "score_b") -> DataFrame:
    """(by, cluster, s, n): the sum of differences and the rows of each cluster."""
    d = F.col(score_a) - F.col(score_b)
    return drop_incomplete(pairs, cluster, score_a, score_b).groupBy(*by, F.col(cluster).alias("cluster")).agg(F.sum(d).alias("s"), F.count("*").alias("n"))


def require_clusters(stats: DataFrame | Clusters, least: int = 2) -> int:
    """The number of clusters; an error if there are fewer than ``least``."""
    k = stats.count()
    if k < least:
        raise ValueError(f"need at least {least} clusters, found {k}")
    return k


def mean_difference(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean_difference) over rows, not over clusters."""
    return stats.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean_difference"))


def _mixed_array(x: np.ndarray) -> np.ndarray:
    """``x`` (of 32 bits, whose products wrap as under ``MASK``) mixed in its place."""
    for shift, by in zip((16, 15), MIX, strict=True):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(by)
    x ^= x >> np.uint32(15)
    return x


def _keys(text: Column) -> tuple[Column, Column]:
    """Two keys of 32 bits from a digest."""
    return tuple(F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long") for at in (1, 9))


def _number_array(keys: tuple, slots: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits of two keys and the slots."""
    one, two = (_mixed_array(np.asarray(k).astype(np.uint32) ^ (slots.astype(np.uint32) * np.uint32(by))) for k, by in zip(keys, SPREAD, strict=True))
    one += two
    return one


def _drawn_numbers(keys: tuple, size: int, out: np.ndarray) -> np.ndarray:
    """The clusters that a replicate draws, some slots at a time, so that what is worked on stays in the cache."""
    for at in range(0, size, SLOTS):
        end = min(size, at + SLOTS)
        drawn = _number_array(keys, np.arange(at, end, dtype=np.uint32)).astype(np.uint64)
        drawn *= np.uint64(size)
        drawn >>= np.uint64(32)
        out[at:end] = drawn
    return out[:size]


@dataclass(frozen=True)
class Clusters:
    """Sums ``values`` of each cluster, by group: as a local table in order, if there are few enough, else as a DataFrame."""

    spark: SparkSession
    by: tuple[str, ...]
    values: tuple[str, ...]
    local: pd.DataFrame | None
    stats: DataFrame

    def totals(self) -> DataFrame:
        """(by, values) summed up over the clusters."""
        if self.local is None or self.by:
            stats = self.stats if self.local is None else self.spark.createDataFrame(self.local.groupby(list(self.by), dropna=False, sort=False)[list(self.values)].sum().reset_index(), self.stats.select(*self.by, *self.values).schema)
            return stats.groupBy(*self.by).agg(*[F.sum(v).alias(v) for v in self.values])
        return self.spark.createDataFrame([tuple(self.local[v].sum().item() if len(self.local) else None for v in self.values)], self.stats.select(*self.values).schema)

    def count(self) -> int:
        return len(self.local) if self.local is not None else self.stats.count()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once, in parallel. On a cluster without such a folder it is kept on the executors' disks."""
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and df.sparkSession.sparkContext.master.split("[")[0] != "local":
        return df.persist(StorageLevel.DISK_ONLY)
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(stats: DataFrame, by: tuple[str, ...] = (), values: tuple[str, ...] = ("s", "n")) -> Clusters:
    """Computes ``stats`` (by, cluster, values) once and writes it. Not more clusters than are broadcast are read to the driver."""
    once = written(stats.select(*by, "cluster", *values), "clusters")
    spark = stats.sparkSession
    if once.count() > BROADCAST_CLUSTERS:
        return Clusters(spark, by, values, None, once)
    return Clusters(spark, by, values, once.toArrow().sort_by([(c, "ascending") for c in (*by, "cluster")]).to_pandas(), once)


def _drawn_in_arrays(clusters: Clusters, n_boot: int, seed: int) -> DataFrame:
    local, by, values, spark = clusters.local, clusters.by, clusters.values, clusters.spark
    table = local[list(values)].to_numpy(np.float64)
    groups = local.groupby(list(by), dropna=False, sort=False).indices if by else {(): np.arange(len(local))}
    spans = [np.sort(at) for at in groups.values() if len(at) > 1]
    kept = spark.sparkContext.broadcast((table, spans))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, spans = kept.value
        drawn, last, sums = np.empty(max(map(len, spans), default=0), np.int64), None, None
        for b in batches:
            out = np.empty((len(b), len(values)))
            for i, (group, one, two) in enumerate(zip(b["group"], b["one"], b["two"], strict=True)):
                if group != last:  # a group's replicates stand together
                    last, sums = group, np.ascontiguousarray(table[spans[group]].T)
                size = sums.shape[1]
                out[i] = sums @ np.bincount(_drawn_numbers((one, two), size, drawn), minlength=size).astype(np.float64)
            yield pd.DataFrame({"group": b["group"], "b": b["b"], **{v: out[:, j] for j, v in enumerate(values)}})

    key = _keys(F.concat(F.lit(f"{seed}|"), F.col("b").cast("string")))
    asked = spark.range(n_boot * len(spans)).select((F.col("id") % n_boot).cast("int").alias("b"), F.floor(F.col("id") / n_boot).cast("int").alias("group")).withColumns({"one": key[0], "two": key[1]})
    drawn = asked.mapInPandas(draw, f"group int, b int, {', '.join(f'`{v}` double' for v in values)}")
    if not by:
        return drawn.drop("group")
    groups_of = local.iloc[[int(at[0]) for at in spans]][list(by)].assign(group=range(len(spans)))
    labels = spark.createDataFrame(list(groups_of.itertuples(index=False, name=None)), T.StructType([*clusters.stats.select(*by).schema.fields, T.StructField("group", T.IntegerType())]))
    return drawn.join(F.broadcast(labels), "group").select(*by, "b", *values)


def _stream(seed: int, kind: int, at: int) -> np.random.Generator:
    """Random numbers that belong to a node (kind 0), or to a block's clusters (kind 1), of which there are many."""
    bits = np.random.SFC64 if kind else np.random.Philox
    return np.random.Generator(bits(np.random.SeedSequence((seed, kind, at))))


def _drawn_among(stream: np.random.Generator, size: int, n: int) -> np.ndarray:
    """``n`` of the numbers below ``size``, each as likely: the upper half of a number of 32 bits times ``size``; what falls below the remainder of 2^32 is drawn again."""
    product = stream.bit_generator.random_raw((n + 1) // 2).view(np.uint32)[:n].astype(np.uint64)
    product *= np.uint64(size)
    found = product >> np.uint64(32)
    product &= np.uint64(MASK)
    again = (1 << 32) % size
    if again and n and product.min() < again:
        bad = np.flatnonzero(product < again)
        found[bad] = stream.integers(size, size=len(bad))
    return found.view(np.int64)


def draws_of_block(sizes: np.ndarray, block: int, n_boot: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws fall into a block, when there are as many draws as clusters in blocks of these sizes."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    draws, lo, hi, node = np.full(n_boot, before[-1]), 0, len(sizes), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _stream(seed, 0, node).binomial(draws, (before[mid] - before[lo]) / max(1, before[hi] - before[lo]))
        if block < mid:
            draws, hi, node = left, mid, 2 * node
        else:
            draws, lo, node = draws - left, mid, 2 * node + 1
    return draws


def _drawn_by_counts(clusters: Clusters, n_boot: int, seed: int) -> DataFrame:
    by, values = clusters.by, clusters.values
    # A group's blocks follow from its number of clusters; the sizes of all of them go to each as an array.
    size = clusters.stats.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("clusters")).where("clusters > 1")
    met = clusters.stats.join(size, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else clusters.stats.join(F.broadcast(size))  # without groups one row
    dealt = met.select(*by, "cluster", *values, F.ceil(F.col("clusters") / BLOCK).cast("long").alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.col("cluster").cast("string")), F.col("blocks")).cast("int"))
    each = dealt.groupBy(*by, "blocks", "block").agg(F.count("*").alias("here"))
    sizes = each.groupBy(*by, "blocks").agg(F.sort_array(F.collect_list(F.struct("block", "here"))).alias("sizes"))
    told = sizes.select(*[F.col(c).alias(c) for c in (*by, "blocks", "sizes")], F.explode("sizes.block").alias("block"))

    def draw(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("cluster")
        known = right["sizes"].iloc[0]
        sizes = np.zeros(int(right["blocks"].iloc[0]), np.int64)
        for r in known:
            sizes[r["block"]] = r["here"]
        block, table = int(right["block"].iloc[0]), left[list(values)].to_numpy(np.float64)
        draws, stream, out = draws_of_block(sizes, block, n_boot, seed), _stream(seed, 1, block), np.empty((n_boot, len(values)))
        counts = np.empty((min(n_boot, REPLICATES), len(table)))
        for k in range(0, n_boot, REPLICATES):
            part = draws[k : k + REPLICATES]
            for i, n in enumerate(part):
                counts[i] = np.bincount(_drawn_among(stream, len(table), int(n)), minlength=len(table))
            out[k : k + REPLICATES] = counts[: len(part)] @ table
        return pd.DataFrame({**{c: [left[c].iloc[0]] * n_boot for c in by}, "b": np.arange(n_boot, dtype=np.int32), **{v: out[:, j] for j, v in enumerate(values)}})

    keys = [*by, "block"]
    schema = T.StructType([*clusters.stats.select(*by).schema.fields, T.StructField("b", T.IntegerType()), *[T.StructField(v, T.DoubleType()) for v in values]])
    sums = dealt.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(draw, schema)
    return sums.groupBy(*by, "b").agg(*[F.sum(v).alias(v) for v in values])


def replicates(clusters: Clusters, n_boot: int = 5000, seed: int = 2026) -> DataFrame:
    """(by, b, values): every replicate's sums."""
    return _drawn_by_counts(clusters, n_boot, seed) if clusters.local is None else _drawn_in_arrays(clusters, n_boot, seed)


def resampled_sums(stats: DataFrame | Clusters, n_boot: int = 5000, seed: int = 2026, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, b, s, n): every replicate's sums. Groups of ``by`` with fewer than two clusters are left out."""
    clusters = stats if isinstance(stats, Clusters) else gathered(stats, by)
    return replicates(clusters, n_boot, seed).withColumn("n", F.col("n").cast("long"))


def resample(stats: DataFrame | Clusters, n_boot: int = 5000, seed: int = 2026, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, b, diff): every replicate's mean difference. Groups of ``by`` with fewer than two clusters are left out."""
    return resampled_sums(stats, n_boot, seed, by).select(*by, "b", (F.col("s") / F.col("n")).alias("diff"))


def percentile_ci(diffs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ci_2_5, ci_97_5) with linear interpolation."""
    return diffs.groupBy(*by).agg(F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*by, F.col("q")[0].alias("ci_2_5"), F.col("q")[1].alias("ci_97_5"))


def paired_cluster_bootstrap(pairs: DataFrame, cluster: str = "anchor_id", n_boot: int = 5000, seed: int = 2026, score_a: str = "score_a", score_b: str = "score_b") -> DataFrame:
    """(mean_difference, ci_2_5, ci_97_5), one row; an error if there are fewer than two clusters."""
    clusters = gathered(cluster_stats(pairs, cluster, (), score_a, score_b))
    require_clusters(clusters)
    return mean_difference(clusters.totals()).join(percentile_ci(resample(clusters, n_boot, seed)))


def bootstrap_by_group(pairs: DataFrame, by: tuple[str, ...], cluster: str = "anchor_id", n_boot: int = 5000, seed: int = 2026, score_a: str = "score_a", score_b: str = "score_b") -> DataFrame:
    """(by, mean_difference, ci_2_5, ci_97_5) of each group with two or more clusters, all in one job. Groups with a null in ``by`` are left out."""
    clusters = gathered(cluster_stats(pairs.dropna(subset=list(by)), cluster, by, score_a, score_b), by)
    return mean_difference(clusters.totals(), by).join(percentile_ci(resample(clusters, n_boot, seed, by), by), list(by))


def model_sums(scores: DataFrame, models: list[str], on: tuple[str, ...] = ("case_id", "run_id"), cluster: str = "anchor_id", value: str = "cscs") -> DataFrame:
    """(cluster, m0, m1, ..., n): each model's sum of scores over the items of each cluster that all ``models`` have a score for, and the number of these items."""
    of = [F.max(F.when(F.col("model_id") == m, F.col(value))).alias(f"m{k}") for k, m in enumerate(models)]
    items = scores.where(F.col("model_id").isin(*models)).groupBy(*on).agg(F.max(cluster).alias("cluster"), *of)
    there = [F.col(f"m{k}").isNotNull() & ~F.isnan(f"m{k}") for k in range(len(models))]
    whole = items.where(F.col("cluster").isNotNull())
    for t in there:
        whole = whole.where(t)
    return whole.groupBy("cluster").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(len(models))], F.count("*").alias("n"))


def compare_models(scores: DataFrame, models: list[str] | None = None, on: tuple[str, ...] = ("case_id", "run_id"), cluster: str = "anchor_id", value: str = "cscs", n_boot: int = 5000, seed: int = 2026) -> DataFrame:
    """(model_a, model_b, mean_difference, ci_2_5, ci_97_5, low, high) of each two models, model_a before model_b by name.

    All models are compared on the items that each of them has a score for, so a replicate is drawn once and costs a column for each model, not
    one for each pair. ci_2_5 and ci_97_5 are a pair's own interval, as ``paired_cluster_bootstrap`` has it over these items; low and high hold for all
    pairs at once: the mean difference less and plus its standard error times the 95 % quantile of the largest standardised deviation of any pair (max-T).
    A pair whose difference never varies has that difference as its interval.
    """
    names = sorted(models if models is not None else [r[0] for r in scores.select("model_id").where("model_id is not null").distinct().collect()])  # models are few
    if len(names) < 2:
        raise ValueError("need at least two models")
    values = (*[f"m{k}" for k in range(len(names))], "n")
    clusters = gathered(model_sums(scores, names, on, cluster, value), (), values)
    require_clusters(clusters)
    two = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    pair = F.explode(F.array(*[F.struct(F.lit(names[i]).alias("model_a"), F.lit(names[j]).alias("model_b"), ((F.col(f"m{i}") - F.col(f"m{j}")) / F.col("n")).alias("diff")) for i, j in two]))
    drawn = written(replicates(clusters, n_boot, seed), "replicates").select("b", pair.alias("p")).select("b", "p.*")  # read three times, drawn once
    keys = ("model_a", "model_b")
    spread = drawn.groupBy(*keys).agg(F.stddev_samp("diff").alias("se"), F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = clusters.totals().select(pair.alias("p")).select("p.model_a", "p.model_b", F.col("p.diff").alias("mean_difference"))
    known = whole.join(spread, list(keys))  # a row for each pair
    apart = drawn.join(F.broadcast(known.select(*keys, "mean_difference", "se")), list(keys)).where(F.col("se") > 1e-12 * F.greatest(F.abs("mean_difference"), F.lit(1.0)))
    largest = apart.groupBy("b").agg(F.max(F.abs(F.col("diff") - F.col("mean_difference")) / F.col("se")).alias("t")).agg(F.coalesce(F.percentile("t", F.lit(0.95)), F.lit(0.0)).alias("c"))
    wide = F.when(F.col("se") > 1e-12 * F.greatest(F.abs("mean_difference"), F.lit(1.0)), F.col("c") * F.col("se")).otherwise(0.0)
    out = known.join(F.broadcast(largest)).select(*keys, "mean_difference", F.col("q")[0].alias("ci_2_5"), F.col("q")[1].alias("ci_97_5"), wide.alias("wide"))
    return out.select(*keys, "mean_difference", "ci_2_5", "ci_97_5", (F.col("mean_difference") - F.col("wide")).alias("low"), (F.col("mean_difference") + F.col("wide")).alias("high"))


def poisson_bootstrap(pairs: DataFrame, cluster: str = "anchor_id", n_boot: int = 5000, seed: int = 2026, score_a: str = "score_a", score_b: str = "score_b") -> DataFrame:
    """An approximation for very many clusters: each cluster has a Poisson(1) weight in each replicate. (mean_difference, ci_2_5, ci_97_5).

    Weights are numbers of 32 bits made of (seed, cluster, replicate), so they don't depend on the partitioning; replicates without any row are dropped.
    """
    stats = cluster_stats(pairs, cluster, (), score_a, score_b)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, slots = np.zeros((n_boot, 2)), np.arange(n_boot, dtype=np.uint64)
        for pdf in batches:
            for k in range(0, len(pdf), CHUNK):
                part = pdf.iloc[k : k + CHUNK]
                keys = (part["one"].to_numpy(np.uint64)[:, None], part["two"].to_numpy(np.uint64)[:, None])
                u = _number_array(keys, slots[None, :])
                w = np.zeros(u.shape, np.uint8)
                for t in POISSON:
                    w += u >= np.uint32(min(t, MASK))
                sums += w.T.astype(np.float64) @ part[["s", "n"]].to_numpy(np.float64)
        yield pd.DataFrame({"b": np.arange(n_boot, dtype=np.int32), "s": sums[:, 0], "n": sums[:, 1]})

    key = _keys(F.concat(F.lit(f"{seed}|"), F.col("cluster").cast("string")))
    keyed = stats.select(key[0].alias("one"), key[1].alias("two"), "s", F.col("n").cast("double"))
    sums = keyed.mapInPandas(weigh, "b int, s double, n double").groupBy("b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    diffs = sums.where("n > 0").select("b", (F.col("s") / F.col("n")).alias("diff"))
    return mean_difference(stats).join(percentile_ci(diffs))
