"""Exact top-k inner-product search, block at a time.

Vectors are put in an order that brings like ones together (by the nearest of ``PIVOTS`` vectors, a bounded sample taken by a
hash of the id, then by nearness to it) and cut into blocks of consecutive places. A block keeps the largest and the smallest value of each component (its term maxima) and a
forward index, the matrix of its vectors. The sum over a query's components of the best product that a block allows
bounds every score in the block.

Queries stand in groups, in the same order. The blocks' maxima alone, a small table, meet the groups first: each query's block of the largest bound is scored with its group, and that gives each query a k-th
score to beat. Then only those (group, block) pairs are made whose bound reaches the score to beat of one
of the group's queries, and only their blocks are sent. In a task a query goes through its blocks in falling order of
their bounds and stops when the next is below its k-th best score; a bound equal to it is still scored, since ties go to
smaller ids. So results are exact. How many pairs are left depends on the data (``pairs`` tells): few where vectors cluster, all
of them where they are spread evenly over a sphere. Where there are no more than ``FEW`` pairs in all, they are made at once.

What a task holds is bounded by bytes (``BLOCK_BYTES``, ``GROUP_BYTES``, ``LANE``, ``SLICE``); no vector is broadcast or collected.

Components become ``floor(256 * x)``. Vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows without an id; finite ones of any size do. Scores are whole numbers computed without rounding; should one of a query's
best not fit a long, the query fails with a message that says so. Only vectors of the same length are compared.
All rows with the query's id are its own; query rows that repeat id and vector count once, candidate rows that repeat
count each. Extra columns are ignored. No vectors or no queries give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors in a block, in a range of the order, and queries in a group, at most; bytes of a block's and of a group's matrix, at most.
ROWS, RANGE_ROWS, GROUP = 256, 8192, 8192
BLOCK_BYTES, GROUP_BYTES = 1 << 20, 1 << 22
#: Blocks whose maxima one task reads; blocks that are scored in one task; pairs that aren't pruned.
LANE, SLICE, FEW = 4096, 32, 256
#: Vectors that the order goes by, and components of them all, at most.
PIVOTS, PIVOT_NUMBERS = 1024, 1 << 19
_INT64 = np.iinfo(np.int64)
#: Bounds and thresholds are sums of doubles; they are widened by this share of the sum of absolute values.
_SLACK = 1e-11


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v array<double>) of the rows that take part; v holds floor(256 * x) / 256, which a double holds exactly."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    good = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(x, finite)
    # From 2^52 on every double is whole.
    floor = lambda c: F.when(F.abs(c) < F.lit(float(2**52)), F.floor(c * 256).cast("double") / 256).otherwise(c)
    return df.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, floor).alias("v"))


def _stored(m: np.ndarray) -> tuple[str, bytes]:
    """A matrix of v as 256 * v in the smallest type that holds it, or as v itself."""
    top = np.abs(m).max(initial=0.0)
    for kind in ("i2", "i4"):
        if top * 256 <= np.iinfo(kind).max:
            return kind, (m * 256).astype(kind).tobytes()
    return "f8", m.tobytes()


def _read(kind: str, raw: bytes, dim: int) -> np.ndarray:
    """The matrix of v, as doubles."""
    m = np.frombuffer(raw, kind).reshape(-1, dim)
    return m if kind == "f8" else m / 256.0


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(offsets)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield at, values[offsets[:-1][at][:, None] + np.arange(dim)]


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By length, the vectors that the order goes by; it has no bearing on results."""
    sample = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOTS).select("v").collect()
    taken, found = 0, {}
    for r in sample:
        if (taken := taken + len(r["v"])) <= PIVOT_NUMBERS:
            found.setdefault(len(r["v"]), []).append(r["v"])
    return {dim: np.array(m) / max(1.0, np.abs(m).max()) for dim, m in found.items()}


def _packed(vectors: DataFrame, pivots: dict[int, np.ndarray], rows: int, row_bytes: int, range_rows: int, name: str) -> DataFrame:
    """(block long, dim, ids, kind, matrix, most, least, bar): blocks of like vectors, at most ``rows`` and ``row_bytes`` large."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, near = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at, v in _matrices(b.column(1)):
                if v.shape[1] in pivots:
                    score = (v / np.maximum(1.0, np.abs(v).max(axis=1, keepdims=True))) @ pivots[v.shape[1]].T
                    codes[at], near[at] = score.argmax(axis=1), -score.max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(near), b.column(0), b.column(1)], names=["code", "near", "id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 32, {}

        def block(dim: int, size: int) -> pa.RecordBatch:
            nonlocal number
            ids, m = (np.concatenate(x) for x in zip(*waiting[dim], strict=True))
            waiting[dim] = [(ids[size:], m[size:])]
            ids, m = ids[:size], m[:size]
            kind, raw = _stored(m)
            number += 1
            bar = np.full(len(m), -np.inf)  # no score to beat yet
            cols = [[number], [dim], [ids.tobytes()], [kind], [raw], [m.max(axis=0).tobytes()], [m.min(axis=0).tobytes()], [bar.tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "dim", "ids", "kind", "matrix", "most", "least", "bar"])

        for b in batches:
            every = b.column("id").to_numpy(zero_copy_only=False)
            for at, v in _matrices(b.column("v")):
                dim = v.shape[1]
                waiting.setdefault(dim, []).append((every[at], v))
                size = max(1, min(rows, row_bytes // (8 * dim)))
                for _ in range(sum(len(i) for i, _ in waiting[dim]) // size):
                    yield block(dim, size)
        for dim, left in waiting.items():
            if n := sum(len(i) for i, _ in left):
                yield block(dim, n)

    n = max(1, math.ceil(vectors.count() / range_rows))
    ordered = vectors.select("id", "v").mapInArrow(order, "code int, near double, id long, v array<double>").repartitionByRange(n, "code", "near", "id").sortWithinPartitions("code", "near", "id", "v")
    return staged(ordered.mapInArrow(pack, "block long, dim int, ids binary, kind string, matrix binary, most binary, least binary, bar binary"), name)


def _bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """[queries, blocks]: no product of the query and a vector in the block (least to most) is larger."""
    above, below = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = above @ most.T + below @ least.T + _SLACK * (above @ np.abs(most).T - below @ np.abs(least).T)
    return np.nan_to_num(bound, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _exact(m: np.ndarray) -> np.ndarray:
    """256 * v as Python's whole numbers."""
    return np.array([[int(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in row] for row in m], object).reshape(m.shape)


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray | None:
    """[queries, vectors] of whole numbers; None if they may not fit a long."""
    q_top, m_top = (float(np.abs(x).max(initial=0)) for x in (q, m))
    top = q_top * m_top * q.shape[1] * 65536
    if top < 2**53:  # sums of multiples of 1 / 65536 that a double holds exactly
        return ((q @ m.T) * 65536).astype(np.int64)
    if top < 2**62 and max(q_top, m_top) < 2**52:
        return (q * 256).astype(np.int64) @ (m * 256).astype(np.int64).T
    return None


def _best(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], q_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> list[tuple[int, int, int]]:
    """(query_id, id, score) of each query's k best over the blocks (ids, v, most, least) that reach ``least`` (scores / 65536)."""
    bound = _bounds(q, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    low, bar = _INT64.min, least.copy()
    top_s, top_i = np.full((len(q), k), low), np.full((len(q), k), _INT64.max)
    wide: dict[int, list[tuple[int, int]]] = {}  # of queries with a score that may not fit a long: (-score, id), best first
    for step in range(len(blocks)):
        at = order[:, step]
        live = bound[np.arange(len(q)), at] >= bar
        if not live.any():
            break
        for b in np.unique(at[live]):
            ids, m = blocks[b][:2]
            rows = np.flatnonzero(live & (at == b))
            scores = _scores(q[rows], m) if not wide else None
            if scores is None:
                for r in rows.tolist():
                    known = wide.setdefault(r, [(-int(s), int(i)) for s, i in zip(top_s[r], top_i[r], strict=True) if s > low])
                    found = [(-s, int(i)) for s, i in zip(_exact(m) @ _exact(q[r : r + 1])[0], ids, strict=True) if i != q_ids[r]]
                    wide[r] = sorted(known + found)[:k]
                    if len(wide[r]) == k:
                        kth = -wide[r][-1][0] / 65536
                        bar[r] = max(bar[r], kth - _SLACK * abs(kth))
                continue
            s = np.hstack([top_s[rows], np.where(ids[None, :] == q_ids[rows, None], low, scores)])
            i = np.hstack([top_i[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
            best = np.lexsort((i, -np.maximum(s, low + 1)), axis=1)[:, :k]
            top_s[rows], top_i[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            full = rows[top_s[rows, -1] > low]
            kth = top_s[full, -1] / 65536
            bar[full] = np.maximum(bar[full], kth - _SLACK * np.abs(kth))
    out = []
    for r, (a, si, ii) in enumerate(zip(q_ids, top_s, top_i, strict=True)):
        out += [(int(a), i, -s) for s, i in wide[r]] if r in wide else [(int(a), int(i), int(s)) for s, i in zip(si, ii, strict=True) if s > low]
    return out


def _as_long(score: int) -> int | None:
    if score > _INT64.max:
        raise ValueError(f"the score {score} does not fit a long")
    return score if score >= _INT64.min else None  # null: less than any long


def _met(groups: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(group, query_id, id, score) of each query's k best over the blocks that ``pairs`` (group, block, slice) gives its group."""
    sent = pairs.join(blocks, "block")
    asked = pairs.select(F.col("group").alias("group"), F.col("slice").alias("slice")).distinct().join(groups, "group")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in right.itertuples():
            read = [(np.frombuffer(b.ids, np.int64), _read(b.kind, b.matrix, b.dim), np.frombuffer(b.most), np.frombuffer(b.least)) for b in left.sort_values("block").itertuples()]
            if read:
                out += [(r.group, q, i, _as_long(s)) for q, i, s in _best(read, np.frombuffer(r.ids, np.int64), _read(r.kind, r.matrix, r.dim), k, np.frombuffer(r.bar))]
        return pd.DataFrame(out, columns=["group", "query_id", "id", "score"]).astype({"group": "int64", "query_id": "int64", "id": "int64", "score": "Int64"})

    return sent.groupBy("group", "slice").cogroup(asked.groupBy("group", "slice")).applyInPandas(meet, "group long, query_id long, id long, score long")


def _lanes(groups: DataFrame, blocks: DataFrame, pick) -> DataFrame:
    """(group, query, block, bound): what ``pick(scores to beat, bounds by query and block)`` gives, as three arrays, for each group and each lane of block maxima."""
    maxima = blocks.select(F.floor(F.row_number().over(Window.partitionBy("dim", F.shiftright("block", 32)).orderBy("block")) / LANE).alias("deep"), "dim", "block", "most", "least")
    # Ranges are dealt to lanes, so that no task has all maxima.
    ranges = max(1, LANE * ROWS // RANGE_ROWS)
    maxima = maxima.withColumn("lane", F.concat_ws("-", F.floor(F.shiftright("block", 32) / ranges), "deep"))
    lanes = maxima.select(F.col("dim").alias("dim"), F.col("lane").alias("lane")).distinct()
    asked = groups.select("group", "dim", "kind", "matrix", "bar").join(lanes, "dim")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            number = left["block"].to_numpy()
            most, least = (np.stack([np.frombuffer(x) for x in left[c]]) for c in ("most", "least"))
            for r in right.itertuples():
                query, place, bound = pick(np.frombuffer(r.bar), _bounds(_read(r.kind, r.matrix, dim), most, least))
                out.append(pd.DataFrame({"group": r.group, "query": query, "block": number[place], "bound": bound}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("group", "query", "block", "bound")}).astype({"group": "int64", "query": "int64", "block": "int64"})

    return maxima.groupBy("dim", "lane").cogroup(asked.groupBy("dim", "lane")).applyInPandas(meet, "group long, query long, block long, bound double")


def _reaching(bar: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks whose bound reaches the score to beat of a query, and their largest bounds."""
    place = np.flatnonzero((bound >= bar[:, None]).any(axis=0))
    return np.zeros(len(place), np.int64), place, bound[:, place].max(axis=0, initial=-np.inf)


def _largest(bar: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's block of the largest bound."""
    place = bound.argmax(axis=1)
    return np.arange(len(bound)), place, bound.max(axis=1)


def pairs(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(group, block, bound): the pairs that have to be scored, given the groups' scores to beat."""
    if groups.count() * blocks.count() <= FEW:
        return groups.select("group", "dim").join(blocks.select("block", "dim"), "dim").select("group", "block", F.lit(0.0).alias("bound"))
    return staged(_lanes(groups, blocks, _reaching).drop("query"), "pairs")


def prepared(vectors: DataFrame, queries: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(groups, blocks): blocks of ``vectors``, and groups of ``queries`` with a score to beat for each query, from the seeds."""
    pivots = _pivots(vectors)
    blocks = _packed(vectors, pivots, ROWS, BLOCK_BYTES, RANGE_ROWS, "blocks").drop("bar")
    groups = _packed(queries.distinct(), pivots, GROUP, GROUP_BYTES, GROUP, "queries").withColumnRenamed("block", "group").drop("most", "least")
    if groups.count() * blocks.count() <= FEW:
        return groups, blocks
    best = _lanes(groups, blocks, _largest).groupBy("group", "query").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("block"))
    seeds = best.select("group", "block").distinct().withColumn("slice", F.floor((place - 1) / SLICE).cast("int"))
    found = _met(groups, blocks, staged(seeds, "seeds"), k)
    # A query's k-th best so far; -inf where it has fewer.
    rank = F.row_number().over(Window.partitionBy("group", "query_id").orderBy(F.desc_nulls_last("score")))
    by_query = found.withColumn("rank", rank).where((F.col("rank") == k) & F.col("score").isNotNull()).withColumnRenamed("score", "kth")
    each = staged(by_query.select("group", "query_id", (F.col("kth") / 65536.0).alias("kth")).groupBy("group").agg(F.collect_list(F.struct("query_id", "kth")).alias("kth")), "bars")

    @F.pandas_udf("binary")
    def bars(ids: pd.Series, kth: pd.Series) -> pd.Series:
        out = []
        for raw, known in zip(ids, kth, strict=True):
            t = {r["query_id"]: r["kth"] for r in known} if known is not None else {}
            bar = np.array([t.get(int(i), -np.inf) for i in np.frombuffer(raw, np.int64)])
            out.append(np.where(np.isfinite(bar), bar - _SLACK * np.abs(bar), bar).tobytes())
        return pd.Series(out, dtype=object)

    return staged(groups.join(each, "group", "left").withColumn("bar", bars("ids", "kth")).drop("kth"), "groups"), blocks


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score) for each of ``queries`` (id, v) against all ``vectors`` (id, v) but those with its id."""
    groups, blocks = prepared(vectors, queries, k)
    slices = pairs(groups, blocks).withColumn("slice", F.floor((F.row_number().over(Window.partitionBy("group").orderBy(F.desc("bound"), "block")) - 1) / SLICE).cast("int"))
    found = _met(groups, blocks, slices.select("group", "block", "slice"), k).drop("group")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id"))
    score = F.coalesce("score", F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", score.alias("score"))
