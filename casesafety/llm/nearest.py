"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors are packed into blocks; each is also kept as int8 codes with a scale of its own and the length of what the codes lose. Queries are
packed into groups likewise. Each group meets each block in a cell of a grid of groups and lanes of blocks; what a cell holds is bounded in
rows and bytes, and only the codes are sent, an eighth of the vectors. The product of a group's and a block's codes is a tile of whole numbers,
so it is exact; with the scales it gives the distance of the coded vectors, which differs from the true distance by no more than what
the codes of both lose. A cell keeps the candidates whose lower bound is at most the query's k-th smallest upper bound in
it; what is left once all cells' bounds are merged is computed again from the vectors themselves, in double precision, and merged by heaps. So
no neighbour is lost: recall is 1. Of vectors that are equal only the rows of the ``2 k`` smallest ids (``k`` rows of an id) are packed: they hold
the ``k`` smallest other than any one id, so no other copy can be among a query's k nearest.

The score is the square root of the sum of squared differences, added up in the order of the components; where that leaves the range of
doubles, differences are scaled first. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows without an id. Only vectors of the same length are compared. All rows with the query's id are its own; query rows that repeat id and vector
count once, candidate rows that repeat count each. Equal distances go by id. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors and bytes of a block, and of a group of queries, at most; blocks of a lane, at least and at most; lanes that are aimed at.
ROWS, BLOCK_BYTES = 1024, 1 << 21
GROUP, GROUP_BYTES = 4096, 1 << 23
LANE, MOST_LANE, LANES = 4, 256, 256
#: Products of codes up to this many components are whole in single precision.
SINGLE = (1 << 24) // (127 * 127)
#: Widens a bound for what is lost to rounding, as a share of the numbers it is made of.
_SLACK = 1e-13


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v) of the rows that take part; v is an array of float as it is, of anything else an array of double."""
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    x = F.col(vector_col).cast(kind)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    good = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(x, finite) & F.exists(x, lambda c: c != 0)
    return df.where(good).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def without_copies(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors`` without equal ones that can't be among the k nearest of any query. Spark limits the groups before it shuffles them, so a group of copies is no task of its own."""
    first = lambda df, n, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("h", "v", *by).orderBy("id"))).where(F.col("n") <= n).drop("n")
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    again = vectors.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return first(first(hashed, k, "id") if again > k else hashed, 2 * k).drop("h")


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes int8, scales, lost): v is codes times scale, but for a vector of length ``lost`` at most."""
    top = np.abs(v).max(axis=1)
    scale = np.maximum(top / 127, np.finfo(float).tiny)
    codes = np.rint(np.clip(v / scale[:, None], -127, 127)).astype(np.int8)
    with np.errstate(over="ignore", invalid="ignore"):
        lost = np.sqrt(((v - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + top * 1e-12
    # Where squares leave the range of doubles nothing is told apart by bounds.
    return codes, scale, np.where((top < 1e140) & (top > 1e-140), lost, np.inf)


def bounds(q: tuple, x: tuple) -> tuple[np.ndarray, np.ndarray]:
    """[queries, vectors] lower and upper bounds of the distances, from codes, scales and losses."""
    (qc, qs, ql), (xc, xs, xl) = q, x
    kind = np.float32 if qc.shape[1] <= SINGLE else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (qc.astype(kind) @ xc.astype(kind).T).astype(np.float64)
        q2, x2 = ((c.astype(np.int64) ** 2).sum(axis=1) * s**2 for c, s in ((qc, qs), (xc, xs)))
        near = q2[:, None] + x2[None, :]
        square = near - 2 * (qs[:, None] * xs[None, :]) * dot
        slack, lost = near * _SLACK, ql[:, None] + xl[None, :]
        low = np.sqrt(np.maximum(square - slack, 0)) - lost
        high = np.sqrt(np.maximum(square, 0) + slack) + lost
    return np.maximum(np.nan_to_num(low, nan=0.0, posinf=0.0, neginf=0.0), 0), np.nan_to_num(high, nan=np.inf, posinf=np.inf)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The distances of the rows of q and x, summed up in the order of the components."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        total = np.zeros(len(q))
        for k in range(q.shape[1]):
            total += (q[:, k] - x[:, k]) ** 2
        out = np.sqrt(total)
        for i in np.flatnonzero(~np.isfinite(total) | (total < 1e-280)):
            out[i] = math.dist(q[i], x[i])
    return out


def _kind(vectors: DataFrame) -> str:
    return "f4" if dict(vectors.dtypes)["v"] == "array<float>" else "f8"


def _packed(vectors: DataFrame, rows: int, row_bytes: int, name: str) -> DataFrame:
    """(block long, dim, size, ids, exact, codes, scales, lost): at most ``rows`` vectors and ``row_bytes`` bytes of them in a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 32, {}

        def block(dim: int, size: int) -> pa.RecordBatch:
            nonlocal number
            ids, m = (np.concatenate(x) for x in zip(*waiting[dim], strict=True))
            waiting[dim] = [(ids[size:], m[size:])]
            ids, m = ids[:size], m[:size]
            number += 1
            cols = [[number], [dim], [len(ids)], [ids.tobytes()], [m.tobytes()], *[[a.tobytes()] for a in coded(m.astype(np.float64))]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "dim", "size", "ids", "exact", "codes", "scales", "lost"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(at)
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                waiting.setdefault(dim, []).append((ids[mine], values[at[:-1][mine][:, None] + np.arange(dim)]))
                size = max(1, min(rows, row_bytes // (8 * dim)))
                for _ in range(sum(len(i) for i, _ in waiting[dim]) // size):
                    yield block(dim, size)
        for dim, left in waiting.items():
            if n := sum(len(i) for i, _ in left):
                yield block(dim, n)

    schema = "block long, dim int, size int, ids binary, exact binary, codes binary, scales binary, lost binary"
    return staged(vectors.select("id", "v").mapInArrow(pack, schema), name)


def _codes(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.codes, np.int8).reshape(-1, r.dim), np.frombuffer(r.scales), np.frombuffer(r.lost)


def survivors(groups: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(group, query, block, slot) of the pairs that the bounds don't rule out; query and slot are places in a group and a block."""
    n = blocks.count()
    deep = min(MOST_LANE, max(LANE, -(-n // LANES)))
    lanes = max(1, -(-n // deep))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    codes = ("dim", "ids", "codes", "scales", "lost")
    # Either side of the grid is sent to the cells of its row or column.
    sent = blocks.select("block", lane.alias("lane"), *codes).join(groups.select("dim", F.col("block").alias("group")), "dim")
    dims = blocks.select("dim", lane.alias("lane")).distinct()
    asked = groups.select(F.col("block").alias("group"), *codes).join(dims, "dim")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in right.itertuples():
            own, q = np.frombuffer(g.ids, np.int64), _codes(g)
            best, kept = np.full((len(own), k), np.inf), []
            for b in left.sort_values("block").itertuples():
                ids = np.frombuffer(b.ids, np.int64)
                low, high = bounds(q, _codes(b))
                same = own[:, None] == ids[None, :]
                low[same], high[same] = np.inf, np.inf
                best = np.sort(np.partition(np.hstack([best, high]), k - 1, axis=1)[:, :k], axis=1)
                row, slot = np.nonzero((low <= best[:, -1:] * (1 + 1e-12)) & ~same)
                kept.append((row, np.full(len(row), b.block), slot, low[row, slot], high[row, slot]))
            if kept:
                row, block, slot, low, high = (np.concatenate(c) for c in zip(*kept, strict=True))
                near = low <= best[row, -1] * (1 + 1e-12)
                out.append(pd.DataFrame({"group": g.group, "query": row[near], "block": block[near], "slot": slot[near], "low": low[near], "high": np.where(high <= best[row, -1], high, np.nan)[near]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("group", "query", "block", "slot", "low", "high")})

    cells = sent.groupBy("group", "lane").cogroup(asked.groupBy("group", "lane"))
    found = staged(cells.applyInPandas(meet, "group long, query int, block long, slot int, low double, high double"), "bounds")
    if lanes == 1:
        return found.select("group", "query", "block", "slot")
    # The k-th smallest upper bound over all cells; each cell tells its k smallest.
    merged = found.groupBy("group", "query").agg(F.slice(F.sort_array(F.collect_list(F.nanvl("high", F.lit(None).cast("double")))), 1, k).alias("best"))
    bar = merged.select("group", "query", F.when(F.size("best") == k, F.element_at("best", -1)).otherwise(float("inf")).alias("bar"))
    return found.join(bar, ["group", "query"]).where(F.col("low") <= F.col("bar") * (1 + 1e-12)).select("group", "query", "block", "slot")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest of ``vectors`` (id, v) to each of ``queries`` (id, v), but for those with its id."""
    blocks = _packed(without_copies(vectors, k), ROWS, BLOCK_BYTES, "blocks")
    groups = _packed(queries.distinct(), GROUP, GROUP_BYTES, "queries")
    pairs = staged(survivors(groups, blocks, k), "pairs")
    asked = pairs.groupBy("block", "group").agg(F.collect_list(F.struct("query", "slot")).alias("pairs"))
    kind = _kind(vectors)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, pair, dim, ids, exact in zip(*b.columns, strict=True):
                query, slot = (pair.values.field(c).to_numpy() for c in (0, 1))
                ids, x = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(exact.as_py(), kind).reshape(-1, dim.as_py())
                cols = [pa.array([group.as_py()] * len(query), pa.int64()), pa.array(query), pa.array(ids[slot]), pa.array([r.tobytes() for r in x[slot]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["group", "query", "id", "x"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, dim, ids, exact in zip(*b.columns, strict=True):
                own, q = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(exact.as_py(), kind).reshape(-1, dim.as_py())
                cols = [pa.array([group.as_py()] * len(own), pa.int64()), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own), pa.array([r.tobytes() for r in q], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["group", "query", "query_id", "q"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, heaps = np.array([len(x) for x in b.column(1).to_pylist()]), {}
            score = np.zeros(b.num_rows)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x, q = (np.frombuffer(b"".join(b.column(c).take(pa.array(at)).to_pylist()), kind).astype(np.float64).reshape(len(at), -1) for c in (1, 2))
                score[at] = distances(q, x)
            for i, s, *key in zip(b.column(0).to_pylist(), score.tolist(), *[b.column(c).to_pylist() for c in (3, 4, 5)], strict=True):
                heap = heaps.setdefault(tuple(key), [])
                if len(heap) < k:
                    heapq.heappush(heap, (-s, -i))
                else:
                    heapq.heappushpop(heap, (-s, -i))
            rows = [(*key, -i, -s) for key, heap in heaps.items() for s, i in heap]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["group", "query", "query_id", "id", "score"])

    # Only the vectors that are asked for leave their block.
    fetched = asked.join(blocks.select("block", "dim", "ids", "exact"), "block").select("group", "pairs", "dim", "ids", "exact").mapInArrow(fetch, "group long, query int, id long, x binary")
    own = groups.select("block", "dim", "ids", "exact").mapInArrow(alone, "group long, query int, query_id long, q binary")
    met = fetched.join(own, ["group", "query"]).select("id", "x", "q", "group", "query", "query_id")
    found = met.mapInArrow(again, "group long, query int, query_id long, id long, score double")
    best = found.groupBy("group", "query", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))
