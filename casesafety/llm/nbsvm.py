"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear
hinge-loss model fitted by dual coordinate descent.

Features are hashed into a fixed number of buckets, so the model's size is a constant (``1 << bits``
weights) and may be broadcast. The fit uses a bounded, documented sample of the labelled rows: at most
``max_fit_rows`` ids, half of them of either class, with at most ``max_fit_chars`` characters, half of them for either class,
taken in order of a hash of the id; whole texts, one for each id. The model tells how many of these ids the bound on characters left out
(``left_out``). The fit goes on until the duality gap is at most ``GAP`` of the objective.

Scores are made for every row and the whole text, in blocks: a worker holds a text, its lower-cased copy and one block's n-grams, whatever
the text's length. Empty tables of documents give no rows; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A featurizer takes a text and gives arrays of hashed n-grams (uint32), repeats included, each of bounded size.
Featurizer = Callable[[str], Iterable[np.ndarray]]
#: The fit's duality gap, as a share of the objective, and rounds over all rows at most (an error beyond); rounds over the rows that move, between these.
GAP, ROUNDS, INNER = 1e-3, 2000, 8
#: N-grams whose buckets are told apart at a time.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Model:
    """``weights`` has the learned weight times the log-count ratio; the score is a logistic of ``slope * margin + shift``."""

    bits: int
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    fitted: int = 0
    left_out: int = 0

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


class Distinct:
    """Distinct buckets of one text after another, in time proportional to the text.

    Every position writes its serial number into its bucket's cell; positions that read back their own
    number are the last of their bucket, so each bucket is kept once. Serial numbers go on from text to
    text, so the cells need no clearing until they would overflow. A long text's n-grams come a part at a time; what
    an earlier part of it had has a number from the text's own first one on.
    """

    def __init__(self, bits: int):
        self.cell, self.next, self.mask = np.zeros(1 << bits, np.int64), 1, np.uint32((1 << bits) - 1)

    def _part(self, grams: list[np.ndarray], first: int) -> np.ndarray:
        h = np.concatenate(grams) & self.mask
        new = h[self.cell[h] < first]
        serial = np.arange(self.next, self.next + len(new))
        self.next += len(new)
        self.cell[new] = serial
        return new[self.cell[new] == serial]

    def __call__(self, grams: Iterable[np.ndarray]) -> np.ndarray:
        first, out, held, n = self.next, [], [], 0
        for g in grams:
            held.append(g)
            n += len(g)
            if n >= AT_ONCE:
                out.append(self._part(held, first))
                held, n = [], 0
        if held:
            out.append(self._part(held, first))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def indicators(featurizer: Featurizer, bits: int):
    """The function for ``mapInPandas`` that turns (doc_id, text, label, hash, short) into (doc_id, label, characters, hash, short, sorted distinct buckets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct = Distinct(bits)
        for b in batches:
            out = [np.sort(distinct(featurizer(t or ""))).astype(np.int32).tobytes() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"].astype("int32"), "chars": b["text"].str.len(), "hash": b["hash"], "short": b["short"], "grams": out})

    return run


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float, min_df: int) -> np.ndarray:
    """ln((alpha + positives with it) / |..|_1 : (alpha + negatives with it) / |..|_1); 0 for n-grams of fewer than ``min_df`` rows."""
    p, q = np.zeros(size), np.zeros(size)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    seen = p + q
    p, q = p + alpha, q + alpha
    return np.where(seen >= min_df, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def dual_coordinate_descent(
    rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int, seed: int, gap: float = GAP
) -> tuple[np.ndarray, float]:
    """min (|w|² + b²)/2 + Σ cost_i max(0, 1 - y_i (w·x_i + b)), x_i = ratio on the row's buckets, scaled to length 1.

    The dual has one variable a_i in [0, cost_i] for each row; a step solves for one of them and keeps
    w = Σ a_i y_i x_i. The bias is one more feature, of value 1. Rounds over all rows alternate with rounds over those that are
    between their bounds, until objective and dual value are within ``gap`` of the objective.
    """
    w, b, a, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    values = [ratio[r] for r in rows]
    values = [v / max(1e-9, np.sqrt(v @ v)) for v in values]
    square = np.array([v @ v + 1.0 for v in values])

    def step(which: np.ndarray) -> float:
        nonlocal b
        most = 0.0
        for i in rng.permutation(which):
            r, v = rows[i], values[i]
            slack = y[i] * (w[r] @ v + b) - 1.0
            new = min(max(a[i] - slack / square[i], 0.0), cost[i])
            if (move := (new - a[i]) * y[i]) != 0.0:
                w[r] += move * v
                b += move
                most = max(most, abs(move))
                a[i] = new
        return most

    every = np.arange(len(y))
    for _ in range(rounds):
        step(every)
        loose = np.flatnonzero((a > 0) & (a < cost))
        for _ in range(INNER):
            if not len(loose) or step(loose) < 1e-4:
                break
        half = (w @ w + b * b) / 2
        loss = sum(c * max(0.0, 1.0 - k * (w[r] @ v + b)) for r, v, k, c in zip(rows, values, y, cost, strict=True))
        if half + loss - (a.sum() - half) <= gap * (half + loss):
            return w, b
    raise ValueError(f"the fit didn't come within {gap} of its optimum in {rounds} rounds")


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by Newton steps on smoothed targets."""
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -60, 60)))
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(d * margin).sum(), d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, shift = slope - np.clip(step[0], -2, 2), shift - np.clip(step[1], -2, 2)
    return max(float(slope), 1e-3), float(shift)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float, min_df: int, c: float, seed: int) -> Model:
    """Fits on rows in memory. With one class only (or no rows) the model is a constant: that class's smoothed share."""
    y, size = np.where(labels > 0, 1.0, -1.0), 1 << bits
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    if not n1 or not n0:
        return Model(bits, np.zeros((2, size), np.float32), 0.0, 1.0, float(np.log((n1 + 1) / (n0 + 1))) if len(y) else 0.0)
    cost = np.where(y > 0, c * len(y) / (2 * n1), c * len(y) / (2 * n0))
    fold = np.empty(len(y), int)  # the curve from margin to score is fitted on margins of rows that were left out
    for k in (-1, 1):
        fold[y == k] = np.arange((y == k).sum()) % 3
    held = np.zeros(len(y))

    def one(take: np.ndarray):
        mine = [rows[i] for i in np.flatnonzero(take)]
        ratio = log_count_ratio(mine, y[take], size, alpha, min_df)
        w, b = dual_coordinate_descent(mine, y[take], ratio, cost[take], ROUNDS, seed)
        return ratio, w * ratio, b

    def margins(which: np.ndarray, ratio, scaled, b) -> np.ndarray:
        return np.array([scaled[rows[i]].sum() / max(1e-9, np.sqrt((ratio[rows[i]] ** 2).sum())) + b for i in which])

    for k in range(3):
        inside, out = fold != k, np.flatnonzero(fold == k)
        if len(set(y[inside])) == 2:
            held[out] = margins(out, *one(inside))
    ratio, scaled, b = one(np.ones(len(y), bool))
    slope, shift = logistic_fit(held, y)
    return Model(bits, np.stack([scaled, ratio**2]).astype(np.float32), b, slope, shift)


def fit(
    docs: DataFrame, labels: DataFrame, label: str, featurizer: Featurizer, *, bits: int = 18, max_fit_rows: int = 6000, max_fit_chars: int = 1 << 25,
    alpha: float = 1.0, min_df: int = 3, c: float = 1.0, seed: int = 7,
) -> Model:
    """Learns ``label`` (0/1) from ``docs`` (doc_id, text) joined with ``labels`` (doc_id, ``label``).

    Of the labelled rows at most ``max_fit_rows / 2`` of each class take part: those with the smallest hash of
    the id; of rows that share an id, the one with the smallest hash of its text. Each class's rows are taken in that
    order as long as their texts have ``max_fit_chars / 2`` characters at most together; one that has more than an
    eighth of that on its own is passed over. So the join's small side has a proven bound, and so has the one
    task that fits. Rows without a label, or with a null id, are not learned from; a null text counts as empty; an id that is
    labelled both ways is learned from both ways.
    """
    good = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").distinct()
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.col("doc_id")]
    part = [good.where(F.col("label") == k).orderBy(*order).limit(max_fit_rows // 2) for k in (0, 1)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(part[0].unionByName(part[1])), "doc_id")
    short = F.length("text") <= max_fit_chars // 16
    grams = found.select("doc_id", F.when(short, F.col("text")).otherwise("").alias("text"), "label", F.xxhash64("text").alias("hash"), short.alias("short")).mapInPandas(indicators(featurizer, bits), "doc_id long, label int, chars long, hash long, short boolean, grams binary")
    one = grams.groupBy("doc_id", "label").agg(F.min_by(F.struct("chars", "grams", "short"), F.struct(~F.col("short"), "hash")).alias("row")).select("doc_id", "label", "row.*")
    upto = F.sum("chars").over(Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sample = one.withColumn("upto", upto).select("doc_id", "label", F.when(F.col("short") & (F.col("upto") <= max_fit_chars // 2), F.col("grams")).alias("grams"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        left_out = int(pdf["grams"].isna().sum())
        pdf = pdf[pdf["grams"].notna()].sort_values(["doc_id", "label", "grams"])
        rows = [np.frombuffer(g, np.int32) for g in pdf["grams"]]
        m = fit_rows(rows, pdf["label"].to_numpy(), bits, alpha, min_df, c, seed)
        return pd.DataFrame({"weights": [np.ascontiguousarray(m.weights).tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift], "fitted": [len(rows)], "left_out": [left_out]})

    got = sample.groupBy(F.lit(0).alias("one")).applyInPandas(solve, "weights binary, bias double, slope double, shift double, fitted long, left_out long").collect()
    if not got:  # no labelled rows
        return Model(bits, np.zeros((2, 1 << bits), np.float32), 0.0, 1.0, 0.0)
    w = np.frombuffer(got[0]["weights"], np.float32).reshape(2, -1)
    return Model(bits, w, *(got[0][k] for k in ("bias", "slope", "shift", "fitted", "left_out")))


def scorer(docs: DataFrame, model: Model, featurizer: Featurizer):
    """A pandas UDF from a text column to the score; the model goes to the executors once (``2 << bits`` floats, a constant)."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = kept.value
        distinct, (w, square) = Distinct(m.bits), m.weights
        for texts in batches:
            margin = np.empty(len(texts))
            for i, t in enumerate(texts):
                h = distinct(featurizer(t or ""))
                margin[i] = w[h].sum(dtype=np.float64) / max(1e-9, np.sqrt(square[h].sum(dtype=np.float64))) + m.bias
            yield pd.Series(m.score(margin))

    return score


def scores(docs: DataFrame, model: Model, featurizer: Featurizer) -> DataFrame:
    """(doc_id, score) of every row, over the whole text; a null text counts as empty."""
    return docs.select("doc_id", scorer(docs, model, featurizer)(F.col("text").cast("string")).alias("score"))
