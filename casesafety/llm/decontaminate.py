"""Benchmark decontamination: size-partitioned MinHash containment search for short items in long documents.

Shingles are five words (ASCII letters lower-cased; a shorter text is one shingle of all its words, an empty
one has none). An item of n distinct shingles is contained in a document that has at least
``ceil(threshold * n)`` of them, wherever they stand.

Items are partitioned by size, a power of two of shingles each. An item's MinHash sketch is its
``n - ceil(threshold * n) + 1`` smallest hashes, so a document that misses all of them misses too many
shingles to contain the item: no contained item is lost, however long the document is. A document looks
its hashes up in each partition's sketches, below that partition's largest sketch hash only. What
it finds is verified on the shingles themselves.

Documents are read once, whatever the benchmark's size. Items of at most ``BLOCK_WORDS`` words (16 characters each) together go to the
executors as a whole, and documents are not shuffled. More are kept as tables: documents look their hashes up in a bit
map of ``FILTER_BITS`` bits and send on the shingles that may be an item's, which meet the sketches, then all shingles of
the items found, by hash. A frequent shingle's documents are dealt to ``PARTS`` parts. Both ways give the same rows.

Null texts count as empty; an item without an id is one like any other; rows that repeat a doc_id or item_id are reported each; extra columns
are ignored. An item may be as long as a document. Documents are read whole, however long; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, n_words, staged, text_hash

#: Words of a benchmark that is broadcast, at most; bits of the map that is broadcast for a larger one; parts that the documents of a shingle are dealt to.
BLOCK_WORDS, FILTER_BITS, PARTS = 500_000, 1 << 26, 16
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash for each shingle in order, from hashes of its words."""
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    h = one[:n].copy()
    for k in range(1, min(width, len(words))):
        h = h * _MULTIPLY + one[k : k + n]
    return mixed(h)


def shingle_set(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


class Sketches:
    """The sketches of a benchmark of bounded size, by size partition."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        self.items = []  # id, distinct hashes in order, needed, words
        parts: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            w = words_of(text)
            h = np.unique(shingle_hashes(w, width))
            if len(h):
                need = needed(len(h), threshold)
                parts.setdefault(len(h).bit_length(), []).extend((int(x), len(self.items)) for x in h[: len(h) - need + 1])
                self.items.append((item_id, h, need, w))
        self.seen = np.zeros(1 << 20, bool)
        self.parts = []
        for _, sketch in sorted(parts.items()):
            sketch.sort()
            h, item = np.array([x for x, _ in sketch], np.uint64), np.array([i for _, i in sketch])
            self.seen[h & np.uint64((1 << 20) - 1)] = True
            self.parts.append((h[-1], h, item))

    def contained(self, text: str | None) -> list[tuple[int, float]]:
        """(item_id, containment) of each item that the text contains, in item order."""
        w = words_of(text)
        h = shingle_hashes(w, self.width)
        some = h[self.seen[h & np.uint64((1 << 20) - 1)]]
        if not len(some):
            return []
        some, found = np.unique(some), set()
        for most, sketch, item in self.parts:
            below = some[some <= most]
            a, b = np.searchsorted(sketch, below, "left"), np.searchsorted(sketch, below, "right")
            for i, j in zip(a[b > a], b[b > a], strict=True):
                found.update(item[i:j].tolist())
        out = []
        for k in sorted(found):
            item_id, hashes, need, words = self.items[k]
            at = np.flatnonzero(np.isin(h, hashes))
            there = {b" ".join(w[i : i + self.width]) for i in at.tolist()}
            if (hits := len(there & shingle_set(words, self.width))) >= need:
                out.append((item_id, hits / len(hashes)))
        return out


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))


def _small(items: DataFrame, width: int, threshold: float) -> Sketches | None:
    """The sketches of a benchmark that is small enough to be broadcast; None for a larger one."""
    some = items.where(n_words(F.col("text")) > 0)
    words, chars = some.agg(F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if words > BLOCK_WORDS or chars > 16 * BLOCK_WORDS:
        return None
    return Sketches([tuple(r) for r in some.orderBy("item_id", "text").collect()], width, threshold)


def _shuffled(docs: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(doc_id, text_hash, times, item_id, containment) of a benchmark of any size; times: how many rows have this doc_id and text."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(text)
                h, at = np.unique(shingle_hashes(w, width), return_index=True)
                n, need = len(h), needed(len(h), threshold)
                texts = [b" ".join(w[i : i + width]) for i in at.tolist()]
                small = np.arange(n) < n - need + 1  # the sketch
                cols = [np.full(n, row), np.full(n, n), np.full(n, need), h.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array(texts, pa.binary()), pa.array(small, pa.bool_())], names=["item", "n", "need", "hash", "shingle", "sketch"])

    known = staged(items.withColumn("item", F.monotonically_increasing_id()), "items")
    parts = staged(known.select("item", "text").mapInArrow(shingles, "item long, n long, need long, hash long, shingle binary, sketch boolean"), "shingles")
    # The map has at most FILTER_BITS / 64 words, however many shingles there are.
    place = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = parts.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    kept = docs.sparkSession.sparkContext.broadcast(table)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = kept.value.view(np.uint64)
        for b in batches:
            for doc, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words_of(text)
                h, at = np.unique(shingle_hashes(w, width), return_index=True)
                low = h & np.uint64(FILTER_BITS - 1)
                some = np.flatnonzero(seen[(low >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1))
                if len(some):
                    texts = [b" ".join(w[i : i + width]) for i in at[some].tolist()]
                    cols = [pa.array([doc] * len(some), pa.int64()), pa.array([mark] * len(some), pa.int64()), pa.array(h[some].view(np.int64)), pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "hash", "shingle"])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string"))
    found = rows.mapInArrow(hits, "doc_id long, text_hash long, hash long, shingle binary")
    each = staged(found.groupBy("doc_id", "text_hash", "hash", "shingle").agg(F.count("*").alias("times")).withColumn("matching", F.count("*").over(Window.partitionBy("doc_id", "text_hash"))), "hits")
    each = each.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PARTS)).cast("int"))
    dealt = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    # A document with fewer matching shingles than the item needs doesn't contain it, so the item's other shingles aren't laid out for it.
    met = each.select("doc_id", "text_hash", "times", "hash", "part", "matching").join(parts.where("sketch").select("item", "hash", F.col("need").alias("least"), dealt), ["hash", "part"])
    candidates = met.where("matching >= least").select("doc_id", "text_hash", "times", "item").distinct()
    # Verified on all shingles that the two have in common.
    pairs = staged(candidates, "candidates").join(parts.select("item", "n", "need", "hash", "shingle"), "item")
    c, e = pairs.alias("c"), each.drop("times", "part", "matching").alias("e")
    same = (F.col("c.hash") == F.col("e.hash")) & (F.col("c.shingle") == F.col("e.shingle")) & F.col("c.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("c.text_hash") == F.col("e.text_hash"))
    counted = c.join(e, same).groupBy("c.doc_id", "c.text_hash", "c.times", "c.item", "c.n", "c.need").agg(F.count("*").alias("shared"))
    good = counted.where("shared >= need").select("doc_id", "text_hash", "times", "item", (F.col("shared") / F.col("n")).alias("containment"))
    return good.join(known.select("item", "item_id"), "item").select("doc_id", "text_hash", "times", "item_id", "containment")


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, containment) for each item that is contained in a document."""
    items = _items(items)
    sketches = _small(items, width, threshold)
    if sketches is None:
        found = _shuffled(docs, items, width, threshold)
        return found.select("doc_id", "item_id", "containment", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("one")).drop("one")
    kept = docs.sparkSession.sparkContext.broadcast(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d.as_py(), *hit) for d, t in zip(b.column(0), b.column(1), strict=True) for hit in kept.value.contained(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["doc_id", "item_id", "containment"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, containment double")


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no item, all their columns as they are."""
    items = _items(items)
    sketches = _small(items, width, threshold)
    if sketches is None:
        bad = staged(_shuffled(docs, items, width, threshold).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
        keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))
        return keyed.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti").select("row.*")
    kept = docs.sparkSession.sparkContext.broadcast(sketches)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not kept.value.contained(t) for t in texts], dtype=bool)

    return docs.where(clean(F.col("text").cast("string")))
