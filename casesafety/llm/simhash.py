"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 64 bits; bit i is 1 if it is set in more than half of its shingles' hashes.
Fingerprints link at ``RADIUS`` = 3 or fewer differing bits. Each fingerprint is cut into two segments of
32 bits; of three differing bits one segment has at most one, so looking up the ball of radius 1 around
each segment in that segment's table finds every link; complete distances are verified then.

Documents with the same fingerprint are one entry, so groups of copies cost nothing more. A segment value
that more than ``hot`` different fingerprints share is not paired out: those fingerprints meet at hubs
instead (``_hub_links``), which gives the same components in time proportional to their number.

Null or empty texts have fingerprint zero. Components follow from texts alone: rows that share a doc_id, or have none,
are told apart by a hash of their text. Texts are read whole, in parts. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, staged_and_told, text_hash
from .components import connected_components

RADIUS, SEED = 3, 42
#: Fingerprints that more than one in so many rows have are joined by broadcast: there are fewer of them than this number.
HEAVY = 1024
#: Bytes of a text whose words are laid out at a time.
_SPAN = 1 << 18
_SPACE = re.compile(rb"[ \t-\r]")


def _spans(raw: bytes) -> Iterator[bytes]:
    """A text cut after white space, about ``_SPAN`` bytes at a time."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + _SPAN)
        end = cut.end() if cut else len(raw)
        yield raw[at:end]
        at = end


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text as a signed 64-bit number; a long text's words and hashes are held a part at a time."""
    ones, n, left = np.zeros(64, np.int64), 0, []

    def add(w: list[bytes], shingles: int, length: int) -> None:
        nonlocal ones
        line = b" ".join(w)
        size = np.fromiter(map(len, w), np.int64, len(w))
        end = np.cumsum(size + 1) - 1
        start, stop = (end - size)[:shingles], end[length - 1 : length - 1 + shingles]
        h = np.fromiter((xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, shingles)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for span in _spans((text or "").encode("utf-8", "surrogatepass")):
        w = left + span.lower().split()
        if (shingles := len(w) - words + 1) > 0:
            add(w, shingles, words)
            n += shingles
            left = w[shingles:]
        else:
            left = w
    if not n and left:  # fewer words than a shingle has
        add(left, 1, len(left))
        n = 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0]) if n else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("text")), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """(segment, key, other, fp): either half of each fingerprint with the half left over."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = F.array(F.struct(F.lit(0).alias("segment"), low.alias("key"), high.alias("other")), F.struct(F.lit(1).alias("segment"), high.alias("key"), low.alias("other")))
    return fps.select("fp", F.explode(halves).alias("s")).select("s.*", "fp")


def _flips(key: str):
    """The 32 values one bit away from ``key``."""
    return F.array(*[F.col(key).bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(32)])


def _probes(entries: DataFrame) -> DataFrame:
    """Where each fingerprint looks: its own key, and every key one bit away. Two keys one bit apart differ in parity, so only those of even parity look there."""
    even = F.bit_count("key") % 2 == 0
    keys = F.when(even, F.concat(F.array("key"), _flips("key"))).otherwise(F.array("key"))
    return entries.select("segment", "other", "fp", F.col("key").alias("own"), F.explode(keys).alias("key"))


def _pair_links(probes: DataFrame, entries: DataFrame) -> DataFrame:
    p, e = probes.select("segment", "key", "own", F.col("fp").alias("a")), entries.select("segment", "key", F.col("fp").alias("b"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS) & ((F.col("own") != F.col("key")) | (F.col("a") < F.col("b")))
    return p.join(e, ["segment", "key"]).where(near).select("a", "b")


def _hub_links(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Links that join the same fingerprints as ``_pair_links``, one for each fingerprint and hub.

    Equal keys: others may differ in 3 bits, so some hub is within 1 bit of one and within 2 of the other.
    All within 1 of a hub link to all within 2 of it. Keys one bit apart: others may differ in 2 bits, so
    some hub is within 1 of both; those that look there link to all entries there. A hub has at most 529
    (1056) members.
    """
    ball1 = F.concat(F.array("other"), _flips("other"))
    level1 = F.transform(ball1, lambda h: F.struct(h.alias("hub"), F.lit(1).alias("level")))
    pairs = F.array(*[F.lit((1 << i) | (1 << j)).cast("long") for j in range(32) for i in range(j)])
    two = F.transform(pairs, lambda m: F.col("other").bitwiseXOR(m))
    level2 = F.transform(two, lambda h: F.struct(h.alias("hub"), F.lit(2).alias("level")))
    same = entries.select("segment", "key", "fp", F.lit(0).alias("kind"), F.explode(F.concat(level1, level2)).alias("h"))
    apart = entries.select("segment", "key", "fp", F.lit(1).alias("kind"), F.explode(level1).alias("h")).unionByName(
        probes.where("own != key").select("segment", "key", "fp", F.lit(1).alias("kind"), F.explode(F.transform(ball1, lambda h: F.struct(h.alias("hub"), F.lit(2).alias("level")))).alias("h"))
    )
    hub = Window.partitionBy("kind", "segment", "key", "hub")
    met = same.unionByName(apart).select("kind", "segment", "key", "fp", "h.*")
    return met.select(F.col("fp").alias("a"), F.min("fp").over(hub).alias("b"), F.min("level").over(hub).alias("least")).where("least = 1 and a != b").select("a", "b").distinct()


def links(fps: DataFrame, hot: int = 256) -> DataFrame:
    """(a, b) that join the distinct fingerprints ``fps`` (fp) just as all pairs within ``RADIUS`` bits would."""
    entries = _segments(fps)
    crowded, told = staged_and_told(entries.groupBy("segment", "key").count().where(F.col("count") > hot).select("segment", "key"), "crowded", F.count("*").alias("n"))
    probes = _probes(entries)
    if not told["n"]:
        return _pair_links(probes, entries)
    far = [x.join(crowded, ["segment", "key"], "left_anti") for x in (probes, entries)]
    close = [x.join(crowded, ["segment", "key"], "left_semi") for x in (probes, entries)]
    return _pair_links(*far).unionByName(_hub_links(*close))


def near_duplicates(docs: DataFrame, words: int = 3, hot: int = 256) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row.

    component_id is the smallest doc_id reachable by links, null if none is there; root is a fingerprint of the component, by which it is known.
    """
    rows, size = staged_and_told(fingerprints(docs, words), "fingerprints", F.count("*").alias("n"))
    first = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")), "first")
    root = staged(connected_components(links(first.select("fp"), hot)), "roots")
    linked = first.join(root, F.col("fp") == F.col("node")).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("fp", "root", "least")
    ids = staged(first.join(moved, "fp", "left").select("fp", "times", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id")), "ids")
    share = size["n"] / HEAVY
    heavy = F.broadcast(ids.where(F.col("times") > share).select("fp", "root", "component_id"))
    rest = rows.join(heavy.select("fp"), "fp", "left_anti").join(ids.where(F.col("times") <= share).select("fp", "root", "component_id"), "fp")
    return rows.join(heavy, "fp").unionByName(rest).select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (null is the largest), then text hash. Of rows equal in both, any one."""
    each = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    chosen = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "times")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("chosen_id"), F.col("c.text_hash").alias("chosen_hash"), "c.times")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))
    here = keyed.join(chosen, F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("hash") == F.col("chosen_hash")))
    once = here.where("times = 1").select("row.*")
    again = here.where("times > 1").dropDuplicates(["id", "hash"]).select("row.*")
    return once.unionByName(again)
