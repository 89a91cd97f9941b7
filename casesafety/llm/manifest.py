"""Merkle manifest of a dataset, with leaf coordinates from bitmaps.

Each row is a leaf: SHA-256 of its fields, each ``-`` if null, else its UTF-8 length, ``:`` and the value. A source's leaves ascend by
doc_id; every ``FAN`` consecutive nodes become their digest until one is left, the subroot. The subroots, in order of source
(null first, by UTF-8 bytes), give the root likewise.

A leaf's place comes from bitmaps, not from a sort of the rows. A source's ids are a bitmap of 64-bit words, of which only those with an id
are kept; words are merged by OR as rows are aggregated. Word counts are summed up over a tree of ``1 << STEP`` words to a node,
and the sums in front of each node and word are the popcount directory; no window has more than ``1 << STEP`` rows, whatever the ids are.
The place is the directory's number and the word's bits below the id's. Words in which an id stands twice (or null) are the exception:
rows with one id stand in order of their leaves, by counts of the leaves' first bits.

Then ``FAN ** RISE`` consecutive leaves meet as one row, each in the slot of its place, and rise ``RISE`` levels at once; so
do the blocks' roots, until each source has one. On the way down each block gets the siblings above it, so a leaf's proof is made
where its block is. Texts are read once and never shuffled; the tables that are shuffled have 100 bytes or so for each row.

Null ids stand first in their source. Rows that repeat are leaves each. Texts are read whole. Extra columns are ignored. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Nodes to a digest, and levels that a block rises. Fixed by the manifest's definition; by what a task holds.
FAN, RISE = 3, 7
#: Bits of a word's number that one level of the directory takes.
STEP = 12
#: Sources that are broadcast at most, and sources in a range while they are numbered.
BROADCAST_SOURCES, RANGE_SOURCES = 100_000, 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _written(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, with another text if one is given."""
    return F.sha2(F.concat(*[_written(text if c == "text" and text is not None else F.col(c)) for c in FIELDS]), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels from n nodes to one."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def _levels(nodes: list[str], n: int, rise: int) -> list[list[str]]:
    """The levels over a block's nodes; the tree has n nodes on the block's level."""
    levels = [nodes]
    for _ in range(min(rise, height(n))):
        levels.append([digest(levels[-1][k : k + FAN]) for k in range(0, len(levels[-1]), FAN)])
    return levels


def _siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """For each level but the last, what stands in the node's run before and after it."""
    before, after = [], []
    for level in levels[:-1]:
        run = at - at % FAN
        before.append("".join(level[run:at]))
        after.append("".join(level[at + 1 : run + FAN]))
        at //= FAN
    return before, after


def _hex(raw: bytes) -> list[str]:
    whole = raw.hex()
    return [whole[k : k + 64] for k in range(0, len(whole), 64)]


def _facts(docs: DataFrame, changed: Column) -> DataFrame:
    """(key, doc_id, word, bit, leaf, changed); the key orders sources as the manifest does."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    doc = F.col("doc_id").cast("long")
    other = F.when(changed.isNotNull(), F.unhex(leaf(changed)))
    return docs.select(key.alias("key"), doc.alias("doc_id"), F.shiftright(doc, 6).alias("word"), doc.bitwiseAND(F.lit(63)).cast("int").alias("bit"), F.unhex(leaf()).alias("leaf"), other.alias("changed"))


def _directory(facts: DataFrame) -> tuple[DataFrame, int]:
    """(key, word, bits, n, start) for each word of each source, start being the number of rows in front of it; and the number that null ids have as a word."""
    low, high = facts.agg(F.min("word"), F.max("word")).first()
    low, high = (0, 0) if low is None else (low, high)
    none = low - 1
    bits = F.coalesce(F.bit_or(F.expr("shiftleft(1L, bit)")), F.lit(0).cast("long"))
    words = staged(facts.groupBy("key", F.coalesce("word", F.lit(none)).alias("word")).agg(bits.alias("bits"), F.count("*").alias("n")), "words")
    # Counts by node, from the words up to the level that has one node.
    at = words.select("key", "word", (F.col("word") - none).alias("p0"), "n")
    depth = max(1, -(-(high - none + 1).bit_length() // STEP))
    levels = [at]
    for k in range(1, depth):
        levels.append(levels[-1].groupBy("key", F.shiftright(f"p{k - 1}", STEP).alias(f"p{k}")).agg(F.sum("n").alias("n")))
    start = None
    for k in reversed(range(depth)):
        own = levels[k].withColumn("up", F.shiftright(f"p{k}", STEP))
        placed = own.withColumn("before", F.sum("n").over(Window.partitionBy("key", "up").orderBy(f"p{k}")) - F.col("n"))
        if start is not None:
            placed = placed.join(start.withColumnRenamed(f"p{k + 1}", "up"), ["key", "up"]).withColumn("before", F.col("before") + F.col("start")).drop("start")
        start = placed.select("key", *(["word"] if not k else []), f"p{k}", F.col("before").alias("start"))
    return staged(words.join(start.drop("p0"), ["key", "word"]), "directory"), none


def _places(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, leaf, changed, place) of each row, and (key, n) of each source."""
    directory, none = _directory(facts)
    keyed = facts.withColumn("word", F.coalesce("word", F.lit(none)))
    alone = F.bit_count("bits") == F.col("n")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)"))))
    placed = keyed.join(directory.where(alone), ["key", "word"]).select("key", "doc_id", "leaf", "changed", (F.col("start") + below).alias("place"))
    crowded = directory.where(~alone).select("key", "word", "start")
    if not crowded.isEmpty():
        rows = keyed.join(crowded, ["key", "word"])
        # Equal rows are one until they are placed.
        same = ["key", "word", "start", "doc_id"]
        each = staged(rows.groupBy(*same, "leaf", "changed").agg(F.count("*").alias("times")).withColumn("bin", F.substring(F.hex("leaf"), 1, 3)), "crowded")
        bins = each.groupBy(*same, "bin").agg(F.sum("times").alias("n"))
        ids = bins.groupBy(*same).agg(F.sum("n").alias("n")).withColumn("id_start", F.sum("n").over(Window.partitionBy("key", "word").orderBy(F.col("doc_id").asc_nulls_first())) - F.col("n"))
        bins = bins.withColumn("bin_start", F.sum("n").over(Window.partitionBy("key", "word", "doc_id").orderBy("bin")) - F.col("n")).drop("n")
        i, b = ids.select("key", "word", F.col("doc_id").alias("its"), "id_start"), bins.select("key", "word", F.col("doc_id").alias("its"), "bin", "bin_start")
        own = F.sum("times").over(Window.partitionBy("key", "word", "doc_id", "bin").orderBy("leaf", "changed").rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")
        found = each.withColumn("own", own)
        for other, on in ((i, ["key", "word"]), (b, ["key", "word", "bin"])):
            found = found.alias("f").join(other.alias("o"), [F.col(f"f.{c}") == F.col(f"o.{c}") for c in on] + [F.col("f.doc_id").eqNullSafe(F.col("o.its"))]).select("f.*", *[c for c in other.columns if c.endswith("_start")])
        first = F.col("start") + F.col("id_start") + F.col("bin_start") + F.col("own")
        placed = placed.unionByName(found.select("key", "doc_id", "leaf", "changed", F.explode(F.sequence(first, first + F.col("times") - 1)).alias("place")))
    return placed, directory.groupBy("key").agg(F.sum("n").alias("n"))


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with each one's place in order of its key; sorted in ranges."""
    ranges = sources.count() // RANGE_SOURCES + 1
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = staged(sources.repartitionByRange(ranges, "key").sortWithinPartitions("key").select("*", F.spark_partition_id().alias("range"), at.alias("at")), "sources")
    size = ordered.groupBy("range").agg(F.count("*").alias("size"))
    starts = size.select("range", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("size")).alias("first"))  # a row for each range
    return staged(ordered.join(F.broadcast(starts), "range").withColumn("place", F.col("first") + F.col("at")).drop("range", "at", "first"), "numbered")


def _block_schema(leaves: bool) -> str:
    return "key string, n long, block long, nodes binary, root string" + (", ids array<long>, changed array<binary>" if leaves else "")


def _blocks(nodes: DataFrame, leaves: bool, rise: int) -> DataFrame:
    """(key, n, block, nodes, root) of ``nodes`` (key, n, place, node), where n is how many its source has on this level; with ids and changed leaves on the lowest."""
    wide = FAN**rise
    slot = F.struct((F.col("place") % wide).cast("int").alias("slot"), "node", *(["doc_id", "changed"] if leaves else []))
    held = nodes.groupBy("key", "n", F.floor(F.col("place") / wide).alias("block")).agg(F.collect_list(slot).alias("slots"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column("slots"), []
            at = lists.offsets.to_pylist()
            parts = [lists.values.field(k).to_pylist() for k in range(4 if leaves else 2)]
            for k, n in enumerate(b.column("n").to_pylist()):
                order = [0] * (at[k + 1] - at[k])  # each node goes to its slot
                for i in range(at[k], at[k + 1]):
                    order[parts[0][i]] = i
                raw = b"".join(parts[1][i] for i in order)
                out.append((raw, _levels(_hex(raw), n, rise)[-1][0], *([p[i] for i in order] for p in parts[2:])))
            kinds = (pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary()))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)] if out else [pa.array([], t) for t in kinds[: 4 if leaves else 2]]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("key", "n", "block")] + cols, names=["key", "n", "block", "nodes", "root", *(["ids", "changed"] if leaves else [])])

    return staged(held.mapInArrow(up, _block_schema(leaves)), "blocks")


def _risen(lowest: DataFrame, most: int, rise: int) -> list[DataFrame]:
    """The blocks of every round, the lowest first; the largest source has ``most`` nodes."""
    rounds, wide = [lowest], FAN**rise
    while most > wide:
        most = -(-most // wide)
        up = rounds[-1].where(F.col("n") > wide)
        rounds.append(_blocks(up.select("key", F.ceil(F.col("n") / wide).alias("n"), F.col("block").alias("place"), F.unhex("root").alias("node")), False, rise))
    return rounds


def _tops(rounds: list[DataFrame], rise: int) -> DataFrame:
    """(key, subroot): the root of each source's one block on its last round."""
    out = None
    for r in rounds:
        one = r.where(F.col("n") <= FAN**rise).select("key", F.col("root").alias("subroot"))
        out = one if out is None else out.unionByName(one)
    return out


def _paths(rounds: list[DataFrame], tops: DataFrame, rise: int) -> DataFrame:
    """(key, block, subroot, before, after): the siblings above each block of the lowest round, from ``tops`` (key, subroot, before, after)."""

    wide = FAN**rise

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, n, block, raw, subroot, up_before, up_after in zip(*[c.to_pylist() for c in b.columns], strict=True):
                nodes = _hex(raw)
                levels = _levels(nodes, n, rise)
                paths = [_siblings(levels, k) for k in range(len(nodes))]
                cols = [[key] * len(nodes), [block * wide + k for k in range(len(nodes))], [subroot] * len(nodes), [x + up_before for x, _ in paths], [y + up_after for _, y in paths]]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "block", "subroot", "before", "after"])

    above = None
    for k in reversed(range(len(rounds))):
        whole = rounds[k].where(F.col("n") <= wide).select("key", "block").join(tops, "key")
        above = whole if above is None else whole.unionByName(above)
        if k:
            met = rounds[k].select("key", "n", "block", "nodes").join(above, ["key", "block"]).select("key", "n", "block", "nodes", "subroot", "before", "after")
            above = met.mapInArrow(descend, "key string, block long, subroot string, before array<string>, after array<string>")
    return above


def manifest(docs: DataFrame, changed: Column | None = None, rise: int = RISE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each of ``docs`` (doc_id, source, lang, n_chars, text).

    ``changed`` is the text that a row has been tampered with to, null where it hasn't been. The proof is the digest of the row's siblings, level by
    level up to the root; folded_root is what they and the row as it is now give, and verified tells if that is the root.
    """
    facts = staged(_facts(docs, F.lit(None).cast("string") if changed is None else changed), "leaves")
    placed, sizes = _places(facts)
    sources = _numbered(sizes)
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    small = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    leaves = _blocks(placed.join(small.select("key", "n"), "key").select("key", "n", "place", F.col("leaf").alias("node"), "doc_id", "changed"), True, rise)
    rounds = _risen(leaves, most, rise)
    tops = staged(_tops(rounds, rise).join(sources.select("key", "place"), "key"), "tops")
    # The subroots are the leaves of one more tree, whose paths go on from each source's.
    over = _risen(_blocks(tops.select(F.lit("").alias("key"), F.lit(n_sources).cast("long").alias("n"), "place", F.unhex("subroot").alias("node")), False, rise), n_sources, rise)
    root = (_tops(over, rise).first() or [None, None])[1]
    nothing = F.array().cast("array<string>")
    start = over[-1].select("key", F.lit("").alias("subroot"), nothing.alias("before"), nothing.alias("after"))
    down = _paths([over[0].limit(0).select("key", "n", "block", "nodes"), *over], start, rise).select(F.col("block").alias("place"), "before", "after")
    tops = tops.join(down, "place").select("key", "subroot", "before", "after")
    met = leaves.join(_paths(rounds, tops, rise), ["key", "block"]).select("n", "nodes", "ids", "changed", "subroot", "before", "after")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, raw, ids, others, subroot, up_before, up_after in zip(*[c.to_pylist() for c in b.columns], strict=True):
                nodes = _hex(raw)
                levels = _levels(nodes, n, rise)
                rest, out = "".join(x + y for x, y in zip(up_before, up_after, strict=True)), []
                for k, (doc, node, other) in enumerate(zip(ids, nodes, others, strict=True)):
                    before, after = _siblings(levels, k)
                    proof = "".join(x + y for x, y in zip(before, after, strict=True)) + rest
                    now = node if other is None else other.hex()
                    for x, y in (*zip(before, after, strict=True), *zip(up_before, up_after, strict=True)):
                        now = digest([x, now, y])
                    out.append((doc, node, subroot, root, digest([proof]), now, now == root))
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return met.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def without_newlines() -> Column:
    """The text without its line feeds where the CRC of doc_id is even; null where that changes nothing."""
    text = F.col("text").cast("string")
    return F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & text.contains("\n"), F.translate(text, "\n", ""))
