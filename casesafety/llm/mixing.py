"""Mixing sources to target weights by weighted fair queueing.

Every source has a target in words: its share by weight of all words, at most ``repeats`` times its own
size, the excess shared again by weight among the others. A source's documents stand in a shuffled order
(by a hash of the id), pass after pass. A document's virtual finish time is the source's words up to and
with it, divided by the source's target. All documents of all sources are range-sorted by finish time and
the sequence is cut where the total budget, the sum of the targets, is reached; the document at the cut is
taken in part. Nothing is random: reruns agree.

Prefix sums run over many small ranges (by hash within a source, by finish time over all), whose number
grows with the rows, so that no task gets a source's or the table's rows as a whole. Rows alike in doc_id, size and keys are
counted before that, and told apart again by their number: one id (or none) on a third of all rows is one row of a range for each of its sizes and keys.

Null texts and texts of white space have size 0 and are never taken. A null source is a source of its own,
the last. Rows that repeat, doc_ids too, are documents of their own. Texts are counted whole, however long. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, staged, staged_and_told

#: Rows of a source that a range holds about; the hash has so many bits; ranges under one sum; like rows that a task makes of their count at a time.
RANGE_ROWS, HASH_BITS, UNDER, COPIES = 512, 52, 1024, 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeats: int = 3) -> DataFrame:
    """(source, rank, source_size, target), one row for each source; ``weights`` repeat in order of the sources' code points."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    shares = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats).withColumn("total", F.sum("source_size").over(everything))
    # Filled from the source that reaches its limit first: the level is what each unit of weight gets.
    filling = everything.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("total") - before) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    leveled = shares.withColumn("level", level)
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return leveled.select("source", "rank", "source_size", F.least(F.col("most").cast("double"), reached * F.col("weight")).alias("target"))


def _before(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """(by, place, base): the words of ``rows`` in earlier places. ``UNDER`` places are summed up first, so that no window holds them all."""
    each = rows.groupBy(*by, F.floor(F.col(place) / UNDER).alias("shelf"), place).agg(F.sum("size").alias("words"))
    shelves = each.groupBy(*by, "shelf").agg(F.sum("words").alias("shelf_words"))
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("shelf")
    earlier = shelves.select(*by, "shelf", (F.sum("shelf_words").over(over) - F.col("shelf_words")).alias("shelf_base"))
    within = F.sum("words").over(Window.partitionBy(*by, "shelf").orderBy(place)) - F.col("words")
    return each.join(earlier, [*by, "shelf"]).select(*by, place, (F.col("shelf_base") + within).alias("base"))


def _each(queued: DataFrame) -> DataFrame:
    """A row for each of the ``copies`` of a row, ``upto`` counted back from the last of them; many copies are dealt to several tasks."""
    few = queued.where(F.col("copies") <= COPIES).withColumn("part", F.lit(0).cast("long"))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))
    many = queued.where(F.col("copies") > COPIES).withColumn("part", F.explode(parts)).repartition("order", "size", "part")
    first = F.col("part") * COPIES
    later = F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1))
    each = few.unionByName(many).withColumn("later", later)
    return each.withColumn("upto", F.col("upto") - F.col("later") * F.col("size")).drop("copies", "part", "later")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeats: int = 3, seed: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, keys, size, source_size, target, taken) for each row of ``docs`` (doc_id, source, text, keys); taken counts repeats.

    ``keys`` are columns that tell apart rows with the same doc_id; rows equal in doc_id and size stand in their order.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")))
    order = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    sized = docs.select("doc_id", F.col("source").cast("string"), *keys, n_words(F.col("text")).alias("size"), order.alias("order"))
    sizes, whole = staged_and_told(sized, "sizes", F.count("*").alias("rows"), F.sum("size").alias("words"))
    targets, known = staged_and_told(source_targets(sizes, weights, repeats), "targets", F.count("*").alias("sources"))
    sources = known["sources"]
    bits = min(HASH_BITS, max(0, (whole["rows"] // RANGE_ROWS).bit_length()))
    named = sizes.join(F.broadcast(targets) if sources <= 10_000 else targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])

    # The source's words up to and with each document, in shuffled order.
    words = named.where("size > 0").withColumn("range", F.shiftright("order", HASH_BITS - bits))
    like = words.groupBy(*words.columns).agg(F.count("*").alias("copies"))
    own = Window.partitionBy("rank", "range").orderBy("order", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("base") + F.sum(F.col("size") * F.col("copies")).over(own)
    queued = like.join(_before(words, ["rank"], "range"), ["rank", "range"]).withColumn("upto", upto).drop("base")
    queued = _each(staged(queued, "queued"))  # read often below; it holds no texts

    # Each pass that starts before the budget's virtual time (1) is one more document in the queue.
    started = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: (k * F.col("source_size") + F.col("upto") - F.col("size")) < F.col("target"))
    passes = queued.withColumn("pass", F.explode(started))
    finish = (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target")
    n = max(1, 1 << bits)
    timed = passes.withColumn("finish", finish).withColumn("slot", F.floor(F.least("finish", F.lit(1.0)) * n))
    queue = Window.partitionBy("slot").orderBy("finish", "rank", "pass", "upto").rowsBetween(Window.unboundedPreceding, 0)
    placed = timed.join(_before(timed, [], "slot"), "slot").withColumn("place", F.col("base") + F.sum("size").over(queue))
    budget = whole["words"] or 0
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - (F.col("place") - F.col("size"))))
    columns = ["doc_id", "source", *keys, "size", "source_size", "target"]
    taken = placed.groupBy(*columns, "upto").agg(F.sum(part).cast("long").alias("taken")).select(*columns, "taken")
    # Documents of size 0, and those whose first pass would start after the cut.
    never = named.where("size = 0").unionByName(queued.where(F.col("upto") - F.col("size") >= F.col("target")).select(named.columns))
    return taken.unionByName(never.select(*columns, F.lit(0).cast("long").alias("taken")))
