"""Tokens, n-grams, vocabulary and TF-IDF in long form: one row for each term of a response."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Characters of the texts that one task counts about; its tables of terms stay below some hundred MB.
TASK_CHARS = 1 << 23
#: Words whose n-grams are counted at a time.
PIECE_WORDS = 1 << 20
#: Odd multiplier of an n-gram's hash before its next word's is added.
SPREAD = 0x9E3779B97F4A7C15
#: Rows of sums that a task adds up before they are shuffled.
MERGE_ROWS = 1 << 21
#: Hashed sums that are added up at a time.
SLICE = 1 << 16


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """Space-joined n-grams of ``low`` to ``high`` words, shorter ones first. ``words`` should be a column, not an expression, which would be computed anew for each n-gram."""
    found, grams = [], words
    for n in range(1, high + 1):
        if n > 1:  # each shorter one, but the last, and the word after it
            rest = F.greatest(F.size(words) - (n - 1), F.lit(0))
            grams = F.zip_with(F.slice(grams, 1, rest), F.slice(words, n, rest), lambda gram, word: F.concat(gram, F.lit(" "), word))
        if n >= low:
            found.append(grams)
    return F.concat(*found)


def with_terms(df: DataFrame, text_col: str, low: int = 1, high: int = 2) -> DataFrame:
    """``df`` with the array ``terms`` of its text's n-grams."""
    return df.withColumn("_words", tokens(F.col(text_col))).withColumn("terms", ngrams(F.col("_words"), low, high)).drop("_words")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Ids and words of consecutive rows, about ``PIECE_WORDS`` words at a time, or one row of more."""
    for batch in batches:
        ids, words = batch.columns
        upto, at = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_WORDS, "right")))
            yield ids.slice(at, end - at), words.slice(at, end - at)
            at = end


def _hashes(names: pa.Array) -> np.ndarray:
    """64 bits of each word, the same in every process."""
    return pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _places(words: pa.ListArray, low: int, high: int, bits: int) -> Iterator[np.ndarray]:
    """For each n the place among 2^bits sums of every n-gram that stands in the rows, repeats included; no n-gram is put together."""
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    word = gram = _hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    for n in range(1, high + 1):
        if n > 1:
            gram = gram[: len(word[n - 1 :])] * np.uint64(SPREAD) + word[n - 1 :]
        if n >= low:
            yield (gram[row[n - 1 :] == row[: len(gram)]] >> np.uint64(64 - bits)).astype(np.int64)


def _grams(words: pa.ListArray, low: int, high: int, keep: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each n the different n-grams, and (row, place of the n-gram among them) with the times it stands in the row. With ``keep`` (a flag for each of the
    ``_places``) only those of flagged places are counted."""
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    word, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    gram, grams, inside = word, names, np.ones(len(word), bool)
    if keep is not None:
        shift = np.uint64(64 - (len(keep) - 1).bit_length())
        hashed = mixed = _hashes(names)[word]
        flagged = keep[(mixed >> shift).astype(np.int64)]
    for n in range(1, high + 1):
        if n > 1:
            last = word[n - 1 :]
            inside = row[n - 1 :] == row[: len(last)]
            if keep is not None:
                mixed = mixed[: len(last)] * np.uint64(SPREAD) + hashed[n - 1 :]
                flagged = inside & keep[(mixed >> shift).astype(np.int64)]
                if n == high:  # no longer n-gram is made of these
                    inside = flagged
            pairs = pa.array((gram[: len(last)] * len(names) + last)[inside]).dictionary_encode()
            known = pairs.dictionary.to_numpy(zero_copy_only=False)
            grams = pc.binary_join_element_wise(grams.take(pa.array(known // max(1, len(names)))), names.take(pa.array(known % max(1, len(names)))), " ")
            gram = np.zeros(len(last), np.int64)  # where a row ends, no longer n-gram starts either
            gram[inside] = pairs.indices.to_numpy(zero_copy_only=False)
        counted = inside if keep is None else flagged
        there, code = row[: len(gram)][counted], gram[counted]
        if n >= low and len(code):
            key, times = np.unique(there * len(grams) + code, return_counts=True)
            yield grams, key, times


def _merged(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """Sums of the other columns by ``keys`` over consecutive rows, about ``MERGE_ROWS`` at a time."""

    def sums() -> Iterator[pa.RecordBatch]:
        names = some[0].schema.names
        added = pa.Table.from_batches(some).group_by(list(keys), use_threads=False).aggregate([(x, "sum") for x in names if x not in keys])
        yield from added.select([x if x in keys else f"{x}_sum" for x in names]).rename_columns(names).to_batches()

    some, rows = [], 0
    for batch in batches:
        some.append(batch)
        rows += batch.num_rows
        if rows >= MERGE_ROWS:
            yield from sums()
            some, rows = [], 0
    if some:
        yield from sums()


def _counted(df: DataFrame, id_col: str, text_col: str, low: int, high: int, kept: Callable[[], np.ndarray | None] = lambda: None) -> DataFrame:
    """(id, term, tf) of each row by itself; nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = kept()
        for ids, words in _pieces(batches):
            for grams, key, times in _grams(words, low, high, keep):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(key // len(grams))), grams.take(pa.array(key % len(grams))), pa.array(times)], names=[id_col, "term", "tf"])

    words = df.select(id_col, tokens(F.col(text_col)).alias("_words"))
    return words.mapInArrow(count, T.StructType([words.schema[id_col], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def _totals(df: DataFrame, id_col: str, text_col: str, low: int, high: int, kept: Callable[[], np.ndarray | None] = lambda: None) -> DataFrame:
    """(term, df, tf) added up over some rows at a time, before any term leaves its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = kept()
        for _, words in _pieces(batches):
            for grams, key, times in _grams(words, low, high, keep):
                at = key % len(grams)
                sums = [np.bincount(at, minlength=len(grams)), np.bincount(at, times, len(grams)).astype(np.int64)]
                if keep is not None:
                    seen = np.flatnonzero(sums[0])
                    grams, sums = grams.take(pa.array(seen)), [x[seen] for x in sums]
                yield pa.RecordBatch.from_arrays([grams, *map(pa.array, sums)], names=["term", "df", "tf"])

    words = df.select(id_col, tokens(F.col(text_col)).alias("_words"))
    return words.mapInArrow(lambda batches: _merged(count(batches), "term"), "term string, df long, tf long")


def _summed(parts: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Sums of the other columns of what ``_merged`` gives, by ``keys``, in ``tasks`` tasks. The session's number of shuffle partitions doesn't grow with the texts; this does, so
    a task's table of sums stays as large as it is."""
    return parts.repartition(tasks, *keys).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in parts.columns if x not in keys])


def _dealt(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows whose id no other row has, dealt out by it with about ``TASK_CHARS`` characters to a task; the other rows, if there are any; and the number of such tasks."""
    rows = df.select(id_col, text_col)
    per = rows.groupBy(id_col).agg(F.count("*").alias("_rows"), F.sum(F.length(text_col)).alias("_chars"))
    most, chars = per.agg(F.max("_rows"), F.sum("_chars")).first()
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-(chars or 0) // TASK_CHARS))
    if (most or 0) < 2:
        return rows.repartition(n, id_col), None, n
    often = per.where("_rows > 1").select(F.col(id_col).alias("_often"))
    same = F.col(id_col).eqNullSafe(F.col("_often"))
    return rows.join(often, same, "left_anti").repartition(n, id_col), rows.join(often, same, "left_semi").repartition(n), n


def term_counts(df: DataFrame, id_col: str, text_col: str, low: int = 1, high: int = 2) -> DataFrame:
    """(id, term, tf) counted within each id's text.

    Texts, not terms, are dealt out by id, and what groups by it again needs no further shuffle. Only the terms of ids that several rows have are shuffled and added up.
    """
    once, again, tasks = _dealt(df, id_col, text_col)
    counts = _counted(once, id_col, text_col, low, high)
    return counts if again is None else counts.unionByName(_counted_again(again, tasks, id_col, text_col, low, high))


def _counted_again(again: DataFrame, tasks: int, id_col: str, text_col: str, low: int, high: int, kept: Callable[[], np.ndarray | None] = lambda: None) -> DataFrame:
    """(id, term, tf) of rows whose ids others have, too."""
    counts = _counted(again, id_col, text_col, low, high, kept)
    return _summed(counts.mapInArrow(lambda batches: _merged(batches, id_col, "term"), counts.schema), tasks, id_col, "term")


def term_totals(df: DataFrame, id_col: str, text_col: str, low: int = 1, high: int = 2) -> DataFrame:
    """(term, df, tf): ids whose texts have a term, and how often it stands there; the sums of ``term_counts``, without a row for each id and term."""
    return _added(*_dealt(df, id_col, text_col), id_col, text_col, low, high)


def _added(once: DataFrame, again: DataFrame | None, tasks: int, id_col: str, text_col: str, low: int, high: int, kept: Callable[[], np.ndarray | None] = lambda: None) -> DataFrame:
    parts = _totals(once, id_col, text_col, low, high, kept)
    if again is not None:
        counts = _counted_again(again, tasks, id_col, text_col, low, high, kept).select("term", F.lit(1).cast("long").alias("df"), "tf")
        parts = parts.unionByName(counts.mapInArrow(lambda batches: _merged(batches, "term"), "term string, df long, tf long"))
    return _summed(parts, tasks, "term")


def _reached(df: DataFrame, text_col: str, low: int, high: int, bits: int, least: int) -> np.ndarray:
    """A bit for each of 2^bits hashed sums over all texts, set where it is ``least`` or more. A task keeps its own sums, so few tasks do; only the bits come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.int64)
        for _, words in _pieces(batches):
            for place in _places(words, low, high, bits):
                np.add.at(sums, place, 1)
        for at in range(0, len(sums), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sums[at : at + SLICE].tobytes()], pa.binary())], names=["at", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, sums in zip(batch["at"].to_pylist(), batch["sums"], strict=True):
                part = np.frombuffer(sums.as_buffer(), np.int64)
                found[at] = found[at] + part if at in found else part
        for at, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["at", "bits"])

    spark = df.sparkSession
    words = df.select(F.lit(0).alias("id"), tokens(F.col(text_col)).alias("_words")).coalesce(2 * spark.sparkContext.defaultParallelism)
    parts = words.mapInArrow(count, "at long, sums binary").repartition(max(1, (1 << bits) // SLICE // 8), "at")
    rows = parts.mapInArrow(add, "at long, bits binary").collect()
    return np.frombuffer(b"".join(bytes(r["bits"]) for r in sorted(rows, key=lambda r: r["at"])) or bytes((1 << bits) // 8), np.uint8)


def vocabulary(counts: DataFrame, min_df: int = 2, max_features: int = 30000) -> DataFrame:
    """(term, df, tf, idx): the ``max_features`` most frequent terms that at least ``min_df`` rows have; ties go by term, idx is its place by term."""
    return vocabulary_of_totals(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), min_df, max_features)


def vocabulary_of_totals(totals: DataFrame, min_df: int = 2, max_features: int = 30000) -> DataFrame:
    """``vocabulary`` from (term, df, tf)."""
    top = totals.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(max_features)
    return top.select("term", "df", "tf", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"))  # over a bounded list


def vocabulary_of_candidates(counts: DataFrame, id_col: str, min_df: int = 2, max_features: int = 30000, buckets: int = 1 << 20, share: int = 16) -> DataFrame:
    """The rows of ``vocabulary`` from (id, term, tf), with exact counts of those terms only that can be among them.

    Terms are first counted by a hash, in at most ``buckets`` sums, each an upper bound of its terms' counts. The counts over one id in ``share`` are
    lower bounds; the ``max_features``-th largest of them (of terms that have ``min_df`` there) is a bound that the list's last term reaches. A term whose bucket is below
    that, or below ``min_df``, isn't on the list, so no term is lost, and what is shuffled term by term is a sample and the candidates.
    ``counts`` is read three times, so it should be stored; from texts, ``vocabulary_of_texts`` makes no row for each id and term.
    """
    place = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("place")
    some = counts.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(share)) == 0).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= min_df)
    n, least = some.select("tf").orderBy(F.desc("tf")).limit(max_features).agg(F.count("*"), F.min("tf")).first()
    sums = counts.groupBy(place).agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    kept = sums.where((F.col("df") >= min_df) & (F.col("tf") >= (least if n == max_features else 0))).select("place")
    return vocabulary(counts.withColumn("place", place).join(F.broadcast(kept), "place", "left_semi").drop("place"), min_df, max_features)


def vocabulary_of_texts(df: DataFrame, id_col: str, text_col: str, low: int = 1, high: int = 2, min_df: int = 2, max_features: int = 30000, bits: int = 22, share: int = 8) -> DataFrame:
    """The rows of ``vocabulary``, of which only the terms that can be among them are counted one by one.

    The texts are read twice. First every n-gram is added to one of 2^``bits`` sums by a hash of its words, an upper bound of its terms' counts. The counts over one id in
    ``share`` are lower bounds; the ``max_features``-th largest of them (of terms that ``min_df`` ids have there) is a bound that the list's last term reaches.
    Then the n-grams whose sums reach it are counted exactly; a term whose sum is below it isn't on the list, so none is lost. Both bounds grow with the texts alike, so
    the share of candidates doesn't. Where the sample has too few terms for a bound, all are counted.
    """
    some = term_totals(df.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(share)) == 0), id_col, text_col, low, high).where(F.col("df") >= min_df)
    n, least = some.select("tf").orderBy(F.desc("tf")).limit(max_features).agg(F.count("*"), F.min("tf")).first()
    once, again, tasks = _dealt(df, id_col, text_col)
    if n < max_features:
        return vocabulary_of_totals(_added(once, again, tasks, id_col, text_col, low, high), min_df, max_features)
    reached = _reached(once if again is None else once.unionByName(again), text_col, low, high, bits, least)
    flags = df.sparkSession.sparkContext.broadcast(reached)
    totals = _added(once, again, tasks, id_col, text_col, low, high, lambda: np.unpackbits(flags.value).astype(bool))
    return vocabulary_of_totals(totals.where(F.col("tf") >= F.lit(least)), min_df, max_features)


def tfidf(counts: DataFrame, vocab: DataFrame, n_rows: int, id_col: str) -> DataFrame:
    """(id, idx, value): tf * (ln((1 + n) / (1 + df)) + 1), rows of length 1."""
    idf = F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + F.col("df"))) + 1.0
    raw = counts.join(F.broadcast(vocab.select("term", "idx", "df")), "term").select(id_col, "idx", (F.col("tf") * idf).alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "idx", (F.col("value") / norm).alias("value"))
