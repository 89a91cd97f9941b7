"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: the likelihood of the visible text under a character n-gram
model of each language; the likelihood of the language that the markup declares; that of the address's last
suffix; and a prior of the host. The last three are estimated by grouped aggregation over all pages, from
the languages that the texts alone make likely, without the page that is judged itself. A host's prior is smoothed
towards that of its domain, the domain's towards that of all pages, so a host with few pages borrows from its
surroundings. A domain is the last two labels of a host, or three where the last two are a shared suffix (``co.uk``).

The n-gram model is naive Bayes over hashed 1- to 3-grams of lower-cased characters, fitted on about
``max_fit_rows`` labelled texts of each language, those with the smallest hash of the id (all rows of these ids).
It has ``CELLS`` numbers at most: with more than 256 languages n-grams share buckets. Its evidence grows
with the text up to about ``most`` n-grams, since n-grams of a text aren't independent.

Null or empty pages, and pages without a declaration or an address, have what evidence is left. Without any
labelled text the language is null. Of languages with equal evidence the first by name is taken. Pages are read whole,
in time proportional to their length, and in parts, so that memory is the page's own. Rows that repeat are judged each; extra columns are
ignored; an empty table of pages gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .features import char_ngrams
from .markup import visible_text

#: Numbers in the n-gram model, and buckets of a language as a power of two, at most.
CELLS, BITS = 1 << 24, 16
#: Numbers in the evidence around pages (combinations of host, suffix and declaration by languages) that are broadcast at most; more are joined by shuffle.
BROADCAST_NUMBERS = 400_000
#: Numbers of the model that are laid out for a page at a time.
GATHER = 1 << 21
#: Rows of languages, or of ids to be fitted on, that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Parts that a combination's pages are dealt to in that shuffle; languages that are aggregated as columns of their own.
PARTS, WIDE = 16, 64
#: Labels below a country's that many owners share. Fixed values.
SHARED = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ltd", "me", "ne", "net", "nom", "or", "org", "plc", "sch")


def _grams(text: str, bits: int) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, in parts of bounded size."""
    if text:
        for g in char_ngrams(f" {text.lower()} ", range(1, 4), 48):
            yield g & np.uint32((1 << bits) - 1)


def _counted(text: str, bits: int) -> np.ndarray:
    """How often each bucket occurs in a text."""
    n = np.zeros(1 << bits, np.int64)
    for g in _grams(text, bits):
        n += np.bincount(g, minlength=1 << bits)
    return n


def fit_ngrams(docs: DataFrame, max_fit_rows: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages in order, and for each a row of ln P(n-gram | language), at most ``CELLS`` numbers in all."""
    here = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null")
    ids = here.select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("order"))
    # About as many rows as are wanted are taken by a threshold on the hash, so no task gets a language as a whole.
    share = staged(ids.groupBy("lang").agg((F.lit(1.2 * max_fit_rows) / F.count("*")).alias("share")), "languages")
    n = share.count()
    if not n:
        return [], np.zeros((0, 2), np.float32)
    bits = max(1, min(BITS, (CELLS // n).bit_length() - 1))
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    few = ids.join(small(share, n), "lang").where(F.pmod("order", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    least = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 30)), "doc_id"))).where(F.col("n") <= max_fit_rows).select("lang", "doc_id").distinct()
    sample = here.join(small(least, n * max_fit_rows), ["lang", "doc_id"])  # texts aren't shuffled

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                n = _counted(text or "", bits)
                g = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int32), "n": n[g]})

    def logs(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.full(1 << bits, 0.1)
        known = pdf[pdf["gram"].notna()]
        n[known["gram"].to_numpy(np.int64)] += known["n"].to_numpy(np.float64)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "logs": [np.log(n / n.sum()).astype(np.float32).tobytes()]})

    counts = sample.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    every = share.select("lang").join(counts, "lang", "left")  # a language of empty texts is one, too
    rows = sorted(every.groupBy("lang").applyInPandas(logs, "lang string, logs binary").collect())
    return [r["lang"] for r in rows], np.stack([np.frombuffer(r["logs"], np.float32) for r in rows])


def text_evidence(pages: DataFrame, table: np.ndarray, most: float):
    """UDF from html to one ln likelihood for each language, shifted so that the largest is 0."""
    kept = pages.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = kept.value
        bits = rows.shape[1].bit_length() - 1
        for htmls in batches:
            out = []
            for h in htmls:
                text = visible_text(h)
                if len(text) * len(rows) <= GATHER:
                    parts = list(_grams(text, bits))
                    n, e = sum(map(len, parts)), np.zeros(len(rows))
                    for g in parts:
                        e += rows[:, g].sum(axis=1, dtype=np.float64)
                else:  # a long page, or many languages: the page's counts times the model, a bounded part of it at a time
                    counts = _counted(text, bits)
                    g = np.flatnonzero(counts)
                    n, e = int(counts.sum()), np.zeros(len(rows))
                    for k in range(0, len(g), max(1, GATHER // len(rows))):
                        part = g[k : k + max(1, GATHER // len(rows))]
                        e += rows[:, part].astype(np.float64) @ counts[part]
                e = e / max(1, n) * (n * most / (n + most))
                out.append((e - e.max(initial=-np.inf)).tolist() if len(e) else [])
            yield pd.Series(out)

    return evidence


def address_parts(url):
    """(host, domain, suffix) of an address; '' where there is none."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    shared = host.rlike(rf"\.(?:{'|'.join(SHARED)})\.[a-z]{{2}}$")
    return host, F.when(shared, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)), F.substring_index(host, ".", -1)


def declared(html):
    """The primary language that the html element declares, in lower case; '' if none."""
    return F.coalesce(F.lower(F.regexp_extract(F.substring_index(html, "<body", 1), r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-zA-Z]+)""", 1)), F.lit(""))


def _sums(df: DataFrame, keys: list[str], column: str, size: int, name: str) -> DataFrame:
    """(keys, name): the sum of the arrays ``column`` of ``size`` numbers for each of the keys."""
    if size <= WIDE:
        wide = df.groupBy(*keys).agg(*[F.sum(F.element_at(column, k + 1)).alias(f"n{k}") for k in range(size)])
        return wide.select(*keys, F.array(*[f"n{k}" for k in range(size)]).alias(name))
    each = df.select(*keys, F.posexplode(column).alias("k", "x")).groupBy(*keys, "k").agg(F.sum("x").alias("x"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s")).select(*keys, F.transform("s", lambda e: e["x"]).alias(name))


def _log_given(n: str, share: str, whole: str, smooth: float, size: int) -> str:
    """SQL for ln P(key | language), smoothed over the keys there are and one more, without the page itself."""
    return f"ln(({n} - {share} + {smooth}D) / ({whole} - {share} + {smooth * (size + 1)}D))"


def identify(pages: DataFrame, docs: DataFrame, *, max_fit_rows: int = 1000, most: float = 200.0, smooth: float = 1.0, borrow: float = 20.0) -> DataFrame:
    """(page_id, url, declared, text_lang, lang, probability) for each of ``pages``."""
    langs, grams = fit_ngrams(docs, max_fit_rows)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", "url", declared(F.col("html")).alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"))
    host, domain, suffix = address_parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared(F.col("html").cast("string")).alias("declared"), text_evidence(pages, grams, most)(F.col("html").cast("string")).alias("evidence"))
    weight = F.transform("evidence", lambda e: F.exp(e))
    share = F.transform(weight, lambda w: w / F.aggregate(weight, F.lit(0.0), lambda a, b: a + b))
    judged = staged(judged.withColumn("share", share), "evidence")
    # How many pages of each language, as the texts have it: an array for each combination, and for each of its parts.
    size = len(langs)
    combos = staged(_sums(judged, ["host", "domain", "suffix", "declared"], "share", size, "n"), "combinations")
    around = combos.select("host", "domain", "suffix", "declared")
    sizes = {}
    for key in ("host", "domain", "suffix", "declared"):
        by = _sums(combos, [key], "n", size, f"n_{key}")
        sizes[key] = by.count() if key in ("suffix", "declared") else 0
        around = around.join(by, key)
    around = staged(around.select("host", "suffix", "declared", F.arrays_zip("n_host", "n_domain", "n_suffix", "n_declared").alias("around")), "around")
    whole = _sums(combos.withColumn("one", F.lit(1)), ["one"], "n", size, "n").first()
    total = sum(whole["n"]) if whole else 0.0
    if around.count() * size <= BROADCAST_NUMBERS:
        joined = judged.join(F.broadcast(around), ["host", "suffix", "declared"])
    else:  # a hot host's pages are dealt to several parts
        dealt = judged.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"))
        joined = dealt.join(around.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["host", "suffix", "declared", "part"])
    names, numbers = F.array(*[F.lit(x) for x in langs]), F.array(*[F.lit(float(x)) for x in (whole["n"] if whole else [0.0] * size)])
    p_all = f"(x.whole + {smooth}D) / {total + smooth * size}D"
    p_domain = f"((x.n_domain - x.share + {borrow}D * {p_all}) / (domain_pages - 1 + {borrow}D))"
    prior = f"ln((x.n_host - x.share + {borrow}D * {p_domain}) / (host_pages - 1 + {borrow}D))"
    given = " + ".join(_log_given(f"x.n_{key}", "x.share", "x.whole", smooth, sizes[key]) for key in ("suffix", "declared"))
    zipped = F.zip_with(F.arrays_zip("evidence", "share", numbers.alias("whole")), "around", lambda a, b: F.struct(a["evidence"].alias("evidence"), a["share"].alias("share"), a["whole"].alias("whole"), b["n_host"].alias("n_host"), b["n_domain"].alias("n_domain"), b["n_suffix"].alias("n_suffix"), b["n_declared"].alias("n_declared")))
    fused = joined.withColumn("z", zipped).selectExpr("page_id", "url", "declared", "evidence", "z", "aggregate(z, 0D, (a, x) -> a + x.n_host) AS host_pages", "aggregate(z, 0D, (a, x) -> a + x.n_domain) AS domain_pages")
    fused = fused.withColumn("sum", F.expr(f"transform(z, x -> x.evidence + {prior} + {given})"))
    top = F.array_max("sum")
    pick = lambda c, m: F.element_at(names, F.array_position(c, m).cast("int"))
    odds = F.aggregate("sum", F.lit(0.0), lambda a, e: a + F.exp(e - top))
    return fused.select("page_id", "url", "declared", pick(F.col("evidence"), F.array_max("evidence")).alias("text_lang"), pick(F.col("sum"), top).alias("lang"), (1.0 / odds).alias("probability"))
