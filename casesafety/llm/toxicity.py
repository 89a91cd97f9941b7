"""Toxicity: linear classifier over character 3- to 5-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased; empty or null texts have no n-grams and get the bias's score; rows that repeat are
scored each; long texts are read whole, in blocks; empty tables give no rows; the fit's sample is bounded in rows and
characters (``nbsvm.fit``); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import nbsvm
from .features import lower_char_ngrams


def fit_toxicity(docs: DataFrame, labels: DataFrame, **kw) -> nbsvm.Model:
    return nbsvm.fit(docs, labels, "toxic", lower_char_ngrams, **({"bits": 19, "max_fit_rows": 5000, "min_df": 2} | kw))


def toxicity_scores(docs: DataFrame, model: nbsvm.Model) -> DataFrame:
    """(doc_id, score), score near 1 for toxic texts."""
    return nbsvm.scores(docs, model, lower_char_ngrams)
