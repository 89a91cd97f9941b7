"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

The n-grams are 1- to 3-grams of characters and of word shapes (case, last character, repeat of the word
before), since much junk shows in the form of words rather than in the words. Empty or null texts have no
n-grams and get the bias's score; rows that repeat are scored each; long texts are read whole, in blocks; empty tables give no rows; the fit's sample is
bounded in rows and characters (``nbsvm.fit``); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import nbsvm
from .features import shape_and_char_ngrams


def fit_quality(docs: DataFrame, labels: DataFrame, **kw) -> nbsvm.Model:
    return nbsvm.fit(docs, labels, "quality", shape_and_char_ngrams, **({"bits": 18, "max_fit_rows": 5000} | kw))


def quality_scores(docs: DataFrame, model: nbsvm.Model) -> DataFrame:
    """(doc_id, score), score near 1 for good texts."""
    return nbsvm.scores(docs, model, shape_and_char_ngrams)
