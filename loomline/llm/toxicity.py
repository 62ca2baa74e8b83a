"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio.

An indicator of an n-gram (5 and 8 bytes of the lower-cased text, hashed to 2^20 buckets) counts as the log of how
much likelier it is in toxic texts; a large-margin linear model is fitted on these and its margin is turned into a
probability. See classify.py for the bounds of training and the defined results of odd rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import classify, linear

SPEC = classify.Spec(label="toxic", features=linear.char_ngrams, bits=20, folds=5, held_out=0, cost=0.1, squared=True, smooth=16.0)


def toxicity(documents: DataFrame, labels: DataFrame, spec: classify.Spec = SPEC) -> DataFrame:
    return classify.predict(documents, labels, spec)
