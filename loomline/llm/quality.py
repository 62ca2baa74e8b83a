"""Quality: naive Bayes support vectors, a linear model of the plain hinge loss over n-gram indicators.

Indicators are n-grams (1 to 3) of word shapes with their share of the text, and words and word pairs themselves, so
that junk of ordinary-looking words can be told; all are scaled by class log-count ratios. The model is fitted by dual coordinate descent. See classify.py for bounds and the defined results of odd rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import classify, linear
from .common import fresh

SPEC = classify.Spec(label="quality", features=linear.shape_and_word_ngrams, bits=20, folds=3, held_out=1)


def quality(documents: DataFrame, labels: DataFrame, spec: classify.Spec = SPEC) -> DataFrame:
    return classify.predict(documents, labels, spec)


def keep_good(documents: DataFrame, labels: DataFrame, spec: classify.Spec = SPEC, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose score is `least` or more."""
    name = fresh(documents.columns, "quality_score")
    model = classify.train(documents.select("doc_id", "text"), labels, spec)
    return classify.with_score(documents, model, spec, name).where(F.col(name) >= least).select(*(F.col(f"`{c}`") for c in documents.columns))
