"""Trains the linear text classifiers on labelled documents and scores all documents with them.

Training: a bounded sample of labelled rows outside the held-out fold: of each class at most `per_class` labelled ids and then
at most `per_class` rows, those whose hashes are smallest, however often an id or a text is there. The ids, so bounded, are
broadcast to the documents. Executors turn the sampled texts into buckets, written in the shared folder; the driver takes
rows in the order of their hashes while they set at most `pairs` buckets in all, and fits the model on these. All 2^bits
buckets are columns. Scoring is one pass without a shuffle.

Cases: null texts count as empty; empty texts get a score like any other; texts of any length, read whole (linear.py states the
memory); labels that are null or whose doc_id is null take no part; a doc_id that is labelled more than once counts once, with
its largest label; a doc_id that is there more than once trains with each of its different texts, within `per_class`; with no
label of one class the score is constant, with none at all every score is below one half. A null doc_id hashes as the empty string.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .common import append_columns, drop_table, fresh, slices, stage_table


@dataclass(frozen=True)
class Spec:
    label: str
    features: Callable[[], linear.Featuriser]
    bits: int
    folds: int
    held_out: int
    cost: float = 0.1
    squared: bool = False
    #: Made-up texts that smooth a bucket's log-count ratio; more of them trust rare n-grams less.
    smooth: float = 1.0
    #: Most labelled rows of each class that are learnt from.
    per_class: int = 4000
    #: Most buckets that the rows learnt from set in all: 4 bytes each on the driver.
    pairs: int = 1 << 25


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _sample(documents: DataFrame, labels: DataFrame, spec: Spec) -> DataFrame:
    """(label, key, other, text) of the sampled rows, written; key and other are the hashes that order them."""
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(spec.label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("id"), spec.folds) != spec.held_out))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(spec.per_class) for c in (0, 1)]
    ids = F.broadcast(parts[0].unionAll(parts[1]))
    texts = documents.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(ids, F.col("doc") == F.col("id")).select("label", F.xxhash64("id").alias("key"), F.xxhash64("text").alias("other"), "text")
    once = stage_table(found.groupBy("label", "key", "other").agg(F.min("text").alias("text")), "labelled-all")  # copies of an id's text fall together
    first = [once.where(F.col("label") == c).select("label", "key", "other").orderBy("key", "other").limit(spec.per_class) for c in (0, 1)]
    rows = stage_table(once.join(F.broadcast(first[0].unionAll(first[1])), ["label", "key", "other"], "left_semi"), "labelled")
    drop_table(once)
    return rows


#: Parts in which the driver takes the sampled rows' sets.
_PARTS = 8
_MARKED = "label int, key long, other long, n long, set binary"


def _marker(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sampled rows to the buckets that each sets, as compressed differences."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = spec.features()
        for whole in batches:
            for batch in slices(whole, 3):
                of, bucket = features(batch.column(3).to_pylist())
                n = np.bincount(of, minlength=batch.num_rows)
                sets = [zlib.compress(np.diff(x, prepend=0).astype("<i4").tobytes(), 1) for x in np.split(bucket, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sets, pa.binary())], names=["label", "key", "other", "n", "set"])

    return mark


def train(documents: DataFrame, labels: DataFrame, spec: Spec) -> linear.Model:
    rows = _sample(documents, labels, spec)
    marked = stage_table(rows.select("label", "key", "other", "text").mapInArrow(_marker(spec), _MARKED), "marked")
    drop_table(rows)
    sizes = sorted(map(tuple, marked.select("key", "other", "label", "n").collect()))  # two rows a labelled one at most, of per_class each
    within = int(np.searchsorted(np.cumsum([s[3] for s in sizes]), spec.pairs, "right")) if sizes else 0
    if within < len(sizes):
        key, other = sizes[within][:2]
        marked_ = marked.where((F.col("key") < key) | (F.col("key") == key) & (F.col("other") < other))
    else:
        marked_ = marked
    x = []
    for part in range(_PARTS):  # so that neither side holds both forms of all sets
        got = marked_.where(F.pmod("key", F.lit(_PARTS)) == part).select("key", "other", "label", "set").toArrow()
        for key, other, label, packed in zip(*(got.column(k) for k in got.column_names)):
            x.append((key.as_py(), other.as_py(), label.as_py(), np.cumsum(np.frombuffer(zlib.decompress(packed.as_buffer()), "<i4"), dtype=np.int32)))
    x.sort(key=lambda r: r[:3])  # no order of tasks shows in the model
    drop_table(marked)
    order = np.random.default_rng(11).permutation(len(x))
    return linear.fit([x[i][3] for i in order], np.array([x[i][2] for i in order], np.int64), 1 << spec.bits, spec.cost, spec.squared, spec.smooth)


def with_score(documents: DataFrame, model: linear.Model, spec: Spec, name: str = "score", keep_text: bool = True) -> DataFrame:
    """documents with one more column, the score of the whole text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[str]], list]:
        features, model = spec.features(), sent.value
        return lambda texts: [model.scores(texts, features)]

    return append_columns(documents, "text", [T.StructField(fresh(documents.columns, name), T.DoubleType())], make, keep_text)


def predict(documents: DataFrame, labels: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = documents.select("doc_id", "text")
    scored = with_score(docs, train(docs, labels, spec), spec, keep_text=False)
    return scored.select("doc_id", (fold(F.col("doc_id"), spec.folds) == spec.held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
