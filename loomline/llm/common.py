"""What the operators share: reading tables, text columns in Arrow batches, names that do not clash."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import drop_table, release, shared_dir, stage_table  # noqa: F401  for the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks(rows: Iterable, size: int) -> Iterator[list]:
    """Lists of up to `size` items."""
    part: list = []
    for x in rows:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def fresh(names: Iterable[str], wanted: str) -> str:
    """`wanted`, with underscores until no name clashes, as Spark compares names."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def masked(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """df with its columns under names that no operator uses, and what maps a column's own name to its new one."""
    names = [f"own{i}_of_rows" for i in range(len(df.columns))]
    by = dict(zip(df.columns, names))
    return df.toDF(*names), by.__getitem__


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], list]], keep_text: bool = True) -> DataFrame:
    """df with more columns worked out from the texts in Arrow batches; nothing is shuffled.

    make() runs once in each task and gives a function from texts (null: empty) to one sequence per field.
    The function sees whole texts, as many as come to about SLICE_BYTES at a time, or one that is longer. Without
    keep_text the texts do not come back from the workers.
    """
    at = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if keep_text or i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *fields])
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole, at):
                made = work([t or "" for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(v, k) for v, k in zip(made, types, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)


#: Characters of a very long text that are worked on at once, where that does not change the result.
PART = 1 << 20
_SPACE = re.compile("[\t-\r ]")


def parts(text: str, size: int | None = None) -> Iterator[str]:
    """A text in parts of about `size` characters, cut before ASCII white space; together they are the text."""
    start, size = 0, size or PART
    while start < len(text):
        gap = _SPACE.search(text, start + size) if start + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


#: Bytes of text that a worker turns into Python objects at once; one text may be longer.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column `at` has about SLICE_BYTES of text."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False), float)))
    part = (size // SLICE_BYTES).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


_WORKER: dict = {}


def per_worker(key: tuple, build: Callable[[], object]) -> object:
    """What build() gives, kept for later tasks of the same worker process; of each kind (key[0]) only the last."""
    kept = _WORKER.get(key[0])
    if kept is None or kept[0] != key:
        _WORKER[key[0]] = kept = (key, build())
    return kept[1]
