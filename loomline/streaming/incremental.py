"""Counts by language kept up to date over a stream of files.

Sums by language are associative, so a streaming aggregation keeps one row of state a language; no watermark is
needed, as the number of groups is the catalog's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.aggregate import by_language
from ..plans.analysis import file_stats
from ..sources.catalog import Language


def language_counts(files: DataFrame, languages: list[Language]) -> DataFrame:
    """files: a streaming DataFrame of rel_path, name, size, content. Write it with outputMode complete or update."""
    return by_language(file_stats(files, languages))
