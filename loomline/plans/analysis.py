"""The analysis as one plan: files to counts per file, in one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..operators.worker import analyse
from ..sources.catalog import Language


def file_stats(files: DataFrame, languages: list[Language], include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """files (rel_path, name, size, content) to rel_path, lang, total_lines, the four kinds and size of each known file.

    Files that are binary or of no known language are gone. Languages are included or, only if none are, not excluded; ASCII
    case does not count. An empty file counts if its name leaves one language.
    """
    return analyse(files, languages, include, exclude)
