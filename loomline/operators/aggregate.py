"""Grouping, shares, order, top-N and least size over a table of file counts.

Every grouping is Spark's partial and final hash aggregation over a handful of sums. Sums saturate: they are kept as
decimals and cut at the largest long, where plain sums would fail.
"""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.content import directory_key
from ..functions.formats import SizeUnits, average, percentage, size
from ..storage import stage_table

MEASURES = ("code_lines", "comment_lines", "blank_lines", "shebang_lines")
LIMIT = (1 << 63) - 1


class SortKey(StrEnum):
    LINES = "lines"
    CODE = "code"
    COMMENTS = "comments"
    BLANKS = "blanks"
    FILES = "files"
    SIZE = "size"
    NAME = "name"


_COLUMN = {"lines": "lines", "code": "code_lines", "comments": "comment_lines", "blanks": "blank_lines", "files": "files", "size": "size"}


def saturating_sum_of(column: Column) -> Column:
    return F.least(F.coalesce(F.sum(column.cast("decimal(38,0)")), F.lit(0)), F.lit(LIMIT).cast("decimal(38,0)")).cast("long")


def saturating_sum(column: str) -> Column:
    return saturating_sum_of(F.col(column))


def measures() -> list[Column]:
    return [F.count("*").alias("files"), saturating_sum("total_lines").alias("lines"), *(saturating_sum(m).alias(m) for m in MEASURES), saturating_sum("size").alias("size")]


def with_shares(groups: DataFrame, units: SizeUnits | str = SizeUnits.BINARY) -> DataFrame:
    """Adds the readable size and each kind's percentage of the group's lines."""
    out = groups.withColumn("size_human", size(F.col("size"), units))
    for m in MEASURES:
        out = out.withColumn(m.replace("_lines", "_percentage"), percentage(F.col(m), F.col("lines")))
    return out


def by_language(stats: DataFrame, units: SizeUnits | str = SizeUnits.BINARY) -> DataFrame:
    grouped = stats.groupBy(F.col("lang").alias("name")).agg(*measures())
    return with_shares(grouped, units).withColumn("avg_lines_per_file", average(F.col("lines"), F.col("files")))


def by_directory(stats: DataFrame, root: str = "", units: SizeUnits | str = SizeUnits.BINARY) -> DataFrame:
    return with_shares(stats.groupBy(directory_key(F.col("rel_path"), root).alias("name")).agg(*measures()), units)


def totals(stats: DataFrame, units: SizeUnits | str = SizeUnits.BINARY) -> DataFrame:
    return with_shares(stats.agg(*measures()), units)


def language_rollup(stats: DataFrame) -> DataFrame:
    """Languages and the grand total (name null) in one pass."""
    return stats.rollup(F.col("lang").alias("name")).agg(*measures())


def with_share_of_total(groups: DataFrame, total: DataFrame) -> DataFrame:
    """Adds files_share, lines_share and size_share in percent of a one-row total, which may hold more than the groups."""
    one = total.select(*(F.col(c).alias(f"total_{c}") for c in ("files", "lines", "size")))
    both = groups.crossJoin(F.broadcast(one))  # one row
    return both.select(*groups.columns, *(percentage(F.col(c), F.col(f"total_{c}")).alias(f"{c}_share") for c in ("files", "lines", "size")))


def order(key: SortKey | str, descending: bool = True, directories: bool = False) -> list[Column]:
    """Sort columns; descending turns the tie-break round too. Directories take lines where files is asked for."""
    key = SortKey(key)
    if directories and key is SortKey.FILES:
        key = SortKey.LINES
    columns = ["name"] if key is SortKey.NAME else [_COLUMN[key], "name"]
    return [F.desc(c) if descending else F.asc(c) for c in columns]


def file_order(key: SortKey | str, descending: bool = True) -> list[Column]:
    key = SortKey(key)
    metric = {"lines": "total_lines"}.get(key, _COLUMN.get(key))
    columns = ["rel_path"] if key in (SortKey.FILES, SortKey.NAME) else [metric, "rel_path"]
    return [F.desc(c) if descending else F.asc(c) for c in columns]


def top(groups: DataFrame, key: SortKey | str = SortKey.LINES, descending: bool = True, n: int | None = None, min_lines: int | None = None, directories: bool = False) -> DataFrame:
    """Sorted, cut to n, and only then to groups of at least min_lines."""
    out = groups.orderBy(*order(key, descending, directories))
    if n is not None:
        out = out.limit(n)
    return out if min_lines is None else out.where(F.col("lines") >= min_lines)


def with_place(groups: DataFrame, order_by: list[Column], name: str = "place") -> DataFrame:
    """groups with their place from 1 in the order: a sort by ranges over all tasks, then sums of the sizes of its partitions.

    The sorted rows are written, so that a partition's rows and its size are those of one sort.
    """
    part, row = F.spark_partition_id().alias("sorted_part"), F.monotonically_increasing_id().alias("sorted_row")
    done = stage_table(groups.orderBy(*order_by).select("*", part, row), "sorted")
    sizes = done.groupBy(F.col("sorted_part").alias("p")).count()  # one row a partition of the sort
    before = sizes.select("p", (F.sum("count").over(W.orderBy("p")) - F.col("count")).alias("before"))
    inside = F.col("sorted_row") - F.shiftleft(F.col("sorted_part").cast("long"), 33)  # the id holds the partition above 33 bits
    return done.join(F.broadcast(before), F.col("sorted_part") == F.col("p")).select(*groups.columns, (F.col("before") + inside + 1).cast("int").alias(name))


def hidden(groups: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: how many groups are not shown."""
    return groups.agg(F.count("*").alias("a")).crossJoin(F.broadcast(shown.agg(F.count("*").alias("b")))).select((F.col("a") - F.col("b")).alias("hidden"))


def ranked_files(stats: DataFrame, n: int, key: SortKey | str = SortKey.LINES, descending: bool = True, group: str = "lang") -> DataFrame:
    """The first n files of each group with `place`; Spark cuts to n in each task before it shuffles."""
    return stats.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*file_order(key, descending)))).where(F.col("place") <= n)


def file_lists(stats: DataFrame, key: SortKey | str = SortKey.LINES, descending: bool = True, group: str = "lang") -> DataFrame:
    """All files, group after group, each in order. A sort by ranges, so a large group spreads over tasks; no array holds one."""
    return stats.orderBy(group, *file_order(key, descending))


def merge(parts: list[DataFrame], key: str = "name") -> DataFrame:
    """Sums of grouped tables: the groups of their union."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(saturating_sum("files").alias("files"), saturating_sum("lines").alias("lines"), *(saturating_sum(m).alias(m) for m in MEASURES), saturating_sum("size").alias("size"))


def kinds(groups: DataFrame, key: str = "name") -> DataFrame:
    """key, kind, lines and percent: one row for each kind of line that a group has."""
    each = F.array(*(F.struct(F.lit(m.removesuffix("_lines")).alias("kind"), F.col(m).alias("n"), percentage(F.col(m), F.col("lines")).alias("percent")) for m in MEASURES))
    return groups.select(key, F.explode(F.filter(each, lambda k: k["n"] > 0)).alias("k")).select(key, "k.kind", F.col("k.n").alias("lines"), "k.percent")


def summary_metrics(total: DataFrame) -> DataFrame:
    """The seven rows of a summary: label, value, percentage (of lines, else null) and readable size (else null)."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = [("Total Files", "files", none, text), ("Total Lines", "lines", none, text)]
    rows += [(f"{m.removesuffix('_lines').title()} Lines", m, percentage(F.col(m), F.col("lines")), text) for m in MEASURES]
    rows.append(("Total Size", "size", none, size(F.col("size"))))
    each = F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).alias("value"), p.alias("percentage"), t.alias("human_readable")) for label, c, p, t in rows))
    return total.select(F.explode(each).alias("r")).select("r.*")
