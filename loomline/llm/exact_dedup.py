"""Exact dedup by distributed MSD radix partitioning; DataFrame operations only.

A text, A-Z lower-cased, is split off into groups by successive digits: first its first `DIGITS[0]` bytes, then, inside
each group, the next bytes, in digits that grow sixteenfold. A row alone in its group is unique and leaves; a group whose
texts have all ended holds equal texts and leaves; the rest goes on to the next digit. Equality is that of all bytes: neither
a digest nor a length takes part, only whether a text has ended with the digit.

Each round counts groups with partial aggregation before the shuffle, so that a group of copies of any size comes
to one row a task, and writes the groups of two or more; the rows are then joined to these. Both sides of that join
are plain shuffles, so adaptive execution splits a skewed group. Every row leaves in one round; nothing is joined
back over the whole table. Texts cross the network once; after that only rows that share all their bytes so far with
another one go on, with what is left of their texts (with their columns, where the caller wants these whole).

Cases: null counts as empty; empty texts are equal; a doc_id that repeats within a group of equal texts: one row
of them is kept; null doc_ids come last (are kept only if all are null); texts of any length; empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_table, fresh, masked, release, stage_table

#: Bytes of the first digits; later ones are sixteen times the one before.
DIGITS = (64, 1024)


def _digit(round_: int) -> tuple[int, int]:
    """First byte (from 0) and bytes of a round's digit."""
    sizes = [*DIGITS]
    while len(sizes) <= round_:
        sizes.append(sizes[-1] * 16)
    return sum(sizes[:round_]), sizes[round_]


def group_copies(rows: DataFrame, text: str = "text", order: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """rows with keep_id (the largest `order` of those with an equal text), group_size and kept; without the text unless keep_text.

    Where a column of rows has one of these names, the new one gets underscores at its end (see `new_names`).
    """
    names = [*(c for c in rows.columns if keep_text or c != text), *new_names(rows)]
    spark = rows.sparkSession
    rows, name = masked(rows)
    text, order = name(text), name(order)
    keep, size, kept, group, count, uid, ended, digit, rest = "keep", "size", "kept", "group", "count", "uid", "ended", "digit", "rest"
    own = [F.col(c) for c in rows.columns if keep_text or c != text]
    active, seen, round_ = rows.withColumn(group, F.lit(-1).cast("long")), [], 0
    while True:
        start, width = _digit(round_)
        if round_ == 0:  # of a text only its first characters are lower-cased here; they hold the digit
            carried, body = F.col(text), ascii_lower(F.substring(text, 1, width)).cast("binary")
            now, over = F.substring(body, 1, width), F.octet_length(F.coalesce(text, F.lit(""))) <= width
        else:
            carried = body = ascii_lower(F.col(text)).cast("binary") if keep_text else F.col(rest)
            since = start if keep_text else 0
            now, over = F.substring(body, since + 1, width), F.octet_length(body) <= since + width
        carry = [] if keep_text else [carried.alias("carried")]
        here = active.select(*own, *carry, group, now.alias(digit), over.alias(ended))
        groups = here.groupBy(F.col(group).alias("g"), F.col(digit).alias("d"), F.col(ended).alias("e")).agg(F.count("*").alias("c")).where("c > 1")
        groups = stage_table(groups.withColumn("next", F.monotonically_increasing_id() * 64 + round_), "radix-groups")
        matched = here.join(groups.hint("merge"), (F.col(group) == F.col("g")) & (F.col(digit) == F.col("d")) & (F.col(ended) == F.col("e")), "left")
        goes_on = F.col("c").isNotNull() & ~F.col(ended)
        if not keep_text:
            left = ascii_lower(F.col("carried")).cast("binary") if round_ == 0 else F.col("carried")
            carry = [F.when(goes_on, F.substring(left, width + 1, (1 << 31) - 1)).alias(rest)]
        split = matched.select(*own, *carry, F.col("next").alias(group), F.coalesce("c", F.lit(1)).cast("long").alias(count), F.monotonically_increasing_id().alias(uid), goes_on.alias("goes_on"))
        split = stage_table(split, "radix-rows")
        drop_table(groups)
        del here, groups, matched
        release(spark)
        seen.append(split)
        active = split.where("goes_on").select(*own, *([] if keep_text else [rest]), group)
        if active.isEmpty():
            break
        round_ += 1
    # the joins above are merge joins at every size: their plan, and what they shuffle, follows the input alone
    alone = [s.where(F.col(count) == 1).select(*own, F.col(order).alias(keep), F.col(count).alias(size), F.lit(True).alias(kept)) for s in seen]
    equal = reduce(DataFrame.unionAll, [s.where((F.col(count) > 1) & ~F.col("goes_on")).select(*own, group, count, uid) for s in seen])
    best = stage_table(equal.groupBy(F.col(group).alias("g")).agg(F.max(F.struct(F.col(order).alias("o"), F.col(uid).alias("u"))).alias("best")), "radix-best")
    copies = equal.join(best, F.col(group) == F.col("g")).select(*own, F.col("best.o").alias(keep), F.col(count).alias(size), (F.col("best.u") == F.col(uid)).alias(kept))
    return reduce(DataFrame.unionAll, [*alone, copies]).toDF(*names)


def new_names(rows: DataFrame) -> tuple[str, str, str]:
    return tuple(fresh(rows.columns, n) for n in ("keep_id", "group_size", "kept"))


def exact_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the text with A-Z lower-cased) of every document."""
    docs = documents.select("doc_id", "text", F.sha2(ascii_lower(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    return group_copies(docs, keep_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(documents: DataFrame) -> DataFrame:
    """One document of each group of equal texts, all columns as they are."""
    kept = new_names(documents)[2]
    return group_copies(documents).where(F.col(kept)).select(*(F.col(f"`{c}`") for c in documents.columns))
