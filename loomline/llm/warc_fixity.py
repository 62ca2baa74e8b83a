"""Merkle fixity audit of WARC replicas.

A replica is a table of records: file, seq (from 0, in the file's order), byte_offset, n_bytes and sha256 of the
record. Each file has a hash tree of `FAN` children a node: a leaf hashes its offset range and its record's digest, a
node its own offset range and its children's digests in order. An audit compares the roots of two replicas and
goes down only below nodes that differ, level by level, to the records that differ: altered (other bytes), moved
(the same bytes at another offset) or missing on one side.

Only digests are shuffled, never records; a level has a FANth of the rows of the level below, and groups hold FAN rows.
Places in a file come from a sort by ranges over all files and sums over its partitions, so that a file of any size, such as
that of pages without an id, spreads over tasks.

Cases: a null page_id, url or html counts as -1 or empty; pages that are alike in page_id come in the order of
their digests; empty tables give no rows; a file that only one replica has is missing on the other, record by record; what
follows the last whole record of a broken WARC file is one row more, whose `error` says where it broke.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, stage_table

FAN, RECORDS_A_FILE = 16, 1024
CRLF = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page's response record, as text."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id, F.lit(-1)).cast("string"), F.lit(f">{CRLF}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head, body, F.lit(CRLF * 2))


def _numbered(records: DataFrame) -> DataFrame:
    """Rows file, page_id, n_bytes, sha256, written by ranges of their order, with seq and byte_offset in their file."""
    spark = records.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = stage_table(records.withColumn("row", F.monotonically_increasing_id()), "warc-records")
    dealt = stage_table(slim.repartitionByRange(n, "file", "page_id", "sha256", "row").withColumn("part", F.spark_partition_id()), "warc-sorted")
    drop_table(slim)
    sizes = dealt.groupBy(F.col("file").alias("f"), F.col("part").alias("p")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    before = W.partitionBy("f").orderBy("p")  # a file has at most as many parts as there are partitions
    starts = sizes.select("f", "p", (F.sum("n").over(before) - F.col("n")).alias("seq0"), (F.sum("b").over(before) - F.col("b")).alias("byte0"))
    inside = W.partitionBy("file", "part").orderBy("page_id", "sha256", "row")
    placed = dealt.withColumn("seq", F.row_number().over(inside) - 1).withColumn("byte_offset", F.sum("n_bytes").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_bytes"))
    both = placed.join(starts, (F.col("file") == F.col("f")) & (F.col("part") == F.col("p")))
    return both.withColumn("seq", (F.col("seq") + F.col("seq0")).cast("long")).withColumn("byte_offset", (F.col("byte_offset") + F.col("byte0")).cast("long")).drop("f", "p", "seq0", "byte0", "part", "row")


def _records(pages: DataFrame, per_file: int) -> DataFrame:
    made = pages.select(F.coalesce("page_id", F.lit(-1)).cast("long").alias("page_id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    return made.select("page_id", F.floor(F.col("page_id") / per_file).cast("long").alias("file"), F.octet_length("r").cast("long").alias("n_bytes"), F.sha2(F.col("r").cast("binary"), 256).alias("sha256"), "r")


def catalogue(pages: DataFrame, per_file: int = RECORDS_A_FILE) -> DataFrame:
    """The record table of an archive of pages: files by ranges of page_id, records in its order."""
    return _numbered(_records(pages, per_file).drop("r")).select("page_id", "file", "seq", "byte_offset", "n_bytes", "sha256")


def archive(pages: DataFrame, per_file: int = RECORDS_A_FILE) -> DataFrame:
    """file, volume, content: the WARC files of pages, in the order of their catalogue.

    A file of more than per_file records, as of pages that are alike in page_id, goes on in volumes of so many.
    """
    placed = _numbered(_records(pages, per_file))
    grouped = placed.groupBy("file", F.floor(F.col("seq") / per_file).cast("long").alias("volume")).agg(F.sort_array(F.collect_list(F.struct("seq", "r")))["r"].alias("r"))
    return grouped.select("file", "volume", F.array_join("r", "").cast("binary").alias("content"))


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, bytes, headers, block) of each record of an uncompressed WARC file; ValueError where it breaks off."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        if head < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = content[at:head].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = headers.get("content-length", "")
        end = head + 4 + int(size) if re.fullmatch(r"\d+", size) else -1
        if end < 0 or content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of the record at byte {at}")
        yield at, end + 4 - at, headers, content[head + 4 : end]
        at = end + 4


_PARSED = "file long, volume long, i long, at long, n_bytes long, sha256 string, error string"


def read_catalogue(archives: DataFrame) -> DataFrame:
    """file, content and, if there, volume (as `archive` gives) to a record table with `error`, null but for a broken end."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
        for batch in batches:
            out = []
            for file, volume, content in zip(*(c.to_pylist() for c in batch.columns)):
                content, i, end = content or b"", 0, 0
                try:
                    for at, n, _, _ in parse(content):
                        out.append((file, volume, i, at, n, hashlib.sha256(content[at : at + n]).hexdigest(), None))
                        i, end = i + 1, at + n
                except ValueError as e:
                    out.append((file, volume, i, end, len(content) - end, hashlib.sha256(content[end:]).hexdigest(), str(e)))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file", "volume", "i", "at", "n_bytes", "sha256", "error"])

    volume = F.col("volume") if "volume" in archives.columns else F.lit(0)
    parsed = stage_table(archives.select(F.col("file").cast("long").alias("file"), volume.cast("long").alias("volume"), "content").mapInArrow(run, _PARSED), "warc-parsed")
    sizes = parsed.groupBy(F.col("file").alias("f"), F.col("volume").alias("v")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    before = W.partitionBy("f").orderBy("v")  # one row a volume
    starts = sizes.select("f", "v", (F.sum("n").over(before) - F.col("n")).alias("seq0"), (F.sum("b").over(before) - F.col("b")).alias("byte0"))
    both = parsed.join(starts, (F.col("file") == F.col("f")) & (F.col("volume") == F.col("v")))
    return both.select("file", (F.col("i") + F.col("seq0")).alias("seq"), (F.col("at") + F.col("byte0")).alias("byte_offset"), "n_bytes", "sha256", "error")


def leaves(records: DataFrame) -> DataFrame:
    """file, node, first and last byte, digest of each record."""
    last = F.col("byte_offset") + F.col("n_bytes")
    return records.select("file", F.col("seq").alias("node"), F.col("byte_offset").alias("lo"), last.alias("hi"), F.sha2(F.concat_ws("|", "byte_offset", last, "sha256"), 256).alias("digest"))


def parents(level: DataFrame) -> DataFrame:
    """The nodes above: at most FAN children each, in order."""
    kids = F.sort_array(F.collect_list(F.struct("node", "digest")))["digest"]
    grouped = level.groupBy("file", F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("kids"))
    return grouped.select("file", F.col("up").alias("node"), "lo", "hi", F.sha2(F.concat_ws("|", "lo", "hi", F.array_join("kids", "|")), 256).alias("digest"))


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves up to the roots."""
    levels = [stage_table(leaves(records), "merkle")]
    for _ in range(height):
        levels.append(stage_table(parents(levels[-1]), "merkle"))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, node of what differs or is on one side only."""
    other = b.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("digest").alias("d"))
    both = a.join(other, (F.col("file") == F.col("f")) & (F.col("node") == F.col("n")), "full")
    return both.where(~F.col("digest").eqNullSafe(F.col("d"))).select(F.coalesce("file", "f").alias("file"), F.coalesce("node", "n").alias("node"))


def locate(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, seq of the records that differ between two record tables, written."""
    most = max(a.agg(F.max("seq")).first()[0] or 0, b.agg(F.max("seq")).first()[0] or 0)
    height = 0
    while FAN**height <= most:
        height += 1
    left, right = tree(a, height), tree(b, height)
    bad = stage_table(differing(left[height], right[height]), "merkle-bad")
    for level in range(height - 1, -1, -1):
        above = bad.select(F.col("file").alias("bf"), F.col("node").alias("bn"))
        below = [side[level].join(above, (F.col("file") == F.col("bf")) & (F.floor(F.col("node") / FAN) == F.col("bn")), "left_semi") for side in (left, right)]
        found = stage_table(differing(*below), "merkle-bad")
        drop_table(bad)
        bad = found
    for t in (*left, *right):
        drop_table(t)
    return bad.withColumnRenamed("node", "seq")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of a, and those of b alone, with status ok, altered, moved, missing (not in b) or extra (not in a)."""
    a, b = stage_table(a, "replica"), stage_table(b, "replica")
    bad = locate(a, b).select(F.col("file").alias("xf"), F.col("seq").alias("xs"), F.lit(True).alias("bad"))
    other = b.select(F.col("file").alias("of"), F.col("seq").alias("os"), F.col("sha256").alias("replica_sha256"))
    at = (F.col("file") == F.col("xf")) & (F.col("seq") == F.col("xs"))
    found = bad.join(other, (F.col("xf") == F.col("of")) & (F.col("xs") == F.col("os")), "left")
    joined = a.join(found, at, "full")
    status = (
        F.when(F.col("bad").isNull(), "ok").when(F.col("seq").isNull(), "extra").when(F.col("replica_sha256").isNull(), "missing").when(F.col("replica_sha256") != F.col("sha256"), "altered").otherwise("moved")
    )
    return joined.select(*(F.col(c) for c in a.columns if c not in ("file", "seq")), F.coalesce("file", "xf").alias("file"), F.coalesce("seq", "xs").alias("seq"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica's pages with stated damage, for the audit to find: some lose their first character for a #, some their end."""
    cut = F.when(F.col("page_id") % 97 == 3, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).when(F.col("page_id") % 389 == 11, F.expr("substring(html, 1, length(html) div 2)"))
    return pages.select("page_id", "url", F.coalesce(cut, F.col("html")).alias("html"))
