"""Tables seen as collections of files: rel_path, name, size, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    body = F.coalesce(text, F.lit("")).cast("binary")
    return rows.select(path.alias("rel_path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.octet_length(body).cast("long").alias("size"), body.alias("content"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/]+)", 1)


def pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return as_files(pages, F.concat(host(F.col("url")), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))


def documents_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return as_files(docs, F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))), F.col("text"))


#: What an event of each type stands for, one line each.
EVENT_LINES = {"view": "", "click": "x = 1;", "purchase": "// note", "signup": "/* open", "error": "close */"}


def events_code(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    """A file per user, a line per event in order of time. Files are as long as a user has events."""
    line = F.lit("")
    for kind, text in EVENT_LINES.items():
        line = F.when(F.col("event_type") == kind, text).otherwise(line)
    events = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", line.alias("line")).alias("e"))
    grouped = events.groupBy("user_id").agg(F.sort_array(F.collect_list("e"))["line"].alias("lines"))
    path = F.concat(F.lit("u"), F.pmod("user_id", F.lit(8)).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(f".{ending}"))
    return as_files(grouped, path, F.concat(F.array_join("lines", "\n"), F.lit("\n")))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without a file ending: no language knows them."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"].alias("t"))
    return as_files(turns, F.col("conv_id").cast("string"), F.array_join("t", "\n"))
