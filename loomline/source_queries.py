"""Queries over real sources: a tree of files written from `supplier`, one file a row, and read back by the walk.

What a supplier's file is follows from its key: a script with an ending or with a shebang alone, a file that an ignore file
leaves out (and a nearer one takes back in folders of even nations), a hidden one, an empty one that one language or several
could have, a link to a file, and a link to nothing.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.analysis import file_stats
from .queries import query
from .sources import catalog, files, tables

TARGET = b"x = 1\n# two\n"
_PATHS = ("s{k}.py", "s{k}", "s{k}.gen.py", ".s{k}.py", "s{k}.rs", "s{k}.m", "l{k}.py", "dead{k}.py")
_SCRIPTS = {0: "#!/usr/bin/env python3\n# {name}\n\nx = 1\n", 1: "#!/bin/bash\n# {name}\necho 1\n", 2: "x = 1\n", 3: "x = 1\n", 4: "", 5: ""}


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which must be mounted, as source trees are; it goes when the JVM ends."""
    path = files.mounted(spark, "tree")
    os.makedirs(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"file:{path}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def supplier_tree(spark: SparkSession, sf_dir: str) -> str:
    """Writes the tree, on the executors; the same rows write the same files however often a task runs."""
    root = _folder(spark)
    with open(f"{root}/.gitignore", "w") as f:
        f.write("*.gen.py\n# a comment\n")
    with open(f"{root}/target.py", "wb") as f:
        f.write(TARGET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, nation, name in zip(*(c.to_pylist() for c in batch.columns)):
                folder, kind = f"{root}/n{nation}", k % 8
                os.makedirs(folder, exist_ok=True)
                if nation % 2 == 0:
                    with open(f"{folder}/.ignore", "w") as f:
                        f.write("!*.gen.py\n")
                path = f"{folder}/{_PATHS[kind].format(k=k)}"
                if kind in _SCRIPTS:
                    with open(path, "w") as f:
                        f.write(_SCRIPTS[kind].format(name=name))
                elif not os.path.lexists(path):
                    os.symlink(f"{root}/{'target.py' if kind == 6 else 'nothing'}", path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("int"), "s_name")
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return root


def _tree(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return files.read_tree(spark, supplier_tree(spark, sf_dir), files.Walk(**options), globally="")


_TREE = """
WITH f AS (
  SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 8 AS kind, 'n' || s_nationkey || '/' AS folder, s_name AS name FROM supplier),
t AS (
  SELECT *, folder || CASE kind WHEN 0 THEN 's' || k || '.py' WHEN 1 THEN 's' || k WHEN 2 THEN 's' || k || '.gen.py' WHEN 3 THEN '.s' || k || '.py' WHEN 4 THEN 's' || k || '.rs'
      WHEN 5 THEN 's' || k || '.m' WHEN 6 THEN 'l' || k || '.py' ELSE 'dead' || k || '.py' END AS rel_path,
    CASE kind WHEN 0 THEN '#!/usr/bin/env python3' || chr(10) || '# ' || name || chr(10) || chr(10) || 'x = 1' || chr(10) WHEN 1 THEN '#!/bin/bash' || chr(10) || '# ' || name || chr(10) || 'echo 1' || chr(10)
      WHEN 2 THEN 'x = 1' || chr(10) WHEN 3 THEN 'x = 1' || chr(10) WHEN 6 THEN 'x = 1' || chr(10) || '# two' || chr(10) ELSE '' END AS body
  FROM f
  UNION ALL SELECT -1, NULL, -1, '', '', 'target.py', 'x = 1' || chr(10) || '# two' || chr(10))"""


@query(f"{_TREE} SELECT rel_path, strlen(body) AS size, md5(body) AS md5 FROM t WHERE kind IN (-1, 0, 1, 4, 5) OR kind = 2 AND n % 2 = 0")
def a1_b1_directory_walk(spark, sf_dir):
    """Regular files that are neither hidden nor left out; folders and links are no rows."""
    return _tree(spark, sf_dir).select("rel_path", "size", F.md5("content").alias("md5"))


@query(f"{_TREE} SELECT '' AS rel_path, 'target.py' AS name, strlen(body) AS size FROM t WHERE kind = -1")
def a2_single_file(spark, sf_dir):
    root = supplier_tree(spark, sf_dir)
    return files.read_tree(spark, f"{root}/target.py").select("rel_path", "name", "size")


@query("SELECT 'r/' || r_regionkey || '.py' AS rel_path, strlen(r_name) + 3 AS size, md5('# ' || r_name || chr(10)) AS md5 FROM region")
def a3_zip_archive(spark, sf_dir):
    """An archive with one file a region, and one that is hidden."""
    path = f"{_folder(spark)}/regions.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("r/.hidden.py", "x")
        for r in tables.read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five rows
            z.writestr(f"r/{r.r_regionkey}.py", f"# {r.r_name}\n")
    return files.read_zip(spark, path).select("rel_path", "size", F.md5("content").alias("md5"))


@query(f"{_TREE} SELECT rel_path FROM t WHERE kind = 2 AND n % 2 = 1")
def b2_ignored_files(spark, sf_dir):
    """What the ignore files leave out: the files of a walk that does not heed them and not of one that does."""
    root = supplier_tree(spark, sf_dir)
    every, kept = (files.walk(spark, root, files.Walk(respect_ignore=r)).select(F.col("path").cast("string").alias("rel_path")) for r in (False, True))
    return every.join(kept, "rel_path", "left_anti")


@query(f"{_TREE} SELECT rel_path, strlen(body) AS size FROM t WHERE kind IN (-1, 0, 1, 3, 4, 5) OR kind = 2 AND n % 2 = 0 UNION ALL SELECT '.gitignore', 21 UNION ALL SELECT DISTINCT 'n' || n || '/.ignore', 10 FROM f WHERE n % 2 = 0")
def b3_hidden_files(spark, sf_dir):
    return _tree(spark, sf_dir, hidden=True).select("rel_path", "size")


@query(f"{_TREE} SELECT rel_path, strlen(body) AS size FROM t WHERE kind = 6")
def b4_symlinks(spark, sf_dir):
    """Links count, with the size of what they lead to, only where links are followed."""
    root = supplier_tree(spark, sf_dir)
    with_, without = (files.read_tree(spark, root, files.Walk(symlinks=s), "").where("error IS NULL").select("rel_path", "size") for s in (True, False))
    return with_.join(without.select("rel_path"), "rel_path", "left_anti")


@query(f"{_TREE} SELECT rel_path FROM t WHERE kind = -1")
def b5_depth_of_a_walk(spark, sf_dir):
    return _tree(spark, sf_dir, max_depth=1).select("rel_path")


@query(f"{_TREE} SELECT rel_path, strlen(body) AS size FROM t WHERE kind IN (1, 4, 5)")
def b6_excluded_files(spark, sf_dir):
    return _tree(spark, sf_dir, exclude=("*.py",)).select("rel_path", "size")


@query(f"{_TREE} SELECT rel_path, 'Rust' AS lang, 0::BIGINT AS total_lines FROM t WHERE kind = 4")
def b12_empty_files(spark, sf_dir):
    """Empty files count where their name leaves one language, as *.rs does and *.m does not."""
    return file_stats(_tree(spark, sf_dir).drop("error"), catalog.builtin()).where("size = 0").select("rel_path", "lang", "total_lines")


@query(f"{_TREE} SELECT count(*) FILTER (kind = 7) AS skipped, count(*) FILTER (kind IN (-1, 0, 1, 4, 5, 6) OR kind = 2 AND n % 2 = 0) AS read FROM t")
def b16_e8_skipped(spark, sf_dir):
    """Entries that cannot be read are counted and leave the others alone."""
    return _tree(spark, sf_dir, symlinks=True).agg(F.count("error").alias("skipped"), F.count("content").alias("read"))


@query(f"{_TREE} SELECT rel_path, CASE kind WHEN 1 THEN 'Bash' ELSE 'Python' END AS lang, CASE kind WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS total_lines, CASE WHEN kind IN (0, 1) THEN 1 ELSE 0 END::BIGINT AS shebang_lines FROM t WHERE kind IN (-1, 0, 1) OR kind = 2 AND n % 2 = 0")
def c15_shebang_languages(spark, sf_dir):
    """Files without an ending get the language of their shebang."""
    return file_stats(_tree(spark, sf_dir).drop("error"), catalog.builtin()).where("size > 0").select("rel_path", "lang", "total_lines", "shebang_lines")
