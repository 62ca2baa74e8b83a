"""Source files as rows: a directory tree, a single file, a zip archive or a git repository.

A tree is listed level by level: executors list the folders of a level and apply all rules there, so that whole folders are
pruned before anything is read; the driver sees neither names nor folders, only whether there is a next level. Executors
then read the contents, a bounded number of bytes in each partition. The path must be readable by all executors. Spark's
binaryFile is not used: it drops empty files and names that begin with an underscore.
"""

from __future__ import annotations

import contextlib
import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import shared_dir, stage_table
from .ignore import IgnoreFiles, excludes, global_file

SCHEMA = "rel_path string, name string, size long, content binary, error string"
#: Bytes that a partition reads at least before the next begins.
PARTITION_BYTES = 64 << 20
#: Bytes of an archive and of all its entries unpacked.
ZIP_LIMIT, UNPACKED_LIMIT = 50 << 20, 250 << 20


@dataclass(frozen=True)
class Walk:
    """What a walk keeps."""

    respect_ignore: bool = True
    hidden: bool = False
    symlinks: bool = False
    max_depth: int | None = None
    exclude: tuple[str, ...] = ()
    generated: bool = False


class Walker:
    """One folder after the other, by the rules of a walk."""

    def __init__(self, root: str | Path, options: Walk, globally: str | None = None):
        self.root, self.options = os.path.abspath(root), options
        self.shut = excludes(options.exclude, not options.generated)
        self.ignore = IgnoreFiles(globally) if options.respect_ignore else None

    def entries(self, rel: str, depth: int) -> Iterator[tuple[bool, str, int, str]]:
        """(whether it is a folder, path below root, size, error) of what a folder holds and the rules keep; rel ends in a slash or is empty."""
        options, folder = self.options, os.path.join(self.root, rel)
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            yield False, rel.rstrip("/"), 0, str(e)
            return
        for e in found:
            if not options.hidden and e.name.startswith(".") or e.is_symlink() and not options.symlinks:
                continue
            path, inner = rel + e.name, e.is_dir()
            if options.max_depth is not None and depth + 1 > options.max_depth or self.shut.decide(path, inner):
                continue
            if self.ignore and self.ignore.left_out(os.path.join(self.root, path), inner, self.root):
                continue
            if inner and e.is_symlink() and f"{os.path.realpath(folder)}/".startswith(f"{os.path.realpath(e.path)}/"):
                yield False, path, 0, f"{path}: a link to a folder that it lies in"
            elif inner:
                yield True, path, 0, ""
            elif e.is_file():
                try:
                    yield False, path, e.stat().st_size, ""
                except OSError as x:
                    yield False, path, 0, str(x)
            elif e.is_symlink():
                yield False, path, 0, f"{path}: a link to nothing"


def listing(root: str | Path, options: Walk = Walk(), globally: str | None = None) -> list[tuple[str, str, int, str]]:
    """(full path, path below root, size, error) of the kept files, in order of path; by the driver alone, for small trees."""
    if os.path.isfile(root):
        return [(str(root), "", os.path.getsize(root), "")]
    if not os.path.isdir(root):
        raise FileNotFoundError(str(root))
    walker, out, todo = Walker(root, options, globally), [], [("", 0)]
    while todo:
        rel, depth = todo.pop()
        for inner, path, size, error in walker.entries(rel, depth):
            if inner:
                todo.append((f"{path}/", depth + 1))
            else:
                out.append((os.path.join(walker.root, path), path, size, error))
    return sorted(out, key=lambda x: x[1])


_LISTED = "folder boolean, path binary, size long, error string"


def walk(spark: SparkSession, root: str | Path, options: Walk = Walk(), globally: str | None = None) -> DataFrame:
    """path (below root, as bytes), size, error of the kept files of a tree, listed by the executors, written level by level."""
    root = os.path.abspath(root)
    level = spark.createDataFrame([(bytearray(),)], "path binary")
    parts, found, depth = max(1, spark.sparkContext.defaultParallelism), [], 0
    while True:

        def run(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            walker = Walker(root, options, globally)
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    rel = os.fsdecode(path)
                    rows = list(walker.entries(f"{rel}/" if rel else "", depth))  # of one folder
                    columns = (pa.array([r[0] for r in rows], pa.bool_()), pa.array([os.fsencode(r[1]) for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] or None for r in rows], pa.string()))
                    yield pa.RecordBatch.from_arrays(list(columns), names=["folder", "path", "size", "error"])

        listed = stage_table((level.repartition(parts) if depth else level).mapInArrow(run, _LISTED), "listed")
        found.append(listed.where("NOT folder").select("path", "size", "error"))
        level, depth = listed.where("folder").select("path"), depth + 1
        if level.isEmpty():
            return reduce(DataFrame.unionAll, found)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["rel_path", "name", "size", "content", "error"])


def _read(full: str, rel: str, error: str) -> tuple:
    name = os.path.basename(full)
    try:
        name.encode("utf-8")
    except UnicodeEncodeError:  # not a valid name: keep its ending
        name, rel = "file" + os.path.splitext(name)[1].encode("utf-8", "replace").decode(), rel.encode("utf-8", "replace").decode()
    if error:
        return (rel, name, 0, None, error)
    try:
        content = Path(full).read_bytes()
        return (rel, name, len(content), content, None)
    except OSError as e:
        return (rel, name, 0, None, str(e))


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, str, int, str]]):
        self.files = files


class FileTree(DataSource):
    """spark.read.format("filetree").option("path", root), with the fields of Walk as options; listed by the driver, for small trees."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        depth = options.get("max_depth")
        self.root = options["path"]
        self.walk = Walk(str(options.get("respect_ignore", "true")).lower() == "true", flag("hidden"), flag("symlinks"), int(depth) if depth else None, tuple(filter(None, options.get("exclude", "").split("\n"))), flag("generated"))

    def partitions(self) -> list[InputPartition]:
        parts, now, size = [], [], 0
        for f in listing(self.root, self.walk, global_file()):
            now.append(f)
            size += f[2] + 4096
            if size >= PARTITION_BYTES:
                parts.append(_Part(now))
                now, size = [], 0
        return [*parts, _Part(now)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for full, rel, _, error in partition.files:
            rows.append(_read(full, rel, error))
            size += rows[-1][2]
            if size >= 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def read_tree(spark: SparkSession, root: str | Path, options: Walk = Walk(), globally: str | None = None) -> DataFrame:
    """The files of a tree, or a single file, with their contents. `globally` is the user's global ignore file, looked up if not given."""
    root = os.path.abspath(root)
    if os.path.isfile(root):
        return spark.createDataFrame(_table([_read(root, "", "")]), SCHEMA)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    files = walk(spark, root, options, global_file() if globally is None else globally)
    total = files.agg(F.sum(F.col("size") + 4096)).first()[0] or 0
    n = max(1, -(-total // PARTITION_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, error in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rel = os.fsdecode(path)
                rows.append(_read(os.path.join(root, rel), rel, error or ""))
                size += rows[-1][2]
                if size >= 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return files.select("path", "error").repartition(n, "path").mapInArrow(run, SCHEMA)


def mounted(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which must be one that is mounted, as source trees are."""
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("source trees need a mounted folder: set spark.checkpoint.dir to one")
    return f"{unquote(place.path)}/{name}-{uuid.uuid4().hex}"


class ZipError(ValueError):
    pass


def read_zip(spark: SparkSession, path: str | Path | bytes, options: Walk = Walk()) -> DataFrame:
    """The files of an archive, given by its path or its bytes, as rows, by the same rules; unpacked bytes are counted as they come, not as headers claim."""
    import shutil

    if (len(path) if isinstance(path, bytes) else os.path.getsize(path)) > ZIP_LIMIT:
        raise ZipError("the archive is too large")
    try:
        archive = zipfile.ZipFile(io.BytesIO(path) if isinstance(path, bytes) else path)
    except zipfile.BadZipFile as e:
        raise ZipError(str(e)) from e
    top, total = mounted(spark, "unzipped"), 0
    os.makedirs(top)
    with archive, contextlib.ExitStack() as after:
        after.callback(shutil.rmtree, top, True)
        for entry in archive.infolist():
            target = os.path.normpath(os.path.join(top, entry.filename))
            if os.path.isabs(entry.filename) or not target.startswith(top + os.sep) and target != top:
                raise ZipError(f"{entry.filename}: outside the archive")
            if entry.is_dir():
                os.makedirs(target, exist_ok=True)
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with archive.open(entry) as source, open(target, "wb") as out:
                while block := source.read(1 << 16):
                    total += len(block)
                    if total > UNPACKED_LIMIT:
                        raise ZipError("the files of the archive are too large")
                    out.write(block)
        rows = [_read(full, rel, error) for full, rel, _, error in listing(top, options)]  # bounded by UNPACKED_LIMIT
    return spark.createDataFrame(_table(rows), SCHEMA)


def _table(rows: list[tuple]):
    return pa.Table.from_batches([_batch(rows)]) if rows else pa.table({n: pa.array([], k) for n, k in (("rel_path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string()))})


class GitError(ValueError):
    pass


def clone(url: str, folder: str | Path, timeout: float = 30) -> Path:
    """A shallow clone of an http or https repository, for read_tree."""
    import subprocess

    if not url.startswith(("http://", "https://")):
        raise GitError("only http and https addresses are cloned")
    try:
        done = subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", url, str(folder)], timeout=timeout, capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    except subprocess.TimeoutExpired as e:
        raise GitError(f"{url}: not cloned within {timeout} s") from e
    if done.returncode:
        raise GitError(done.stderr.strip() or f"{url}: not cloned")
    return Path(folder)


def read_git(spark: SparkSession, url: str, options: Walk = Walk()) -> DataFrame:
    """The files of a repository's newest commit, cloned into the shared folder, which must be a mounted one on a cluster."""
    return read_tree(spark, clone(url, mounted(spark, "clone")), options)
