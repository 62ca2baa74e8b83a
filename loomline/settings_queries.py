"""Queries of what the driver does alone, catalog checks, settings and listings, as tables; their SQL states what has to come out."""

from __future__ import annotations

import contextlib
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import config, report
from .operators.aggregate import SortKey
from .queries import query
from .sources import catalog, files

@contextlib.contextmanager
def _folder(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for as long as it is needed."""
    path = files.mounted(spark, "settings")
    os.makedirs(path)
    try:
        yield path
    finally:
        shutil.rmtree(path, True)


_BAD = {
    "a pattern shared without keywords": '{A: {file_patterns: ["*.x"]}, B: {file_patterns: ["*.x"]}}',
    "an empty token": '{A: {file_patterns: ["*.x"], line_comments: [""]}}',
    "no pattern": "{A: {}}",
    "not in order": '{B: {file_patterns: ["*.b"]}, A: {file_patterns: ["*.a"]}}',
    "the same name": '{A: {file_patterns: ["*.b"]}, a: {file_patterns: ["*.a"]}}',
    "white space": '{A: {file_patterns: [" *.a"]}}',
}


@query(f"SELECT * FROM (VALUES {', '.join(f"('{k}', true)" for k in _BAD)}, ('a sound one', false)) t(catalog, refused)")
def a9_catalog_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    with _folder(spark) as folder:
        for name, text in (_BAD | {"a sound one": '{A: {file_patterns: ["*.x"], keywords: ["k"]}, B: {file_patterns: ["*.x"], keywords: ["l"]}}'}).items():
            path = Path(folder) / "c.json5"
            path.write_text(text)
            try:
                catalog.read(path)
                rows.append((name, False))
            except catalog.CatalogError:
                rows.append((name, True))
    return spark.createDataFrame(rows, "catalog string, refused boolean")


@query("""SELECT * FROM (VALUES ('by_dir', 'true'), ('exclude', 'a,b'), ('output', 'csv'), ('path', 'sub'), ('precision', '6'), ('sort_by', 'size'), ('sort_direction', 'asc'), ('top_languages', '3')) t(setting, value)""")
def a10_a12_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's settings with those of the command line on top: what differs from the defaults."""
    with _folder(spark) as folder:
        path = Path(folder) / "s.toml"
        path.write_text('path = "sub"\nprecision = 9\nexclude = ["a"]\nunknown = 1\ntop_languages = 3\noutput = "json"\n[display]\nsort_by = "size"\n')
        merged = config.merge(config.from_file(path), {"exclude": ["b"], "sort_direction": "asc", "output": "csv", "by_dir": True, "min_lines": None})
    rows = []
    for name, default in vars(config.Config()).items():
        value = getattr(merged, name)
        if value != default:
            shown = ",".join(value) if isinstance(value, tuple) else str(value).lower() if isinstance(value, bool) else Path(value).name if name == "path" else str(value)
            rows.append((name, shown))
    return spark.createDataFrame(rows, "setting string, value string")


@query("SELECT * FROM (VALUES (1, '/w/.loomline.toml'), (2, '/w/loomline.toml'), (3, '/x/loomline/config.toml'), (4, '/h/.loomline.toml')) t(n, place)")
def a11_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = config.places(Path("/w"), {"HOME": "/h", "XDG_CONFIG_HOME": "/x"})
    return spark.createDataFrame([(i, str(p)) for i, p in enumerate(found, 1)], "n int, place string")


@query("""SELECT * FROM (VALUES ('indent 4', '    '), ('indent tab', chr(9)), ('indent 9', 'refused'), ('indent x', 'refused'), ('one file', 'file'), ('two files', 'files'), ('no parts', ''), ('two parts', 'a and b'),
  ('three parts', 'a, b, and c'), ('half', '50.0'), ('nothing of nothing', '0.0'), ('1024', '1.00 KiB')) t(what, shown)""")
def c33_c36_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, rows = report.View(), []
    for x in ("4", "tab", "9", "x"):
        try:
            rows.append((f"indent {x}", config.indent(x)))
        except config.ConfigError:
            rows.append((f"indent {x}", "refused"))
    rows += [("one file", report.plural(1, "file", "files")), ("two files", report.plural(2, "file", "files")), ("no parts", report.listed([])), ("two parts", report.listed(["a", "b"])), ("three parts", report.listed(["a", "b", "c"]))]
    rows += [("half", view.percent(report.share(1, 2))), ("nothing of nothing", view.percent(report.share(0, 0))), ("1024", view.size(1024))]
    return spark.createDataFrame(rows, "what string, shown string")


@query("SELECT 'Total number of supported programming languages: 544' AS head, 544::BIGINT AS names, true AS fits, true AS ends")
def g9_language_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, *lines = report.language_listing([x.name for x in catalog.builtin()], 70).rstrip("\n").split("\n")
    names = "".join(lines).rstrip(".").split(", ")
    return spark.createDataFrame([(head, len(names), all(len(x) <= 70 for x in lines), lines[-1].endswith("."))], "head string, names long, fits boolean, ends boolean")


@query("SELECT true AS defaults, true AS refused, 22::BIGINT AS settings, 'lines' AS sort_by")
def g10_settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that `init` writes holds every setting, says nothing that is not the default, and is not overwritten."""
    with _folder(spark) as folder:
        path = Path(folder) / config.FILE
        config.init(path)
        try:
            config.init(path)
            refused = False
        except FileExistsError:
            refused = True
        settings = sum(" = " in line for line in path.read_text().split("\n"))
        read = config.from_file(path)
    return spark.createDataFrame([(read == config.Config(), refused, settings, str(SortKey(read.sort_by)))], "defaults boolean, refused boolean, settings long, sort_by string")
