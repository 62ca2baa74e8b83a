"""Command line: analyse a folder, file, zip archive or git repository; list languages; write a settings file; shell completions.

python -m loomline [PATH] [options] | langs [--width N] [--catalog FILE] | init [FILE] [--force]
    | completions bash|zsh|fish|elvish|powershell | serve [--host H] [--port N]
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from . import report, web
from .plans.analysis import file_stats
from .sources import catalog
from .sources.files import read_git, read_tree, read_zip


COMMANDS = ("langs", "init", "completions", "serve")
SHELLS = ("bash", "zsh", "fish", "elvish", "powershell")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomline", argument_default=None)
    p.add_argument("path", nargs="?")
    p.add_argument("--config")
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("-q", "--quiet", dest="verbosity", action="store_const", const="summary")
    loud.add_argument("-v", "--verbose", dest="verbosity", action="store_const", const="verbose")
    p.add_argument("--no-gitignore", dest="respect_gitignore", action="store_const", const=False)
    for flag, name in (("--include-generated", "include_generated"), ("--hidden", "include_hidden"), ("--symlinks", "follow_symlinks"), ("--by-dir", "by_dir"), ("--fail-on-error", "fail_on_error")):
        p.add_argument(flag, dest=name, action="store_const", const=True)
    for flag in ("--max-depth", "--top-languages", "--min-lines", "--precision"):
        p.add_argument(flag, type=int)
    for flag in ("--number-style", "--size-units", "--sort-by", "--sort-direction", "--indent", "--catalog"):
        p.add_argument(flag)
    p.add_argument("-o", "--output")
    p.add_argument("-e", "--exclude", action="append")
    which = p.add_mutually_exclusive_group()
    which.add_argument("-l", "--lang", dest="languages", action="append")
    which.add_argument("-L", "--exclude-lang", dest="exclude_languages", action="append")
    return p


def files_of(spark: SparkSession, config: C.Config) -> DataFrame:
    if config.path.startswith(("http://", "https://")):
        return read_git(spark, config.path, config.walk)
    if not os.path.exists(config.path):
        raise FileNotFoundError(config.path)
    return read_zip(spark, config.path, config.walk) if config.path.endswith(".zip") else read_tree(spark, config.path, config.walk)


def analyse(spark: SparkSession, config: C.Config, write: Callable[[str], object]) -> int:
    """Writes the report part by part; the number of entries that could not be read."""
    files = files_of(spark, config)
    good = files.where(F.col("error").isNull()).drop("error")
    stats = file_stats(good, catalog.load(config.catalog), config.languages, config.exclude_languages).persist()
    try:
        for part in report.parts(stats, config.path, config.view, config.output):
            write(part)
        return files.where(F.col("error").isNotNull()).count()
    finally:
        stats.unpersist()


def completions(shell: str) -> str:
    """A completion script: the flags and commands of this parser."""
    flags = sorted(f for a in parser()._actions for f in a.option_strings)
    words = " ".join([*COMMANDS, *flags])
    if shell == "bash":
        return f"complete -o default -W '{words}' loomline\n"
    if shell == "zsh":
        return f"#compdef loomline\n_arguments '*: :({words})' '*:file:_files'\n"
    if shell == "fish":
        return "".join([f"complete -c loomline -n __fish_use_subcommand -a {c}\n" for c in COMMANDS] + [f"complete -c loomline -{'l' if f.startswith('--') else 's'} {f.lstrip('-')}\n" for f in flags])
    if shell == "elvish":
        return f"set edit:completion:arg-completer[loomline] = {{|@words| put {words} }}\n"
    if shell == "powershell":
        listed = ", ".join(f"'{w}'" for w in words.split())
        return f"Register-ArgumentCompleter -Native -CommandName loomline -ScriptBlock {{ param($word) @({listed}) | Where-Object {{ $_ -like \"$word*\" }} }}\n"
    raise ValueError(f"no completions for {shell}")


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["langs"]:
        p = argparse.ArgumentParser(prog="loomline langs")
        p.add_argument("--width", type=int, default=80)
        p.add_argument("--catalog")
        a = p.parse_args(argv[1:])
        sys.stdout.write(report.language_listing([x.name for x in catalog.load(a.catalog)], a.width))
        return 0
    if argv[:1] == ["init"]:
        p = argparse.ArgumentParser(prog="loomline init")
        p.add_argument("file", nargs="?", default=C.FILE)
        p.add_argument("--force", action="store_true")
        a = p.parse_args(argv[1:])
        C.init(a.file, a.force)
        return 0
    if argv[:1] == ["completions"]:
        p = argparse.ArgumentParser(prog="loomline completions")
        p.add_argument("shell", choices=SHELLS)
        sys.stdout.write(completions(p.parse_args(argv[1:]).shell))
        return 0
    if argv[:1] == ["serve"]:
        p = argparse.ArgumentParser(prog="loomline serve")
        p.add_argument("--host", default="127.0.0.1")
        p.add_argument("--port", type=int, default=3000)
        a = p.parse_args(argv[1:])
        web.server(SparkSession.builder.appName("loomline").getOrCreate(), a.host, a.port).serve_forever()
        return 0
    given = vars(parser().parse_args(argv))
    named = given.pop("config")
    config = C.merge(C.from_file(named) if named else C.discover(), given)
    spark = SparkSession.builder.appName("loomline").getOrCreate()
    skipped = analyse(spark, config, sys.stdout.write)
    return 1 if config.fail_on_error and skipped else 0
