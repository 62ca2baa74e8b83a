"""Reports over a table of file counts: what is shown, and seven renderings of it.

Grouping, sorting and cutting run in Spark; the driver gets the groups that are shown, one row a language or top-level
directory. The files of a verbose report come sorted from Spark, partition after partition, and are written as they come, so
that the driver never holds them all: `parts` gives the report piece by piece, `render` as one text.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import IntEnum
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.formats import LINE_KINDS, SEPARATORS, UNITS, NumberStyle, SizeUnits
from .operators import aggregate as A

KINDS = tuple(k for k, *_ in LINE_KINDS)
NOTHING = "No recognized programming languages found."


class Verbosity(IntEnum):
    SUMMARY = 0
    REGULAR = 1
    VERBOSE = 2


@dataclass(frozen=True)
class View:
    verbosity: Verbosity = Verbosity.REGULAR
    number_style: NumberStyle = NumberStyle.PLAIN
    size_units: SizeUnits = SizeUnits.BINARY
    precision: int = 1
    sort_by: A.SortKey = A.SortKey.LINES
    descending: bool = True
    indent: str = "\t"
    top_languages: int | None = None
    min_lines: int | None = None
    by_dir: bool = False

    def number(self, n: int) -> str:
        return str(n) if self.number_style == NumberStyle.PLAIN else f"{n:,}".replace(",", SEPARATORS[NumberStyle(self.number_style)])

    def percent(self, x: float) -> str:
        return f"{x:.{min(6, self.precision)}f}"

    def size(self, n: int) -> str:
        base, names = UNITS[SizeUnits(self.size_units)]
        power = 0
        while power < len(names) - 1 and n >= base ** (power + 1):
            power += 1
        x = n / base**power
        return f"{self.number(n)} B" if not power else f"{x:.{2 if x < 10 else 1 if x < 100 else 0}f} {names[power]}"


def share(part: int, whole: int) -> float:
    return part / whole * 100.0 if whole else 0.0


def plural(n: int, one: str, many: str) -> str:
    return one if n == 1 else many


def listed(parts: list[str]) -> str:
    return " and ".join(parts) if len(parts) < 3 else f"{', '.join(parts[:-1])}, and {parts[-1]}"


def _counts(row, view: View) -> dict:
    out = {k: row[k] for k in ("files", "lines", *A.MEASURES, "size")}
    out["size_human"] = view.size(row["size"])
    return out | {f"{k}_percentage": share(row[f"{k}_lines"], row["lines"]) for k in KINDS}


def _file(row, view: View) -> dict:
    out = {"path": row["rel_path"], "total_lines": row["total_lines"]} | {m: row[m] for m in A.MEASURES}
    return out | {"size": row["size"], "size_human": view.size(row["size"])}


def _groups(stats: DataFrame, view: View, root: str, directories: bool) -> tuple[list[dict], int]:
    """The shown groups in order, and how many are not."""
    groups = A.by_directory(stats, root) if directories else A.by_language(stats)
    shown = [r.asDict() for r in A.top(groups, view.sort_by, view.descending, view.top_languages, view.min_lines, directories).collect()]
    gone = groups.count() - len(shown) if view.top_languages is not None or view.min_lines is not None else 0
    out = []
    for r in shown:
        c = _counts(r, view)
        if directories:
            out.append({"path": r["name"]} | c)
        else:
            c = {"name": r["name"]} | {k: v for k, v in c.items() if not k.endswith("_percentage")} | {"avg_lines_per_file": r["avg_lines_per_file"]} | {k: v for k, v in c.items() if k.endswith("_percentage")}
            out.append(c)
    if out and view.verbosity == Verbosity.VERBOSE:
        key = A.directory_key(F.col("rel_path"), root) if directories else F.col("lang")
        name = "path" if directories else "name"
        known = stats.sparkSession.createDataFrame([(g[name], i) for i, g in enumerate(out)], "group string, number int")
        files = stats.withColumn("group", key).join(F.broadcast(known), "group").orderBy("number", *A.file_order(view.sort_by, view.descending))
        come = _Come(files, view)
        for i, g in enumerate(out):
            g["files_detail"] = _Files(come, i)
    return out, gone


class _Come:
    """The files of all groups as they come from Spark, group after group."""

    def __init__(self, files: DataFrame, view: View):
        self.files, self.view, self.groups, self.at = files, view, None, -1

    def of(self, number: int) -> Iterator[dict]:
        if self.groups is None or number <= self.at:  # asked anew
            self.groups = groupby(self.files.toLocalIterator(prefetchPartitions=True), key=lambda r: r["number"])
        self.at = number
        for i, rows in self.groups:
            if i == number:  # every shown group has files
                for r in rows:
                    yield _file(r, self.view)
                return


class _Files(list):
    """The files of one group; they are fetched when they are iterated over, as the JSON encoder does with lists."""

    def __init__(self, come: _Come, number: int):
        super().__init__()
        self.come, self.number = come, number

    def __iter__(self) -> Iterator[dict]:
        return self.come.of(self.number)

    def __len__(self) -> int:
        return 1  # at least


def build(stats: DataFrame, path: str, view: View = View()) -> dict:
    """The report as nested dictionaries, in the order of its JSON."""
    t = A.totals(stats).first()
    c = _counts(t, view)
    summary = {f"total_{k}": c[k] for k in ("files", "lines", *A.MEASURES, "size", "size_human")} | {k: v for k, v in c.items() if k.endswith("_percentage")}
    report: dict = {"analysis_path": path, "summary": summary, "languages": []}
    root = path.rstrip("/").rsplit("/", 1)[-1] if "/" not in path.strip("/") else path.rstrip("/")
    if view.verbosity > Verbosity.SUMMARY:
        report["languages"], languages_hidden = _groups(stats, view, root, False)
        dirs_hidden = 0
        if view.by_dir:
            found, dirs_hidden = _groups(stats, view, root, True)
            if found:
                report["directories"] = found
        if languages_hidden:
            report["languages_hidden"] = languages_hidden
        if dirs_hidden:
            report["dirs_hidden"] = dirs_hidden
    return report


def _kinds(r: dict, prefix: str = "") -> list[tuple]:
    """(one, many, title, lines, percent) of the kinds that occur."""
    return [(one, many, title, n, r[f"{k}_percentage"]) for k, one, many, title in LINE_KINDS if (n := r[f"{prefix}{k}_lines"])]


def human(report: dict, view: View, stats: DataFrame | None = None) -> Iterator[str]:
    s, num, pct = report["summary"], view.number, view.percent
    out = [
        f"Statistics for {report['analysis_path']}: {num(s['total_files'])} {plural(s['total_files'], 'file', 'files')}, {num(s['total_lines'])} total {plural(s['total_lines'], 'line', 'lines')}, {s['total_size_human']} total size."
    ]
    kinds = _kinds(s, "total_")
    if kinds:
        out.append(f"Line breakdown: {listed([f'{num(n)} {one} {plural(n, 'line', 'lines')}' for one, _, _, n, _ in kinds])}.")
        out.append(f"Percentages: {listed([f'{pct(p)}% {many}' for _, many, _, _, p in kinds])}.")
    if view.verbosity == Verbosity.SUMMARY:
        if stats is not None and s["total_files"]:
            groups = A.top(A.by_language(stats), view.sort_by, view.descending, view.top_languages, view.min_lines).collect()
            out.append("Languages: " + ", ".join(f"{num(g['files'])} {g['name']} {plural(g['files'], 'file', 'files')} ({pct(share(g['files'], s['total_files']))}%)" for g in groups) + ".")
        yield "\n".join(out) + "\n"
        return
    groups = report.get("directories", []) if view.by_dir else report["languages"]
    if not groups:
        yield "\n".join([*out, NOTHING]) + "\n"
        return
    i1, i2 = view.indent, view.indent * 2
    out.append("Directory breakdown:" if view.by_dir else "Language breakdown:")
    for g in groups:
        out.append(f"{g['path' if view.by_dir else 'name']}:")
        out.append(f"{i1}Files: {num(g['files'])} {plural(g['files'], 'file', 'files')} ({pct(share(g['files'], s['total_files']))}% of total).")
        out.append(f"{i1}Lines: {num(g['lines'])} {plural(g['lines'], 'line', 'lines')} ({pct(share(g['lines'], s['total_lines']))}% of total).")
        if not view.by_dir:
            out.append(f"{i1}Average lines per file: {g['avg_lines_per_file']:.1f}.")
        out.append(f"{i1}Size: {g['size_human']} ({pct(share(g['size'], s['total_size']))}% of total).")
        out.append(f"{i1}Line breakdown:")
        out += [f"{i2}{title}: {num(n)} lines ({pct(p)}%)." for _, _, title, n, p in _kinds(g)]
        if "files_detail" in g:
            out.append(f"{i1}File breakdown:")
            yield "\n".join(out) + "\n"
            out = []
            for f in g["files_detail"]:
                yield f"{i2}{f['path']}: {num(f['total_lines'])} lines, {f['size_human']} ({pct(share(f['total_lines'], s['total_lines']))}% of total lines).\n"
    gone = report.get("dirs_hidden" if view.by_dir else "languages_hidden", 0)
    if gone:
        out.append(f"({gone} {plural(gone, 'directory', 'directories') if view.by_dir else plural(gone, 'language', 'languages')} not shown)")
    yield "".join(f"{line}\n" for line in out)


def as_json(report: dict, view: View, compact: bool = False) -> Iterator[str]:
    yield from json.JSONEncoder(ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": view.indent})).iterencode(report)
    yield "\n"


def _csv(field: str) -> str:
    return '"' + field.replace('"', '""') + '"' if any(c in field for c in ',"\n\r') else field


def _tsv(field: str) -> str:
    return field.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


LANGUAGE_COLUMNS = ("files", "lines", "avg_lines_per_file", "code_lines", "comment_lines", "blank_lines", "shebang_lines", "size", "size_human", "code_percentage", "comment_percentage", "blank_percentage", "shebang_percentage")
FILE_COLUMNS = ("total_lines", "code_lines", "comment_lines", "blank_lines", "shebang_lines", "size", "size_human")


def separated(report: dict, view: View, delimiter: str = ",") -> Iterator[str]:
    escape, num, pct, s = (_csv if delimiter == "," else _tsv), view.number, view.percent, report["summary"]

    def row(*fields: str) -> str:
        return delimiter.join(map(escape, fields)) + "\n"

    def cell(k: str, v) -> str:
        return f"{v:.1f}" if k.startswith("avg") else pct(v) if k.endswith("percentage") else v if isinstance(v, str) else num(v)

    summary = "Summary:\n" + row("metric", "value", "percentage", "human_readable") + row("Analysis Path", report["analysis_path"], "", "")
    for label, k, p in (("Total Files", "files", ""), ("Total Lines", "lines", ""), ("Code Lines", "code_lines", "code"), ("Comment Lines", "comment_lines", "comment"), ("Blank Lines", "blank_lines", "blank"), ("Shebang Lines", "shebang_lines", "shebang"), ("Total Size", "size", "")):
        summary += row(label, num(s[f"total_{k}"]), pct(s[f"{p}_percentage"]) if p else "", s["total_size_human"] if k == "size" else "")
    languages = row("language", *LANGUAGE_COLUMNS) + "".join(row(g["name"], *(cell(k, g[k]) for k in LANGUAGE_COLUMNS)) for g in report["languages"])
    if view.verbosity < Verbosity.VERBOSE:
        yield summary if view.verbosity == Verbosity.SUMMARY else languages
        return
    yield f"{summary}\nLanguage breakdown:\n{languages}\n\n"
    for g in report["languages"]:
        if "files_detail" in g:
            yield f"{g['name']} files:\n" + row("file_path", *FILE_COLUMNS)
            for f in g["files_detail"]:
                yield row(f["path"], *(cell(k, f[k]) for k in FILE_COLUMNS))
            yield "\n"


HEADS = ("Language", "Files", "Lines", "Average Lines per File", "Code %", "Comment %", "Blank %", "Shebang %", "Size")


def _language_cells(g: dict, view: View) -> list[str]:
    return [g["name"], view.number(g["files"]), view.number(g["lines"]), f"{g['avg_lines_per_file']:.1f}", *(f"{view.percent(g[f'{k}_percentage'])}%" for k in KINDS), g["size_human"]]


def _file_cells(f: dict, view: View) -> list[str]:
    return [f["path"], *(view.number(f[k]) for k in ("total_lines", *A.MEASURES)), f["size_human"]]


def markdown(report: dict, view: View) -> Iterator[str]:
    s, kinds = report["summary"], _kinds(report["summary"], "total_")

    def row(cells: list[str]) -> str:
        return "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |\n"

    def head(heads: tuple[str, ...]) -> str:
        return "| " + " | ".join(heads) + " |\n| --- |" + " ---: |" * (len(heads) - 1) + "\n"

    yield f"# Statistics for `{report['analysis_path']}`\n\n## Summary\n\n- Files: {view.number(s['total_files'])}\n- Lines: {view.number(s['total_lines'])}\n- Size: {s['total_size_human']}\n"
    if kinds:
        yield f"- Line types: {', '.join(f'{view.number(n)} {many}' for _, many, _, n, _ in kinds)}\n- Totals: {', '.join(f'{view.percent(p)}% {many}' for _, many, _, _, p in kinds)}\n"
    if not report["languages"]:
        yield f"\n_{NOTHING}_\n"
        return
    yield "\n## Languages\n\n" + head(HEADS) + "".join(row(_language_cells(g, view)) for g in report["languages"])
    if view.verbosity == Verbosity.VERBOSE:
        yield "\n## Files\n"
        for g in report["languages"]:
            yield f"\n### {g['name'].replace('|', chr(92) + '|')}\n\n" + head(("File", "Total lines", "Code lines", "Comment lines", "Blank lines", "Shebang lines", "Size"))
            for f in g["files_detail"]:
                yield row(_file_cells(f, view))


def as_html(report: dict, view: View) -> Iterator[str]:
    s, kinds = report["summary"], _kinds(report["summary"], "total_")

    def row(cells: list[str]) -> str:
        return "<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in cells) + "</tr>\n"

    def head(heads: tuple[str, ...]) -> str:
        return "<table>\n<tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>\n"

    title = f"Statistics for {html.escape(report['analysis_path'])}"
    items = [f"Files: {view.number(s['total_files'])}", f"Lines: {view.number(s['total_lines'])}", f"Size: {s['total_size_human']}"]
    if kinds:
        items.append("Totals: " + ", ".join(f"{view.percent(p)}% {many}" for _, many, _, _, p in kinds))
    yield f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8" />\n<meta name="viewport" content="width=device-width, initial-scale=1" />\n<title>{title}</title>\n</head>\n<body>\n<h1>{title}</h1>\n'
    yield "<details open>\n<summary><h2>Summary</h2></summary>\n<ul>\n" + "".join(f"<li>{i}</li>\n" for i in items) + "</ul>\n</details>\n"
    body = head(HEADS) + "".join(row(_language_cells(g, view)) for g in report["languages"]) + "</table>\n" if report["languages"] else f"<p>{NOTHING}</p>\n"
    yield f"<details>\n<summary><h2>Languages</h2></summary>\n{body}</details>\n"
    if view.verbosity == Verbosity.VERBOSE:
        yield "<details>\n<summary><h2>Files</h2></summary>\n"
        for g in report["languages"]:
            yield f"<h3>{html.escape(g['name'])}</h3>\n" + head(("Path", "Lines", "Code", "Comments", "Blanks", "Shebangs", "Size"))
            for f in g["files_detail"]:
                yield row(_file_cells(f, view))
            yield "</table>\n"
        yield "</details>\n"
    yield "</body>\n</html>\n"


FORMATS = ("human", "json", "json-compact", "csv", "tsv", "markdown", "html")


def parts(stats: DataFrame, path: str, view: View = View(), output: str = "human") -> Iterator[str]:
    """One of FORMATS, piece by piece. Only human and the JSON forms show directories."""
    renderers: dict[str, Callable[[dict], Iterator[str]]] = {
        "human": lambda r: human(r, view, stats), "json": lambda r: as_json(r, view), "json-compact": lambda r: as_json(r, view, True),
        "csv": lambda r: separated(r, view), "tsv": lambda r: separated(r, view, "\t"), "markdown": lambda r: markdown(r, view), "html": lambda r: as_html(r, view),
    }
    if output not in renderers:
        raise ValueError(f"unknown output {output}")
    return renderers[output](build(stats, path, view))


def render(stats: DataFrame, path: str, view: View = View(), output: str = "human") -> str:
    """The whole report as one text, for reports that fit in memory."""
    return "".join(parts(stats, path, view, output))


def language_listing(names: list[str], width: int = 80) -> str:
    """A count and the names, wrapped."""
    lines, now = [], ""
    for i, name in enumerate(names):
        item = name + ("." if i == len(names) - 1 else ", ")
        if now and len(now) + len(item) > width:
            lines.append(now)
            now = ""
        now += item
    head = f"Total number of supported programming {plural(len(names), 'language', 'languages')}: {len(names)}"
    return "\n".join([head, *lines, *([now] if now else [])]) + "\n"
