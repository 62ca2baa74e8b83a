"""Queries that render reports of the corpus in every format; their SQL writes the same lines, or reads the same numbers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from . import report
from .queries import _BY_DIR, _BY_LANG, _HUMAN, _PCT, _SUMS, corpus_stats, query

PATH = "corpus"
_KINDS = ("code", "comment", "blank", "shebang")
_MANY = {"code": "code", "comment": "comments", "blank": "blanks", "shebang": "shebangs"}


def _lines(spark: SparkSession, sf_dir: str, output: str, view: report.View = report.View()) -> DataFrame:
    """The lines of a report with their numbers from 1."""
    text = "".join(report.parts(corpus_stats(spark, sf_dir).persist(), PATH, view, output))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "n int, line string")


def _listed(items: str) -> str:
    return f"(CASE WHEN len({items}) < 3 THEN array_to_string({items}, ' and ') ELSE array_to_string({items}[:-2], ', ') || ', and ' || {items}[-1] END)"


def _shown(x: str, kind: str) -> str:
    return f"printf('%.1f', {_PCT.format(f'{x}.{kind}_lines').replace('lines = 0', f'{x}.lines = 0').replace('/ lines::', f'/ {x}.lines::')})"


def _present(x: str, text: str) -> str:
    """List of a text for each kind of line that there is; {k} its name, {many} its plural."""
    each = ", ".join(f"CASE WHEN {x}.{k}_lines > 0 THEN {text.format(k=k, many=_MANY[k], title=k.title() if k == 'code' else _MANY[k].title(), pct=_shown(x, k))} END" for k in _KINDS)
    return f"list_filter([{each}], lambda s: s IS NOT NULL)"


# l: languages in order; d: top directories; t: the total.
_L = f"{_BY_LANG}, l AS (SELECT *, {_HUMAN} AS human, row_number() OVER (ORDER BY lines DESC, name DESC) AS rn FROM g), t AS (SELECT {_SUMS}, {_HUMAN.replace('size', 'sum(size)::BIGINT')} AS human FROM stats)"
_END = "SELECT row_number() OVER (ORDER BY a, b, c)::INT AS n, line FROM o"
_LINE = "CASE WHEN {n} = 1 THEN 'line' ELSE 'lines' END"
_FILE = "CASE WHEN {n} = 1 THEN 'file' ELSE 'files' END"

_HEAD = f"""SELECT 0 AS a, 1 AS b, 1 AS c, 'Statistics for {PATH}: ' || files || ' ' || {_FILE.format(n='files')} || ', ' || lines || ' total ' || {_LINE.format(n='lines')} || ', ' || human || ' total size.' AS line FROM t
UNION ALL SELECT 0, 1, 2, 'Line breakdown: ' || {_listed(_present('t', "t.{k}_lines || ' {k} ' || CASE WHEN t.{k}_lines = 1 THEN 'line' ELSE 'lines' END"))} || '.' FROM t
UNION ALL SELECT 0, 1, 3, 'Percentages: ' || {_listed(_present('t', "{pct} || '% {many}'"))} || '.' FROM t"""


def _share(part: str, whole: str) -> str:
    return f"printf('%.1f', {part}::DOUBLE / {whole}::DOUBLE * 100.0)"


def _group(x: str, label: str, average: bool) -> str:
    """The lines of a group in the human report."""
    tab = "chr(9)"
    texts = [f"{x}.name || ':'"]
    texts.append(f"{tab} || 'Files: ' || {x}.files || ' ' || {_FILE.format(n=f'{x}.files')} || ' (' || {_share(f'{x}.files', 't.files')} || '% of total).'")
    texts.append(f"{tab} || 'Lines: ' || {x}.lines || ' ' || {_LINE.format(n=f'{x}.lines')} || ' (' || {_share(f'{x}.lines', 't.lines')} || '% of total).'")
    if average:
        texts.append(f"{tab} || 'Average lines per file: ' || printf('%.1f', {x}.lines::DOUBLE / {x}.files::DOUBLE) || '.'")
    texts.append(f"{tab} || 'Size: ' || {x}.human || ' (' || {_share(f'{x}.size', 't.size')} || '% of total).'")
    texts.append(f"{tab} || 'Line breakdown:'")
    kinds = _present(x, f"{tab} || {tab} || '{{title}}: ' || {x}.{{k}}_lines || ' lines (' || {{pct}} || '%).'")
    return f"SELECT 2 AS a, rn AS b, u.c, u.line FROM (SELECT {x}.rn, unnest(list_transform(list_concat([{', '.join(texts)}], {kinds}), lambda s, i: {{'c': i, 'line': s}})) AS u FROM {label} {x}, t)"


@query(f"{_L}, o AS ({_HEAD} UNION ALL SELECT 1, 1, 1, 'Language breakdown:' UNION ALL {_group('l', 'l', True)} UNION ALL SELECT 3, 1, 1, '') {_END}")
def g1_human(spark, sf_dir):
    return _lines(spark, sf_dir, "human")


@query(f"{_BY_DIR}, l AS (SELECT *, {_HUMAN} AS human, row_number() OVER (ORDER BY lines DESC, name DESC) AS rn FROM g), t AS (SELECT {_SUMS}, {_HUMAN.replace('size', 'sum(size)::BIGINT')} AS human FROM stats), o AS ({_HEAD} UNION ALL SELECT 1, 1, 1, 'Directory breakdown:' UNION ALL {_group('l', 'l', False)} UNION ALL SELECT 3, 1, 1, '') {_END}")
def g1_human_by_directory(spark, sf_dir):
    return _lines(spark, sf_dir, "human", report.View(by_dir=True))


@query(f"""{_L}, o AS ({_HEAD}
UNION ALL SELECT 1, 1, 1, 'Languages: ' || string_agg(l.files || ' ' || l.name || ' ' || {_FILE.format(n='l.files')} || ' (' || {_share('l.files', 't.files')} || '%)', ', ' ORDER BY l.rn) || '.' FROM l, t
UNION ALL SELECT 3, 1, 1, '') {_END}""")
def g2_f4_quiet(spark, sf_dir):
    return _lines(spark, sf_dir, "human", report.View(verbosity=report.Verbosity.SUMMARY))


_NUMBERS = "files, lines, code_lines, comment_lines, blank_lines, shebang_lines, size"
_READ = f"SELECT 'language' AS kind, name, {_NUMBERS}, human AS size_human, {_PCT.format('code_lines')} AS code_percentage FROM l UNION ALL SELECT 'summary', '{PATH}', {_NUMBERS}, human, {_PCT.format('code_lines')} FROM t"


def _read(spark: SparkSession, sf_dir: str, output: str) -> DataFrame:
    """The numbers of a JSON report."""
    text = "".join(report.parts(corpus_stats(spark, sf_dir).persist(), PATH, report.View(), output))
    if output == "json-compact" and text.count("\n") != 1:
        raise ValueError("a compact report is one line")
    got = json.loads(text)
    columns = _NUMBERS.split(", ")
    rows = [("language", g["name"], *(g[c] for c in columns), g["size_human"], g["code_percentage"]) for g in got["languages"]]
    s = got["summary"]
    rows.append(("summary", got["analysis_path"], *(s[f"total_{c}"] for c in columns), s["total_size_human"], s["code_percentage"]))
    return spark.createDataFrame(rows, f"kind string, name string, {', '.join(f'{c} long' for c in columns)}, size_human string, code_percentage double")


@query(f"{_L} {_READ}")
def g3_json(spark, sf_dir):
    return _read(spark, sf_dir, "json")


@query(f"{_L} {_READ}")
def g4_json_compact(spark, sf_dir):
    return _read(spark, sf_dir, "json-compact")


_CELLS = ["l.name", "l.files", "l.lines", "printf('%.1f', l.lines::DOUBLE / l.files::DOUBLE)", *(f"l.{k}_lines" for k in _KINDS), "l.size", "l.human", *(_shown("l", k) for k in _KINDS)]


def _separated(delimiter: str) -> str:
    heads = delimiter.join(["language", *report.LANGUAGE_COLUMNS])
    return f"{_L}, o AS (SELECT 0 AS a, 0 AS b, 0 AS c, '{heads}' AS line UNION ALL SELECT 1, rn, 0, concat_ws('{delimiter}', {', '.join(_CELLS)}) FROM l UNION ALL SELECT 2, 0, 0, '') {_END}"


@query(_separated(","))
def g5_csv(spark, sf_dir):
    return _lines(spark, sf_dir, "csv")


@query(_separated("\t"))
def g6_tsv(spark, sf_dir):
    return _lines(spark, sf_dir, "tsv")


_ROW = ["l.name", "l.files", "l.lines", "printf('%.1f', l.lines::DOUBLE / l.files::DOUBLE)", *(f"{_shown('l', k)} || '%'" for k in _KINDS), "l.human"]


@query(f"""{_L}, o AS (
SELECT 0 AS a, u.b, 0 AS c, u.line FROM (SELECT unnest(list_transform(['# Statistics for `{PATH}`', '', '## Summary', '', '- Files: ' || files, '- Lines: ' || lines, '- Size: ' || human,
  '- Line types: ' || array_to_string({_present('t', "t.{k}_lines || ' {many}'")}, ', '), '- Totals: ' || array_to_string({_present('t', "{pct} || '% {many}'")}, ', '), '', '## Languages', '',
  '| {' | '.join(report.HEADS)} |', '| --- |{' ---: |' * (len(report.HEADS) - 1)}'], lambda s, i: {{'b': i, 'line': s}})) AS u FROM t)
UNION ALL SELECT 1, rn, 0, '| ' || concat_ws(' | ', {', '.join(_ROW)}) || ' |' FROM l UNION ALL SELECT 2, 0, 0, '') {_END}""")
def g7_markdown(spark, sf_dir):
    return _lines(spark, sf_dir, "markdown")


@query(f"""{_L}, o AS (SELECT 1 AS a, rn AS b, 0 AS c, '<tr><td>' || concat_ws('</td><td>', {', '.join(_ROW)}) || '</td></tr>' AS line FROM l
UNION ALL SELECT 0, 1, u.c, u.line FROM (SELECT unnest(list_transform(['<h1>Statistics for {PATH}</h1>', '<li>Files: ' || files || '</li>', '<li>Lines: ' || lines || '</li>', '<li>Size: ' || human || '</li>',
  '<li>Totals: ' || array_to_string({_present('t', "{pct} || '% {many}'")}, ', ') || '</li>'], lambda s, i: {{'c': i, 'line': s}})) AS u FROM t)) {_END}""")
def g8_html(spark, sf_dir):
    """The title, the items of the summary and the rows of the table, in their order."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    lines = _lines(spark, sf_dir, "html").where(F.col("line").rlike("^<(h1|li|tr><td)>"))  # a report's lines: as many as languages
    return lines.select(F.row_number().over(W.orderBy("n")).alias("n"), "line")
