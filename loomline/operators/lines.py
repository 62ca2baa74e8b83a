"""Line classification: code, comment, blank or shebang.

`classify` folds one language's lines natively (languages whose comments do not nest); `LineCounter` does the same
for any language over whole texts in an Arrow worker. Block comments are looked for before line comments, strings are not
parsed, a blank line is blank even inside a comment; see the tests for what follows from that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.content import WHITE, has_text, trim
from ..sources.catalog import Language

KINDS = ("code", "comment", "blank", "shebang")


def _java(tokens: list[str] | tuple[str, ...]) -> str:
    """Alternation of literal tokens in list order, for Java."""
    return "|".join(re.sub(r"([^\w\s]|_)", r"\\\1", t) if t.isascii() else rf"\Q{t}\E" for t in tokens)


def _line_tokens(tokens: tuple[str, ...], quote) -> str:
    """A token that begins as a word must not go on as one."""
    return "|".join(quote([t]) + (r"(?![A-Za-z0-9_])" if re.match("[A-Za-z0-9_]", t) else "") for t in tokens)


def shebang_line(line: str, language: Language) -> bool:
    if not language.shebangs or not line.startswith("#!"):
        return False
    plain = "#!" + line[3:] if line.startswith("#! ") else line
    return plain.startswith(language.shebangs)


def classify(lines: Column, language: Language) -> Column:
    """The kind of each line of one file, in order, as one fold; no Python. Not for languages that nest."""
    if language.nested and language.block_comments:
        raise ValueError(f"{language.name} nests comments; use LineCounter")
    starts, ends = ([p[k] for p in language.block_comments] for k in (0, 1))
    tokens = _line_tokens(language.line_comments, _java)

    def by_line_comment(rest: Column, code: Column) -> Column:
        plain = F.when(code | has_text(rest), "code").otherwise("comment")
        if not tokens:
            return plain
        first = F.regexp_extract(rest, f"(?s)^(.*?)(?:{tokens})", 1)
        return F.when(rest.rlike(f"(?:{tokens})"), F.when(code | has_text(first), "code").otherwise("comment")).otherwise(plain)

    def kind_and_depth(t: Column, depth: Column) -> tuple[Column, Column]:
        if not starts:
            return by_line_comment(t, F.lit(False)), F.lit(0)
        s, e = f"(?>{_java(starts)})", f"(?:{_java(ends)})"  # atomic: a start is not tried again where no end follows
        stays = (depth == 1) & ~t.rlike(e)
        rest = F.when(depth == 1, F.regexp_replace(t, f"(?s)^.*?{e}", "")).otherwise(t)
        parts = F.split(rest, f"(?s){s}.*?{e}", -1)
        last = F.element_at(parts, -1)
        before = F.exists(F.slice(parts, 1, F.size(parts) - 1), has_text)
        opens = last.rlike(s)
        code = before | (opens & has_text(F.regexp_extract(last, f"(?s)^(.*?){s}", 1)))
        kind = F.when(stays, "comment").when(opens, F.when(code, "code").otherwise("comment")).otherwise(by_line_comment(last, before))
        return kind, F.when(stays | opens, 1).otherwise(0)

    first_line = F.lit(False)
    if language.shebangs:
        def begins(t: Column) -> Column:
            plain = F.when(t.startswith("#! "), F.concat(F.lit("#!"), F.substring(t, 4, 1 << 30))).otherwise(t)
            found = F.lit(False)
            for s in language.shebangs:
                found = found | plain.startswith(s)
            return t.startswith("#!") & found
    state = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kinds"))

    def step(acc: Column, line: Column) -> Column:
        t = trim(line)
        kind, depth = kind_and_depth(t, acc["depth"])
        blank = t == ""
        shebang = (F.size(acc["kinds"]) == 0) & begins(t) if language.shebangs else first_line
        return F.struct(F.when(blank | shebang, acc["depth"]).otherwise(depth).alias("depth"), F.concat(acc["kinds"], F.array(F.when(blank, "blank").when(shebang, "shebang").otherwise(kind))).alias("kinds"))

    return F.aggregate(lines, state, step, lambda acc: acc["kinds"])


class LineCounter:
    """Counts of one language's lines by kind, over whole texts."""

    def __init__(self, language: Language):
        quote = lambda ts: "|".join(map(re.escape, ts))
        self.language = language
        starts, ends = [p[0] for p in language.block_comments], [p[1] for p in language.block_comments]
        self.start = re.compile(quote(starts)) if starts else None
        self.end = re.compile(quote(ends)) if ends else None
        self.inside = re.compile(f"(?P<end>{quote(ends)})|(?:{quote(starts)})") if starts and language.nested else self.end
        self.line = re.compile(_line_tokens(language.line_comments, quote)) if language.line_comments else None

    def kind(self, line: str, depth: int, first: bool) -> tuple[str, int]:
        t = line.strip(WHITE)
        if not t:
            return "blank", depth
        if first and shebang_line(t, self.language):
            return "shebang", depth
        at, code = 0, False
        if self.start:
            while True:
                if depth:
                    m = self.inside.search(t, at)
                    if not m:
                        break
                    depth = 0 if not self.language.nested else depth - 1 if m["end"] is not None else depth + 1
                else:
                    m = self.start.search(t, at)
                    if not m:
                        break
                    code = code or bool(t[at : m.start()].strip(WHITE))
                    depth = 1
                at = m.end()
            if depth:
                return ("code" if code else "comment"), depth
        rest = t[at:]
        if self.line and (m := self.line.search(rest)):
            return ("code" if code or rest[: m.start()].strip(WHITE) else "comment"), 0
        return ("code" if code or rest.strip(WHITE) else "comment"), 0

    def kinds(self, text: str) -> Iterator[str]:
        depth = 0
        lines = text.split("\n")
        if lines[-1] == "":
            lines.pop()
        for i, line in enumerate(lines):
            kind, depth = self.kind(line, depth, i == 0)
            yield kind

    def count(self, text: str) -> tuple[int, int, int, int, int]:
        """Lines in all, then of each kind."""
        marks = (self.start and self.start.search(text)) or (self.line and self.line.search(text))
        if not marks and not text.startswith("#!"):
            lines = text.split("\n")
            if lines[-1] == "":
                lines.pop()
            blank = sum(not x.strip(WHITE) for x in lines)
            return len(lines), len(lines) - blank, 0, blank, 0
        found = list(self.kinds(text))
        return (len(found), *(found.count(k) for k in KINDS))


#: Python's names of the encodings.
CODECS = {"UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}
