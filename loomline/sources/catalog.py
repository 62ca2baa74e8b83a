"""The language catalog: the built-in table, or a JSON or JSON5 file of the same fields, checked on loading."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import json5
from .languages import LANGUAGES

SCHEMA = T.StructType(
    [
        T.StructField("idx", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("file_patterns", T.ArrayType(T.StringType())),
        T.StructField("line_comments", T.ArrayType(T.StringType())),
        T.StructField("block_comments", T.ArrayType(T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]))),
        T.StructField("nested", T.BooleanType()),
        T.StructField("shebangs", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Language:
    idx: int
    name: str
    file_patterns: tuple[str, ...]
    line_comments: tuple[str, ...] = ()
    block_comments: tuple[tuple[str, str], ...] = ()
    nested: bool = False
    shebangs: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()

    @property
    def syntax(self) -> tuple:
        """What decides how lines are classified."""
        return (self.line_comments, self.block_comments, self.nested, self.shebangs)


class CatalogError(ValueError):
    pass


_FIELDS = {"file_patterns", "line_comments", "block_comments", "nested_blocks", "shebangs", "keywords"}


def builtin() -> list[Language]:
    return [Language(i, name, tuple(p), tuple(lc), tuple(bc), nested, tuple(sb), tuple(kw)) for i, (name, p, lc, bc, nested, sb, kw) in enumerate(LANGUAGES)]


def read(path: str | Path) -> list[Language]:
    """A catalog file: an object of language names to objects with the fields above; order counts."""
    raw = json5.loads(Path(path).read_text(encoding="utf-8"))
    out = []
    for i, (name, v) in enumerate(raw.items()):
        if unknown := set(v) - _FIELDS:
            raise CatalogError(f"{name}: unknown fields {sorted(unknown)}")
        out.append(
            Language(i, name, tuple(v.get("file_patterns", ())), tuple(v.get("line_comments", ())), tuple((a, b) for a, b in v.get("block_comments", ())), bool(v.get("nested_blocks", False)), tuple(v.get("shebangs", ())), tuple(v.get("keywords", ())))
        )
    return validate(out)


def load(path: str | Path | None = None) -> list[Language]:
    return read(path) if path else builtin()


def validate(languages: list[Language]) -> list[Language]:
    """Raises CatalogError unless names are unique and in order, tokens are whole, and shared patterns can be told apart."""
    folded = [x.name.lower() for x in languages]
    if len(set(folded)) != len(folded):
        raise CatalogError("two languages have the same name")
    if folded != sorted(folded):
        raise CatalogError("languages are not in alphabetical order")
    users: dict[str, list[Language]] = {}
    for x in languages:
        if not x.file_patterns:
            raise CatalogError(f"{x.name}: no file pattern")
        tokens = [*x.line_comments, *(t for pair in x.block_comments for t in pair), *x.shebangs, *x.keywords]
        if any(not t for t in tokens) or any(not p or p != p.strip() for p in x.file_patterns):
            raise CatalogError(f"{x.name}: an empty token, or white space around a pattern")
        for p in set(x.file_patterns):
            users.setdefault(p, []).append(x)
    for p, xs in users.items():
        if len(xs) > 1 and not all(x.keywords for x in xs):
            raise CatalogError(f"{p}: shared by {', '.join(x.name for x in xs)}, not all with keywords")
    return languages


def dataframe(spark: SparkSession, languages: list[Language]) -> DataFrame:
    return spark.createDataFrame([(x.idx, x.name, list(x.file_patterns), list(x.line_comments), list(x.block_comments), x.nested, list(x.shebangs), list(x.keywords)) for x in languages], SCHEMA)


def split_patterns(languages: list[Language]) -> tuple[list[tuple[str, int]], list[tuple[str, int]], list[tuple[str, int]]]:
    """(whole names, dotted endings, other globs as regular expressions), lower case, with language numbers."""
    names, endings, globs = set(), set(), set()
    for x in languages:
        for p in (p.lower() for p in x.file_patterns):
            if not re.search(r"[*?\[\]{}]", p):
                names.add((p, x.idx))
            elif p.startswith("*.") and not re.search(r"[*?\[\]{}]", p[1:]):
                endings.add((p[1:], x.idx))
            else:
                globs.add((fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$"), x.idx))
    return sorted(names), sorted(endings), sorted(globs)
