"""One Arrow pass from files to counts: name, sample, encoding, language and lines, each test before the dearer one.

The expressions of functions/content.py and operators/detect.py say the same natively, one step at a time; together
they would decode a file's sample many times over, and nested comments need Python anyway, so the plan runs this pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.content import SAMPLE
from ..sources.catalog import Language, split_patterns
from .detect import COMMENT_SCORE, KEYWORD_SCORE, traits
from .lines import CODECS, LineCounter

COUNTS = ("total_lines", "code_lines", "comment_lines", "blank_lines", "shebang_lines")
_CONTROLS = bytes([*range(9), 11, 12, *range(14, 32), 127])
_WORDS = re.compile("[A-Za-z0-9_]+")


def sample(content: bytes) -> bytes:
    middle = (len(content) - SAMPLE) // 2
    return content if len(content) <= SAMPLE else content[:SAMPLE] + content[middle - middle % 2 :][:SAMPLE]


def encoding(sampled: bytes) -> tuple[str, int]:
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if sampled.startswith(mark):
            return name, len(mark)
    even, odd = sampled[::2].count(0), sampled[1::2].count(0)
    if len(sampled) >= 4 and even + odd >= len(sampled) // 4:
        if odd >= 2 * even:
            return "UTF-16LE", 0
        if even >= 2 * odd:
            return "UTF-16BE", 0
    return "UTF-8", 0


def is_binary(sampled: bytes, name: str) -> bool:
    if not sampled or name != "UTF-8":
        return False
    return 0 in sampled or (len(sampled) - len(sampled.translate(None, _CONTROLS))) * 100 // len(sampled) > 20


class Analyser:
    def __init__(self, languages: list[Language], include: Iterable[str] = (), exclude: Iterable[str] = ()):
        self.languages, self.include, self.exclude = languages, {x.lower() for x in include}, {x.lower() for x in exclude}
        names, endings, globs = split_patterns(languages)
        self.names: dict[str, set[int]] = {}
        self.endings: dict[str, set[int]] = {}
        for table, pairs in ((self.names, names), (self.endings, endings)):
            for p, i in pairs:
                table.setdefault(p, set()).add(i)
        self.globs = [(re.compile(p), i) for p, i in globs]
        self.shebangs = [(s, x.idx) for x in languages for s in x.shebangs]
        self.traits: dict[int, dict] = {}
        self.counters: dict[tuple, LineCounter] = {}
        self.by_name: dict[str, list[int]] = {}

    def candidates(self, name: str) -> list[int]:
        low = name.lower()
        found = set(self.names.get(low, ()))
        at = low.find(".")
        while at >= 0:
            found |= self.endings.get(low[at:], set())
            at = low.find(".", at + 1)
        return sorted(found | {i for p, i in self.globs if p.match(low)})

    def shebang(self, text: str) -> int | None:
        line = text.split("\n", 1)[0].strip()
        if not line.startswith("#!"):
            return None
        plain = "#!" + line[3:] if line.startswith("#! ") else line
        return next((i for s, i in self.shebangs if plain.startswith(s)), None)

    def score(self, text: str, words: list[str], i: int) -> int:
        t = self.traits.get(i) or self.traits.setdefault(i, traits(self.languages[i]))
        comments = sum(x in text for x in t["line"]) + sum(b["a"] in text and b["b"] in text for b in t["block"])
        times = [(text.count(k["k"]), k["n"]) for k in t["special"]]
        if t["symbols"] and words and 2 * sum(a * b for a, b in times) < len("".join(text.split())):
            return 0
        return comments * COMMENT_SCORE + KEYWORD_SCORE * (sum(words.count(k) for k in t["plain"]) + sum(a for a, _ in times))

    def language(self, found: list[int], sampled: bytes, name: str, bom: int) -> int | None:
        if len(found) == 1:
            return found[0]
        text = sampled[bom:].decode(CODECS[name], "replace")
        said = self.shebang(text)
        if said is not None or not found:
            return said
        words = _WORDS.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORDS.findall(text)]
        best = max((self.score(text, words, i), i) for i in found)
        return best[1] if best[0] > 0 else None

    def wanted(self, i: int) -> bool:
        name = self.languages[i].name.lower()
        return name in self.include if self.include else name not in self.exclude

    def file(self, name: str, content: bytes) -> tuple[int, tuple[int, ...] | None] | None:
        """(language, counts) of a file that counts; counts are of its lines."""
        found = self.by_name.get(name)
        if found is None:
            found = self.candidates(name)
            if len(self.by_name) < 100_000:
                self.by_name[name] = found
        if not content:
            return (found[0], (0,) * 5) if len(found) == 1 and self.wanted(found[0]) else None
        sampled = sample(content)
        codec, bom = encoding(sampled)
        if is_binary(sampled, codec):
            return None
        i = self.language(found, sampled, codec, bom)
        if i is None or not self.wanted(i):
            return None
        x = self.languages[i]
        counter = self.counters.get(x.syntax) or self.counters.setdefault(x.syntax, LineCounter(x))
        return i, counter.count(content[bom:].decode(CODECS[codec], "replace"))


def analyse(files: DataFrame, languages: list[Language], include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """rel_path, lang and the counts of the files that have a language that is asked for."""
    include, exclude = tuple(include), tuple(exclude)
    schema = "rel_path string, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Analyser(languages, include, exclude)
        for batch in batches:
            rows = []
            for path, name, size, content in zip(*(c.to_pylist() for c in batch.columns)):
                if got := work.file(name or "", content or b""):
                    rows.append((path, languages[got[0]].name, *got[1], size))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["rel_path", "lang", *COUNTS, "size"])

    return files.select("rel_path", "name", "size", "content").mapInArrow(run, schema)
