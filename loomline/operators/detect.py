"""Language detection: candidates by file name, shebangs, and scores over a content sample.

Name patterns are split by kind so that the glob join becomes look-ups in literal maps; the catalog's size is bounded (a
few hundred languages). Content is looked at only where the name leaves several languages.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import once
from ..sources.catalog import Language, split_patterns

COMMENT_SCORE, KEYWORD_SCORE = 50, 10
#: Maps that the table of patterns is cut into.
_MAPS = 64
_WORD = re.compile(r"[A-Za-z0-9_]+")


def candidates(files: DataFrame, languages: list[Language], key: str = "rel_path", name: str = "name") -> DataFrame:
    """key, lang_idx, lang: each language that has a pattern for the file's name, once; case does not count. No shuffle."""
    each = candidate_lists(files, languages, name).select(key, F.explode("found").alias("lang_idx"))
    return each.withColumn("lang", F.get(_constant([x.name for x in languages], "array<string>"), F.col("lang_idx")))


def candidate_lists(files: DataFrame, languages: list[Language], name: str = "name") -> DataFrame:
    """files with `found`, the candidates' numbers in catalog order; map-side only, no shuffle.

    A literal table of the patterns (bounded by the catalog) stands in for a broadcast one; it is cut into small maps by
    the patterns' checksums, as a map literal is searched from end to end.
    """
    names, endings, globs = split_patterns(languages)

    def lookup(pairs: list[tuple[str, int]]) -> Callable[[Column], Column]:
        maps: list[dict[str, list[int]]] = [{} for _ in range(_MAPS)]
        for p, i in pairs:
            maps[zlib.crc32(p.encode()) % _MAPS].setdefault(p, []).append(i)
        table = _constant(maps, "array<map<string, array<int>>>")
        return lambda key: F.try_element_at(F.get(table, (F.crc32(key.cast("binary")) % _MAPS).cast("int")), key)

    by_name, by_ending = lookup(names), lookup(endings)
    none = F.array().cast("array<int>")
    low = F.lower(F.col(name))
    dots = F.split(low, r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(dots)), lambda i: F.coalesce(by_ending(F.concat(F.lit("."), F.array_join(F.slice(dots, i, F.size(dots)), "."))), none))
    found = F.concat(F.coalesce(by_name(low), none), F.when(F.size(dots) > 1, F.flatten(tails)).otherwise(none))
    for pattern, idx in globs:
        found = F.concat(found, F.when(low.rlike(pattern), F.array(F.lit(idx))).otherwise(none))
    return files.withColumn("found", F.sort_array(F.array_distinct(found)))


def shebang_language(text: Column, languages: list[Language]) -> Column:
    """Number of the first language of the catalog with a shebang that the first line begins with, else null."""
    line = F.regexp_replace(F.split(text, "\n", 2)[0], r"(?U)^\s+|\s+$", "")
    plain = F.when(line.startswith("#! "), F.concat(F.lit("#!"), F.substring(line, 4, 1 << 30))).otherwise(line)
    known = _constant([{"s": s, "i": x.idx} for x in languages for s in x.shebangs], "array<struct<s: string, i: int>>")
    return F.when(line.startswith("#!"), F.get(F.filter(known, lambda k: F.startswith(plain, k["s"])), F.lit(0))["i"])


def _constant(rows: list, kind: str) -> Column:
    """A bounded table as one literal."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


_TRAITS = "struct<i: int, line: array<string>, block: array<struct<a: string, b: string>>, plain: array<string>, special: array<struct<k: string, n: int>>, symbols: boolean>"


def traits(language: Language) -> dict:
    """What scores a language: comment tokens, whole-word keywords (lower case), other keywords with their bytes."""
    symbols = bool(language.keywords) and not language.line_comments and not language.block_comments and not any(re.search("[A-Za-z0-9_]", k) for k in language.keywords)
    return {
        "i": language.idx,
        "line": list(language.line_comments),
        "block": [{"a": a, "b": b} for a, b in language.block_comments],
        "plain": [k.lower() for k in language.keywords if _WORD.fullmatch(k)],
        "special": [{"k": k, "n": len(k.encode())} for k in language.keywords if not _WORD.fullmatch(k)],
        "symbols": symbols,
    }


def _word_count(text: Column, word: Column) -> Column:
    """How often a word of ASCII letters, digits and underscores stands in a text by itself; ASCII case does not count."""
    return F.regexp_count(text, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), word, F.lit("(?![A-Za-z0-9_])")))


def _score(text: Column, c: Column) -> Column:
    comments = F.size(F.filter(c["line"], lambda t: F.contains(text, t))) + F.size(F.filter(c["block"], lambda b: F.contains(text, b["a"]) & F.contains(text, b["b"])))
    plain = F.aggregate(c["plain"], F.lit(0), lambda n, k: n + _word_count(text, k))

    def occurs(k: Column) -> Column:
        return ((F.length(text) - F.length(F.replace(text, k["k"], F.lit("")))) / F.length(k["k"])).cast("int")

    special = F.aggregate(c["special"], F.lit(0), lambda n, k: n + occurs(k))
    matched = F.aggregate(c["special"], F.lit(0), lambda n, k: n + occurs(k) * k["n"])
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    thin = c["symbols"] & text.rlike("[A-Za-z0-9_]") & (solid > 0) & (matched * 2 < solid)
    return F.when(thin, 0).otherwise(comments * COMMENT_SCORE + (plain + special) * KEYWORD_SCORE)


def score(text: Column, language: Language) -> Column:
    """How well a text fits one language: comment tokens that occur and keywords by their number."""
    return once(text, lambda t: _score(t, _constant(traits(language), _TRAITS)))


def best_candidate(text: Column, found: Column, languages: list[Language]) -> Column:
    """Of the numbers in `found`, the one of the best score above 0, of equal ones the last; null if there is none.

    The catalog is one literal that candidates are looked up in, so a row costs as many scores as it has candidates.
    """
    known = _constant([traits(x) for x in languages], f"array<{_TRAITS}>")
    scored = F.transform(found, lambda i: F.struct(_score(text, F.get(known, i)).alias("score"), i.alias("i")))
    return F.array_max(F.filter(scored, lambda s: s["score"] > 0))["i"]


def disambiguate(files: DataFrame, languages: list[Language], key: str = "rel_path", text: str = "sample_text", found: str = "found") -> DataFrame:
    """key, lang_idx of files of several candidates, without a shuffle."""
    return files.select(key, best_candidate(F.col(text), F.col(found), languages).alias("lang_idx")).where(F.col("lang_idx").isNotNull())
