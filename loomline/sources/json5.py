"""A reader for the JSON5 that language catalogs are written in: comments, bare keys, single quotes, trailing commas."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<mark>[{}\[\]:,])|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<bare>[^\s{}\[\]:,"'/]+)""",
    re.DOTALL,
)
_NAMES = {"true": True, "false": False, "null": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def _string(raw: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        return chr(int(code[1:], 16)) if code[0] in "ux" and len(code) > 1 else _ESCAPES.get(code, "" if code == "\n" else code)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, raw[1:-1], flags=re.DOTALL)


def loads(text: str) -> object:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not JSON5 at character {at}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    value, rest = _value(tokens, 0)
    if rest != len(tokens):
        raise ValueError("more than one value")
    return value


def _value(tokens: list[tuple[str, str]], i: int) -> tuple[object, int]:
    if i >= len(tokens):
        raise ValueError("the text breaks off")
    kind, word = tokens[i]
    if kind == "str":
        return _string(word), i + 1
    if kind == "bare":
        return (_NAMES[word] if word in _NAMES else json.loads(word)), i + 1
    if word not in "{[":
        raise ValueError(f"a value was expected, not {word}")
    close, items, i = "}" if word == "{" else "]", [], i + 1
    while i < len(tokens) and tokens[i][1] != close:
        key = None
        if close == "}":
            kind, key = tokens[i]
            key = _string(key) if kind == "str" else key
            if tokens[i + 1 : i + 2] != [("mark", ":")]:
                raise ValueError(f"no colon after {key}")
            i += 2
        item, i = _value(tokens, i)
        items.append((key, item))
        if i < len(tokens) and tokens[i] == ("mark", ","):
            i += 1
        elif i >= len(tokens) or tokens[i][1] != close:
            raise ValueError("a comma or the end was expected")
    if i >= len(tokens):
        raise ValueError("the text breaks off")
    return (dict(items) if close == "}" else [v for _, v in items]), i + 1
