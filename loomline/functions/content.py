"""Column expressions over file contents: samples, encodings, the binary test, decoding, lines and words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE = 4096
#: The white space that is trimmed from lines: ASCII only.
WHITE = " \t\n\r\x0b\x0c"
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def sample(content: Column) -> Column:
    """The first 4096 bytes and, of longer contents, as many from the middle at an even offset."""
    size = F.octet_length(content)
    middle = F.shiftleft(F.shiftright((size - SAMPLE).cast("int"), 2), 1)  # half, rounded down to even
    return F.when(size <= SAMPLE, content).otherwise(F.concat(F.substring(content, 1, SAMPLE), F.substring(content, middle + 1, SAMPLE)))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once a row, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _zeros_at_even(chars: Column) -> Column:
    """Zero bytes at even offsets, of bytes as ISO-8859-1: runs of pairs that begin with one are taken out, with half a pair at the end."""
    return F.ceil((F.length(chars) - F.length(F.regexp_replace(chars, r"(?s)\G((?:[^\x00].)*+)(?:\x00.?)++", "$1"))) / 2)


def encoding(sampled: Column) -> Column:
    """STRUCT<encoding, bom_len> from a byte order mark or, without one, from where zero bytes lie."""

    def of(name: str, mark: int) -> Column:
        return F.struct(F.lit(name).alias("encoding"), F.lit(mark).alias("bom_len"))

    def by_zeros(chars: Column) -> Column:
        size = F.length(chars)

        def by_place(zeros: Column, even: Column) -> Column:
            return F.when(zeros - even >= 2 * even, of("UTF-16LE", 0)).when(even >= 2 * (zeros - even), of("UTF-16BE", 0)).otherwise(of("UTF-8", 0))

        def likely(zeros: Column) -> Column:
            return F.when((size >= 4) & (zeros >= F.floor(size / 4)), once(_zeros_at_even(chars), lambda even: by_place(zeros, even))).otherwise(of("UTF-8", 0))

        return once(size - F.length(F.replace(chars, F.lit("\0"), F.lit(""))), likely)

    def by_mark(content: Column) -> Column:
        head = F.hex(F.substring(content, 1, 3))
        return (
            F.when(head == "EFBBBF", of("UTF-8", 3)).when(head.startswith("FFFE"), of("UTF-16LE", 2)).when(head.startswith("FEFF"), of("UTF-16BE", 2))
            .otherwise(once(F.decode(content, "ISO-8859-1"), by_zeros))
        )

    return once(sampled, by_mark)


def is_utf16(name: Column) -> Column:
    return name.isin("UTF-16LE", "UTF-16BE")


def is_binary(sampled: Column, name: Column) -> Column:
    """Any zero byte, or over a fifth of control bytes; never for UTF-16 or empty samples."""
    bytes_ = F.decode(sampled, "ISO-8859-1")
    size = F.octet_length(sampled)
    many = F.floor(F.regexp_count(bytes_, F.lit(_CONTROL)) * 100 / size) > 20
    return (size > 0) & ~is_utf16(name) & ((F.instr(bytes_, "\0") > 0) | many)


def _utf16(body: Column, little: bool) -> Column:
    """Decoded UTF-16; surrogates without their partner and an odd byte at the end become U+FFFD."""
    unit, high, low = (("." + c if little else c + ".") for c in (r"[^\xD8-\xDF]", r"[\xD8-\xDB]", r"[\xDC-\xDF]"))
    valid = rf"(?s)^(?:{unit}|{high}{low})*+\z"  # possessive: a loop, whatever the length

    def decoded(b: Column) -> Column:
        return F.when(F.decode(b, "ISO-8859-1").rlike(valid), F.decode(b, "UTF-16LE" if little else "UTF-16BE")).otherwise(_mended_utf16(b, little))

    return once(body, decoded)


def _mended_utf16(body: Column, little: bool) -> Column:
    """As _utf16, for what is not valid."""
    codec, size = "UTF-16LE" if little else "UTF-16BE", F.octet_length(body)
    even = F.substring(body, 1, size - size % 2)
    digits = F.hex(even)
    units = F.regexp_extract_all(digits, F.lit("(....)"), F.lit(1))

    def among(unit: Column, first: str, last: str) -> Column:
        return F.coalesce(F.substring(unit, 3 if little else 1, 2).between(first, last), F.lit(False))

    def mended(unit: Column, i: Column) -> Column:
        high, low = among(unit, "D8", "DB"), among(unit, "DC", "DF")
        alone = high & ~among(F.get(units, i + 1), "DC", "DF") | low & ~among(F.get(units, i - 1), "D8", "DB")
        return F.when(alone, "FDFF" if little else "FFFD").otherwise(unit)

    surrogates = digits.rlike("^(?:....)*?" + ("..D[89A-F]" if little else "D[89A-F].."))  # only then every unit is looked at
    whole = F.when(surrogates, F.unhex(F.array_join(F.transform(units, mended), ""))).otherwise(even)
    broken = (size % 2 == 1) & ~among(F.substring(digits, -4, 4), "D8", "DB")  # after a first surrogate the odd byte falls to its U+FFFD
    return F.concat(F.decode(whole, codec), F.when(broken, "\ufffd").otherwise(""))


def text(content: Column, name: Column, bom_len: Column) -> Column:
    """Contents without the mark, decoded; what is not valid becomes U+FFFD."""
    body = F.substring(content, bom_len + 1, F.octet_length(content))
    return F.when(name == "UTF-16LE", _utf16(body, True)).when(name == "UTF-16BE", _utf16(body, False)).otherwise(F.make_valid_utf8(body.cast("string")))


def lines(decoded: Column) -> Column:
    """Split at line feeds only; a last line without one counts, an empty text has none."""
    parts = F.split(decoded, "\n")
    return F.when(F.length(decoded) == 0, F.array().cast("array<string>")).when(decoded.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trim(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def has_text(part: Column) -> Column:
    return part.rlike(r"[^ \t\n\r\x0B\x0C]")


def words(decoded: Column) -> Column:
    """Runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(decoded, "[^A-Za-z0-9_]+"), lambda w: w != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory_key(path: Column, root: str = "") -> Column:
    """The first component of a path of several, else (root); a path that begins with root's own name loses it first."""
    if root:
        path = F.when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)
    return F.when(F.instr(path, "/") > 0, F.split(path, "/")[0]).otherwise(F.lit("(root)"))


def is_hidden(path: Column) -> Column:
    """Some component of the path begins with a dot."""
    return F.exists(F.split(path, "/"), lambda c: c.startswith("."))


def depth(path: Column) -> Column:
    """Components of a path below the root, which has depth 0."""
    return F.size(F.split(path, "/"))


def matches_glob(path: Column, globs: list[str]) -> Column:
    """Some exclude glob matches the path; one without a slash matches names at any depth."""
    from ..sources.ignore import glob_regex

    found = F.lit(False)
    for g in (g.lstrip("!").rstrip("/") for g in globs):
        found = found | path.rlike(("^(?:.*/)?" if "/" not in g else "^") + glob_regex(g.lstrip("/")) + "(?:/.*)?$")
    return found
