"""Column expressions that render numbers, sizes, percentages and fields; ties round to even throughout."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class NumberStyle(StrEnum):
    PLAIN = "plain"
    COMMA = "comma"
    UNDERSCORE = "underscore"
    SPACE = "space"


class SizeUnits(StrEnum):
    BINARY = "binary"
    DECIMAL = "decimal"


SEPARATORS = {NumberStyle.PLAIN: "", NumberStyle.COMMA: ",", NumberStyle.UNDERSCORE: "_", NumberStyle.SPACE: " "}
UNITS = {SizeUnits.BINARY: (1024, ("B", "KiB", "MiB", "GiB", "TiB", "PiB")), SizeUnits.DECIMAL: (1000, ("B", "KB", "MB", "GB", "TB", "PB"))}


def number(n: Column, style: NumberStyle | str = NumberStyle.PLAIN) -> Column:
    if (style := NumberStyle(style)) is NumberStyle.PLAIN:
        return n.cast("string")
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(SEPARATORS[style]))


def fixed(x: Column, places: int) -> Column:
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def percent(x: Column, precision: int = 1) -> Column:
    return fixed(x, min(6, max(0, precision)))


def size(n: Column, units: SizeUnits | str = SizeUnits.BINARY, style: NumberStyle | str = NumberStyle.PLAIN) -> Column:
    """Bytes as they are; larger units with three significant digits or so."""
    base, names = UNITS[SizeUnits(units)]
    out = F.concat(number(n, style), F.lit(" B"))
    for power, name in enumerate(names[1:], 1):
        x = n.cast("double") / float(base**power)
        shown = F.when(x < 10, fixed(x, 2)).when(x < 100, fixed(x, 1)).otherwise(fixed(x, 0))
        out = F.when(n >= base**power, F.concat(shown, F.lit(f" {name}"))).otherwise(out)
    return out


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * 100.0)


def average(total: Column, count: Column) -> Column:
    return F.when(count == 0, F.lit(0.0)).otherwise(total.cast("double") / count.cast("double"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def join_list(parts: Column) -> Column:
    """a; a and b; a, b, and c; null for none."""
    n = F.size(parts)
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(n <= 2, F.array_join(parts, " and "))
        .otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.try_element_at(parts, F.lit(-1))))
    )


def csv_field(s: Column) -> Column:
    return F.when(s.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def tsv_field(s: Column) -> Column:
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    return s


def markdown_field(s: Column) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def html_field(s: Column) -> Column:
    for raw, shown in (("&", "&#38;"), ("<", "&#60;"), (">", "&#62;"), ('"', "&#34;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    return s


#: (kind, one, many, title)
LINE_KINDS = (("code", "code", "code", "Code"), ("comment", "comment", "comments", "Comments"), ("blank", "blank", "blanks", "Blanks"), ("shebang", "shebang", "shebangs", "Shebangs"))
