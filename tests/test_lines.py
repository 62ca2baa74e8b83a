"""Line classification, in the worker and as a native fold."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import content as C
from loomline.operators import lines
from loomline.sources import catalog

BY_NAME = {x.name: x for x in catalog.builtin()}

CASES = [
    ("C", "// see /* here\nstill\n*/ x\n", "code comment code"),
    ("C", 's = "/*";\nin\n', "code comment"),
    ("C", "/* a */ // b", "comment"),
    ("C", "/* a */ x\nx /* a */", "code code"),
    ("C", "/*\nend */ x; /* more\nin", "comment code comment"),
    ("C", "/* /* */ */", "code"),
    ("C", "x // y\n// z\n\n \t\r\n", "code comment blank blank"),
    ("Java", "/**/\nx\n", "comment comment"),
    ("Java", "/**//\n", "comment"),
    ("Rust", "/**/\nx", "comment code"),
    ("Rust", "/* /* */ */\nx", "comment code"),
    ("Rust", "/* /* */\nx\n*/\ny", "comment comment comment code"),
    ("Python", '"""doc"""\n# c\nx = 1  # c\n"""\n\nin\n"""\ny', "comment comment code comment blank comment comment code"),
    ("Python", "#! /usr/bin/env python3\n#!/usr/bin/python\n", "shebang comment"),
    ("Batch", "rem x\nREM x\nremember\n", "comment code code"),
    ("C", "a\rb", "code"),
    ("C", "a\n", "code"),
    ("C", "", ""),
    ("HTML", "<!-- a --> <!-- b -->\n<p><!-- c -->\n<!--\n\n-->\n<b>", "comment code comment blank comment code"),
    ("Forth", "( a ) \\ b\n: x ;\n( a )\n", "comment code comment"),
]


@pytest.mark.parametrize("name,text,want", CASES)
def test_kinds(name, text, want):
    counter = lines.LineCounter(BY_NAME[name])
    assert " ".join(counter.kinds(text)) == want
    kinds = want.split()
    assert counter.count(text) == (len(kinds), *(kinds.count(k) for k in lines.KINDS))


@pytest.mark.parametrize("name", ["C", "Java", "Python", "HTML", "Lua", "Fortran", "Batch", "JavaScript", "Markdown", "JSON", "Algol 68"])
def test_native_fold_agrees(spark, name):
    language, rnd = BY_NAME[name], random.Random(name)
    tokens = [*language.line_comments, *(t for p in language.block_comments for t in p), *language.shebangs[:1], "x", " ", "\t", "y = 1", "a_b", "\r"]
    rows = [("\n".join("".join(rnd.choice(tokens) for _ in range(rnd.randrange(6))) for _ in range(rnd.randrange(7))),) for _ in range(300)]
    counter = lines.LineCounter(language)
    got = spark.createDataFrame(rows, "t string").select("t", lines.classify(C.lines(F.col("t")), language).alias("k")).collect()
    for r in got:
        assert list(r.k) == list(counter.kinds(r.t)), repr(r.t)


def test_nesting_is_refused():
    with pytest.raises(ValueError):
        lines.classify(F.lit(None), BY_NAME["Rust"])
