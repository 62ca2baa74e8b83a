"""Files that carry their own counts in a comment: `expect: total=N code=N comment=N blank=N shebang=N`.

Those below cover each kind of comment syntax; a folder of more such files, in folders of any depth, is checked where
LOOMLINE_GOLDEN names one.
"""

import os
import re
from pathlib import Path

import pytest

from loomline.operators import worker
from loomline.sources import catalog

ANALYSER = worker.Analyser(catalog.builtin())
_EXPECT = re.compile(r"expect: total=(\d+) code=(\d+) comment=(\d+) blank=(\d+) shebang=(\d+)")

CASES = {
    "script.py": "#!/usr/bin/env python3\n# expect: total=5 code=1 comment=2 blank=1 shebang=1\n\nx = 1  # one\n# end\n",
    "noending": "#!/bin/bash\n# expect: total=3 code=1 comment=1 blank=0 shebang=1\necho '# no'\n",
    "no_newline.sh": "# expect: total=2 code=1 comment=1 blank=0 shebang=0\necho 1",
    "a.rs": "// expect: total=7 code=2 comment=4 blank=1 shebang=0\n/* a /* nested */\nstill a comment */\n\nfn f() {} // c\n/* x */ let y = 1;\n/**/\n",
    "b.js": "// expect: total=5 code=2 comment=3 blank=0 shebang=0\n/* a /* not nested */\nx = 1; /* b\nb */ y = 2;\n/* c */ // d\n",
    "c.cpp": "// expect: total=4 code=1 comment=2 blank=1 shebang=0\n \t\r\nint x; /* c */ // d\n/* e */\n",
    "style.css": "/* expect: total=4 code=2 comment=1 blank=1 shebang=0 */\na { b: c; }\n\nd { } /* e */\n",
    "page.html": "<!-- expect: total=4 code=2 comment=2 blank=0 shebang=0 -->\n<p>a</p>\n<!-- b -->\n<!-- c --><p>d</p>\n",
    "q.sql": "-- expect: total=4 code=1 comment=3 blank=0 shebang=0\n/* a\nb */\nSELECT 1; -- c\n",
    "f.hs": "-- expect: total=5 code=2 comment=3 blank=0 shebang=0\n{- a {- b -}\nc -}\nmain = x -- y\nz = w {- v -}\n",
    "m.lua": "-- expect: total=4 code=1 comment=2 blank=1 shebang=0\n--[[ a ]]\n\nx = 1\n",
    "t.tex": "% expect: total=3 code=1 comment=1 blank=1 shebang=0\n\n\\section{a} % b\n",
    "l.lisp": "; expect: total=3 code=1 comment=2 blank=0 shebang=0\n(a) ; b\n#| c |#\n",
    "n.nim": "# expect: total=3 code=1 comment=2 blank=0 shebang=0\n#[ a ]#\necho 1\n",
    "r.rb": "# expect: total=5 code=1 comment=3 blank=1 shebang=0\n=begin\n\n=end\nputs 1\n",
    "o.ml": "(* expect: total=3 code=1 comment=2 blank=0 shebang=0 *)\n(* a (* b *) c *)\nlet x = 1\n",
    "k.kt": "// expect: total=3 code=1 comment=2 blank=0 shebang=0\n/* a /* b */ c */\nval x = 1\n",
    "e.erl": "% expect: total=2 code=1 comment=1 blank=0 shebang=0\n-module(a).\n",
    "v.vim": '" expect: total=2 code=1 comment=1 blank=0 shebang=0\nset number\n',
    "Makefile": "# expect: total=3 code=2 comment=1 blank=0 shebang=0\nall:\n\techo # a\n",
    "Dockerfile": "# expect: total=2 code=1 comment=1 blank=0 shebang=0\nFROM scratch\n",
    "b.bat": "rem expect: total=4 code=2 comment=2 blank=0 shebang=0\nremote = 1\n:: a\necho b\n",
    "w.f90": "! expect: total=2 code=1 comment=1 blank=0 shebang=0\nprogram a ! b\n",
    "g.go": "// expect: total=4 code=2 comment=2 blank=0 shebang=0\npackage a\n/* b */\nvar c = 1 /* d */\n",
    "wide.py": "﻿# expect: total=2 code=1 comment=1 blank=0 shebang=0\nx = 1\n",
}


def counts(name, content):
    found = ANALYSER.file(name, content)
    assert found, f"{name} has no language"
    return found[1]


def wanted(text):
    total, code, comment, blank, shebang = map(int, _EXPECT.search(text).groups())
    return total, code, comment, blank, shebang


@pytest.mark.parametrize("name", CASES)
def test_golden(name):
    assert counts(name, CASES[name].encode()) == wanted(CASES[name])


@pytest.mark.parametrize("codec", ["utf-16-le", "utf-16-be"])
def test_golden_in_utf_16(codec):
    for name in ("script.py", "a.rs", "q.sql"):
        assert counts(name, ("﻿" + CASES[name]).encode(codec)) == wanted(CASES[name])


@pytest.mark.skipif("LOOMLINE_GOLDEN" not in os.environ, reason="no folder of golden files is named")
def test_golden_folder():
    seen = 0
    for path in sorted(Path(os.environ["LOOMLINE_GOLDEN"]).rglob("*")):
        if path.is_file() and (m := _EXPECT.search(path.read_text("utf-8", "replace"))):
            seen += 1
            assert counts(path.name, path.read_bytes()) == tuple(map(int, m.groups())), path
    assert seen
