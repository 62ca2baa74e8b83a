"""Sources, detection, grouping, reports and settings."""

import json
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from loomline import cli, config, report, web
from loomline.functions import content as C
from loomline.functions import formats as M
from loomline.operators import aggregate, detect, worker
from loomline.plans.analysis import file_stats
from loomline.sources import catalog, files, ignore, json5

LANGUAGES = catalog.builtin()
INDEX = {x.name: x.idx for x in LANGUAGES}
ANALYSER = worker.Analyser(LANGUAGES)


def test_catalog_is_valid_and_indexed():
    assert [x.idx for x in catalog.validate(LANGUAGES)] == list(range(len(LANGUAGES)))


def test_catalog_is_whole():
    """The counts of SURVEY 1.4."""
    patterns = [p for x in LANGUAGES for p in x.file_patterns]
    distinct = {p.lower() for p in patterns}
    assert (len(LANGUAGES), len(patterns), len(distinct), sum("*" not in p for p in distinct)) == (544, 1131, 1077, 128)
    assert [sum(map(bool, (getattr(x, f) for x in LANGUAGES))) for f in ("line_comments", "block_comments", "nested", "keywords", "shebangs")] == [474, 357, 53, 84, 35]
    assert sum(len(x.keywords) for x in LANGUAGES) == 587 and len({(x.line_comments, x.block_comments, x.nested) for x in LANGUAGES}) == 132
    assert sum(not x.line_comments and not x.block_comments for x in LANGUAGES) == 16


@pytest.mark.parametrize("name,language", [("a.pp", "Puppet"), ("a.p", "OpenEdge ABL"), ("a.inc", "BitBake"), ("a.sc", "SuperCollider"), ("a.st", "Structured Text"), ("a.cob", "COBOL"), ("a.hlsl", "HLSL"), ("a.prisma", "Prisma"), ("a.jsp", "Java Server Pages"), ("a.pug", "Pug")])
def test_less_common_languages_are_candidates(name, language):
    assert language in [LANGUAGES[i].name for i in ANALYSER.candidates(name)]


@pytest.mark.parametrize("text", ['{B: {file_patterns: ["*.b"]}, A: {file_patterns: ["*.a"]}}', "{A: {}}", '{A: {file_patterns: [" *.a"]}}', '{A: {file_patterns: ["*.a"], x: 1}}', '{A: {file_patterns: ["*.a"], keywords: ["k"]}, B: {file_patterns: ["*.a"]}}', '{A: {file_patterns: ["*.a"], line_comments: [""]}}'])
def test_bad_catalogs(tmp_path, text):
    (tmp_path / "c.json5").write_text(text)
    with pytest.raises(catalog.CatalogError):
        catalog.read(tmp_path / "c.json5")


def test_json5():
    assert json5.loads("{a: [1, 'x\\n', true,], // c\n \"b\": {/* d */},}") == {"a": [1, "x\n", True], "b": {}}
    for bad in ("{a 1}", "[1 2]", "[", "{} {}"):
        with pytest.raises(ValueError):
            json5.loads(bad)


@pytest.mark.parametrize("name,want", [("a.py", ["Python"]), ("A.PY", ["Python"]), ("Makefile", ["Makefile"]), ("x.m", ["Limbo", "MATLAB", "Mercury", "Miranda", "MUMPS", "Objective-C", "Octave"]), ("x", []), ("x.rs.in", ["Rust"])])
def test_candidates(spark, name, want):
    assert [LANGUAGES[i].name for i in ANALYSER.candidates(name)] == want
    frame = spark.createDataFrame([("p", name)], "rel_path string, name string")
    assert sorted(r.lang_idx for r in detect.candidates(frame, LANGUAGES).collect()) == [INDEX[w] for w in want]
    assert list(detect.candidate_lists(frame, LANGUAGES).first().found) == [INDEX[w] for w in want]


def test_detection():
    def lang(name, text):
        got = ANALYSER.file(name, text.encode())
        return got and LANGUAGES[got[0]].name

    assert lang("a.m", "#import <x.h>\n@interface A : NSObject\n@end // x\n") == "Objective-C"
    assert lang("a.c", "// a\n/* b */\n") == "LPC"  # alike: the last of the catalog
    assert lang("a.b", "this is prose, with some text.") != "Brainfuck"
    assert lang("a.bf", "anything") == "Brainfuck"
    assert lang("script", "#!/usr/bin/env python3\nx") == "Python"
    assert lang("script", "x") is None and lang("a.c", "") is None
    assert ANALYSER.file("a.py", b"") == (INDEX["Python"], (0,) * 5)
    assert ANALYSER.file("a.py", b"a\0b") is None


def test_scores_agree(spark):
    texts = ["#include <a>\nint main() {}\nvoid f(); // x", "inherit a; mapping m;", "/* */ @interface", "", "><+-.,[]", "a ><+ bcdef ghijk"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("C", "LPC", "Objective-C", "Brainfuck"):
        got = {r.t: r.s for r in rows.select("t", detect.score(F.col("t"), LANGUAGES[INDEX[name]]).alias("s")).collect()}
        for t in texts:
            assert got[t] == ANALYSER.score(t, [w.lower() for w in worker._WORDS.findall(t)], INDEX[name])


CONTENTS = [b"", b"abc", b"\xc3(ab", b"\0abc", b"\x01\x02\x03abcdefg", b"\x01" + b"a" * 9, b"\xef\xbb\xbfx", b"\xff\xfea\0", b"\xfe\xff\0a", "abcd".encode("utf-16-le"), "abcd".encode("utf-16-be"), b"a" * 5000, bytes(range(256)) * 60, b"\0\0\0\0", b"x" * 4097]


def test_native_content_agrees(spark):
    rows = spark.createDataFrame([(bytearray(c),) for c in CONTENTS], "c binary")
    s = C.sample(F.col("c"))
    got = rows.select("c", s.alias("s"), C.encoding(s).alias("e")).select("c", "s", "e", C.is_binary(F.col("s"), F.col("e.encoding")).alias("b")).collect()
    for r in got:
        sampled = worker.sample(bytes(r.c))
        assert bytes(r.s) == sampled
        assert (r.e.encoding, r.e.bom_len) == worker.encoding(sampled)
        assert r.b == worker.is_binary(sampled, r.e.encoding)


@pytest.mark.parametrize("codec", ["UTF-16LE", "UTF-16BE"])
def test_native_utf_16_takes_anything(spark, codec):
    """Lone surrogates in any order and odd ends, against Python's decoder."""
    rnd, order = random.Random(7), "little" if codec == "UTF-16LE" else "big"
    drawn = [b"", b"a", b"\xd8\x00\xdc"]
    for _ in range(300):
        units = [rnd.choice([0x41, 0xD800, 0xDBFF, 0xDC00, 0xDFFF, 0x20AC, 0xFFFD, 0xD7FF, 0xE000]) for _ in range(rnd.randrange(9))]
        drawn.append(b"".join(u.to_bytes(2, order) for u in units) + (b"\x41" if rnd.random() < 0.3 else b""))
    rows = spark.createDataFrame([(bytearray(d),) for d in drawn], "c binary")
    for r in rows.select("c", C.text(F.col("c"), F.lit(codec), F.lit(0)).alias("t")).collect():
        assert r.t == bytes(r.c).decode(codec, "replace"), bytes(r.c)


def test_native_encoding_of_random_bytes_agrees(spark):
    rnd = random.Random(17)
    drawn = [bytes(rnd.choices(b"\0A\n\xff\xfe\xef\xbb\xbf\xd8", weights=[rnd.choice([1, 9]), 6, 1, 1, 1, 1, 1, 1, 1], k=rnd.randrange(24))) for _ in range(1500)]
    drawn += [bytes(x for pair in zip(a, b) for x in pair) + t for a, b in ((b"\0" * 9, b"abcdefg\0\0"), (b"a\0cdefghi", b"\0" * 9)) for t in (b"", b"\0", b"z")]
    rows = spark.createDataFrame([(bytearray(d),) for d in drawn], "c binary")
    for r in rows.select("c", C.encoding(F.col("c")).alias("e")).collect():
        assert (r.e.encoding, r.e.bom_len) == worker.encoding(bytes(r.c)), bytes(r.c)


def test_words_of_scores_agree(spark):
    """Keywords count as whole words of ASCII characters, in any ASCII case, wherever they stand."""
    rnd, x = random.Random(19), catalog.Language(0, "X", ("*.x",), ("#",), keywords=("the", "and_1", "K", "##"))
    drawn = ["".join(rnd.choice(["the", "The", "THE", "and_1", "k", "K", "\u212a", "\u017f", "\u00e9", "_", "1", " ", "\n", "-", "##", "."]) for _ in range(rnd.randrange(12))) for _ in range(800)]
    judge = worker.Analyser([x])
    for r in spark.createDataFrame([(t,) for t in drawn], "t string").select("t", detect.score(F.col("t"), x).alias("s")).collect():
        assert r.s == judge.score(r.t, [w.lower() for w in worker._WORDS.findall(r.t)], 0), r.t


@pytest.mark.parametrize("name", ["c3_c4_encoding", "a7_c5_decode", "c17_scores"])
def test_time_of_long_texts(spark, tmp_path, name):
    """Over 12 million characters, or four times as many; with some steps for each byte or word it takes several times as long. Rows against plain code."""
    import hashlib
    import time

    from loomline import queries

    made = "substring(repeat(concat('The cat and the dog of ', id % 6, ' ', repeat('é', int(id % 3)), ' # '), 1000), 1, 25000)"
    texts = [(f"The cat and the dog of {k} {'é' * (k % 3)} # " * 1000)[:25000] for k in range(6)]
    words = [re.findall("[a-z0-9_]+", t.lower()) for t in texts]
    marks = [("UTF-8", 3), ("UTF-16LE", 2), ("UTF-16BE", 2), ("UTF-16LE", 0), ("UTF-16BE", 0), ("UTF-8", 0)]
    want = {
        "c3_c4_encoding": marks,
        "a7_c5_decode": [(hashlib.md5(t.encode()).hexdigest(),) for t in texts],
        "c17_scores": [(50 + 10 * (w.count("the") + w.count("and")),) for w in words],
    }[name]
    for n in (6, 1920 if name == "c17_scores" else 480):  # the first starts workers and compiles
        spark.range(n).selectExpr("id AS doc_id", f"{made} AS text").write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        began = time.monotonic()
        got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES[name](spark, str(tmp_path / f"{n}")).collect()}
        took = time.monotonic() - began
        assert got == {k: want[k % 6] for k in range(n)}
    assert took < 6


def test_formats(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    for n, want in ((512, "512 B"), (1023, "1023 B"), (1024, "1.00 KiB"), (10240, "10.0 KiB"), (102400, "100 KiB"), (1536, "1.50 KiB"), (1 << 60, "1024 PiB")):
        assert show(M.size(F.lit(n))) == want == report.View().size(n)
    assert show(M.size(F.lit(1500), "decimal")) == "1.50 KB"
    assert [show(M.number(F.lit(1234567), s)) for s in M.NumberStyle] == ["1234567", "1,234,567", "1_234_567", "1 234 567"]
    for x, p, want in ((50.0, 2, "50.00"), (0.25, 1, "0.2"), (2.5, 0, "2"), (1234.5, 1, "1234.5")):
        assert show(M.percent(F.lit(x), p)) == want == report.View(precision=p).percent(x)
    for parts, want in ((["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")):
        assert show(M.join_list(F.array(*map(F.lit, parts)))) == want == report.listed(parts)
    assert show(M.csv_field(F.lit('a"b'))) == '"a""b"' and show(M.tsv_field(F.lit("a\t\\"))) == "a\\t\\\\"
    assert show(C.directory_key(F.lit("src/a.rs"), "src")) == "(root)"
    assert show(M.percentage(F.lit(10), F.lit(0))) == 0.0


def test_sizes_beyond_a_long(spark, tmp_path):
    """c24_size_human over keys whose product is beyond 64 bits, which its SQL cannot hold: shown from whole numbers of Python."""
    from loomline import queries

    keys = [(1, 1), (2097151, 2097151), (2097152, 2097152), (8999999, 899999), (0, 5), (3037000500, 1), (7, 20897), (10, 10)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries.QUERIES["c24_size_human"](spark, str(tmp_path)).collect()
    want = [(o, report.View().size(o * o * c), report.View(size_units=M.SizeUnits.DECIMAL).size(o * o * c)) for o, c in keys]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["b8_include_languages", "b9_exclude_languages", "c37_summary_metrics", "e1_file_stats", "e2_by_language", "e2e3_rollup", "e3_totals", "e4_by_directory", "e5_merge", "e6_file_lists", "f1_sort_files_desc", "g1_human", "g1_human_by_directory", "g2_f4_quiet", "g3_json", "g5_csv"])
def test_counts_of_tables_with_empty_texts(spark, tmp_path, name):
    """A text without lines is no file of the SQL's counts; the registered SQL is run over the same tables."""
    import duckdb

    from loomline import queries

    docs = [(k, t, "en", f"src{k % 3}") for k, t in enumerate(["a\nb\n", "", None, " ", "\n", "", "x", "", "c\n\nd"])] + [(20, "", "en", "only_empty")]
    pages = [(k, f"https://h{k % 2}/p", t) for k, t in enumerate(["<p>\n</p>", "", None, "<!-- c -->\n"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_sums_saturate(spark):
    big = aggregate.LIMIT
    rows = spark.createDataFrame([("p", "X", big, 1, 0, 0, 0, 1), ("q", "X", big, 1, 0, 0, 0, 1)], "rel_path string, lang string, total_lines long, code_lines long, comment_lines long, blank_lines long, shebang_lines long, size long")
    assert aggregate.by_language(rows).first().lines == big


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {
        "a.py": "# c\nx = 1\n", "__init__.py": "", "src/b.rs": "// c\nfn main() {}\n\n", "src/deep/c.js": "x\n", "skip.log": "x", ".hidden.py": "x\n", "out/gen.py": "x\n", "keep/out.py": "y\n",
        ".gitignore": "out/\n*.tmp\n!keep.tmp\n/only.py\n", "only.py": "x\n", "src/only.py": "x\n", "x.tmp": "", "package-lock.json": "{}", "app.min.js": "x", "data.bin": "\0\0", "src/.ignore": "deep\n", "plain": "text\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def names(root, **kw):
    return [x[1] for x in files.listing(root, files.Walk(**kw))]


def test_walk(tree):
    assert names(tree) == ["__init__.py", "a.py", "data.bin", "keep/out.py", "plain", "skip.log", "src/b.rs", "src/only.py"]
    assert "out/gen.py" in names(tree, respect_ignore=False) and "src/deep/c.js" in names(tree, respect_ignore=False)
    assert ".hidden.py" in names(tree, hidden=True)
    assert {"package-lock.json", "app.min.js"} <= set(names(tree, generated=True))
    assert names(tree, max_depth=1) == ["__init__.py", "a.py", "data.bin", "plain", "skip.log"]
    assert names(tree, exclude=("*.py", "!src")) == ["data.bin", "plain", "skip.log"]
    os.symlink(tree / "src", tree / "link")
    assert "link/b.rs" not in names(tree) and "link/b.rs" in names(tree, symlinks=True)
    assert [x[1] for x in files.listing(tree / "a.py")] == [""]
    with pytest.raises(FileNotFoundError):
        files.listing(tree / "none")


def test_ignore_rules():
    r = ignore.Rules(["*.log", "!keep.log", "a/b", "c/", "**/d", "e/**", "# no", "f[0-9].x", "g?", r"\#h"])
    said = {p: r.decide(p, False) for p in ("x.log", "z/keep.log", "a/b", "q/a/b", "c", "z/d", "e/f/g", "f1.x", "fa.x", "g1", "#h", "# no")}
    assert said == {"x.log": True, "z/keep.log": False, "a/b": True, "q/a/b": None, "c": None, "z/d": True, "e/f/g": True, "f1.x": True, "fa.x": None, "g1": True, "#h": True, "# no": None}
    assert r.decide("c", True)


def test_executors_list_what_the_driver_lists(spark, tree):
    os.symlink(tree / "src", tree / "src" / "loop")
    os.symlink(tree / "nothing", tree / "dead.py")
    (tree / "src" / "empty").mkdir()
    for kw in ({}, {"respect_ignore": False}, {"hidden": True, "symlinks": True}, {"max_depth": 1}, {"max_depth": 2, "generated": True}, {"exclude": ("src",)}):
        want = [(rel, size, bool(error)) for _, rel, size, error in files.listing(tree, files.Walk(**kw))]
        got = sorted((bytes(r.path).decode(), r.size, r.error is not None) for r in files.walk(spark, tree, files.Walk(**kw)).collect())
        assert got == want
    errors = {r.rel_path for r in files.read_tree(spark, tree, files.Walk(symlinks=True)).where("error IS NOT NULL").collect()}
    assert errors == {"src/loop", "dead.py"}
    assert [tuple(r) for r in files.read_tree(spark, tree / "a.py").select("rel_path", "name", "size").collect()] == [("", "a.py", 10)]
    with pytest.raises(FileNotFoundError):
        files.read_tree(spark, tree / "none")
    bad = os.fsencode(tree) + b"/bad\xff.py"
    open(bad, "w").close()
    assert "file.py" in {r.name for r in files.read_tree(spark, tree).collect()}  # a name that is no UTF-8 keeps its ending


def test_ignore_files_of_all_kinds(tmp_path):
    """Nearest of one kind first; .ignore before .gitignore before .git/info/exclude before the global file; parents count up to a repository's root."""
    def write(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    for name in ("a.log", "b.log", "c.log", "d.log", "e.log", "f.py"):
        write(f"top/repo/sub/{name}", "x")
    write("top/.gitignore", "f.py\nb.log\n")
    write("top/.ignore", "c.log\n")
    write("top/repo/sub/.gitignore", "a.log\n!b.log\n")
    write("top/repo/sub/.ignore", "!a.log\n")
    write("top/global", "d.log\ne.log\n")
    walk = lambda **kw: names_of(tmp_path / "top/repo/sub", **kw)

    def names_of(root, globally=None, **kw):
        return [x[1] for x in files.listing(root, files.Walk(**kw), globally)]

    assert walk() == ["a.log", "b.log", "d.log", "e.log"]
    assert walk(globally=str(tmp_path / "top/global")) == ["a.log", "b.log"]
    write("top/repo/.git/info/exclude", "e.log\n")
    assert walk() == ["a.log", "b.log", "d.log", "f.py"]  # .gitignore above the repository's root is out, .ignore is not
    assert walk(respect_ignore=False) == ["a.log", "b.log", "c.log", "d.log", "e.log", "f.py"]
    write("home/.config/git/ignore", "")
    home = str(tmp_path / "home")
    assert ignore.global_file({"HOME": home}) == f"{home}/.config/git/ignore"
    write("home/.gitconfig", "[user]\nexcludesfile = no\n[core]\n\texcludesFile = ~/mine  # note\n")
    assert ignore.global_file({"HOME": home}) == f"{home}/mine"
    assert ignore.global_file({"HOME": home, "XDG_CONFIG_HOME": "/x"}) == f"{home}/mine" and ignore.global_file({}) is None


def test_web_service(spark, tree, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for full, rel, _, _ in files.listing(tree):
            z.write(full, rel)
    running = web.server(spark, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def ask(where, body=None, kind="application/json"):
        request = urllib.request.Request(f"http://127.0.0.1:{running.server_port}{where}", body, {"content-type": kind})
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.status, answer.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())["error"]

    def form(content):
        return b'--XX\r\ncontent-disposition: form-data; name="file"; filename="a.zip"\r\n\r\n' + content + b"\r\n--XX--\r\n"

    try:
        assert ask("/health") == (200, "ok") and ask("/")[0] == 200 and ask("/none")[0] == 404 and ask("/api/none", b"{}")[0] == 404
        status, text = ask("/api/analyze/zip", form(path.read_bytes()), "multipart/form-data; boundary=XX")
        assert status == 200 and {x["name"]: x["files"] for x in json.loads(text)["languages"]} == {"Python": 4, "Rust": 1} and text.count("\n") == 1
        assert ask("/api/analyze/zip", form(b"no archive"), "multipart/form-data; boundary=XX")[0] == 400
        assert ask("/api/analyze/zip", b"x", "text/plain")[0] == 400 and ask("/api/analyze/zip", form(b"x")[:-12], "multipart/form-data; boundary=XX")[0] == 400
        assert ask("/api/analyze/git", b'{"url": "ssh://x/y"}')[0] == 400 and ask("/api/analyze/git", b"[]")[0] == 400 and ask("/api/analyze/git", b'{"url": 1}')[0] == 400
    finally:
        running.shutdown()


def test_git_source(spark, tmp_path, monkeypatch, capsys):
    """A repository served over HTTP by git's own backend, cloned, read and reported from the command line."""
    import subprocess
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    backend = os.path.join(subprocess.run(["git", "--exec-path"], capture_output=True, text=True, check=True).stdout.strip(), "git-http-backend")
    if not os.path.exists(backend):
        pytest.skip("git has no HTTP backend here")
    repo = tmp_path / "r.git"
    (repo / "sub").mkdir(parents=True)
    (repo / "sub" / "a.py").write_text("x = 1\n# two\n")
    git = ["git", "-c", "user.name=a", "-c", "user.email=a@b.c", "-C", str(repo)]
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "one"]):
        subprocess.run([*git, *args], check=True)

    class Backend(BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, query = self.path.partition("?")
            env = os.environ | {"GIT_PROJECT_ROOT": str(tmp_path), "GIT_HTTP_EXPORT_ALL": "1", "PATH_INFO": path, "QUERY_STRING": query, "REQUEST_METHOD": self.command, "CONTENT_TYPE": self.headers.get("content-type", ""), "HTTP_CONTENT_ENCODING": self.headers.get("content-encoding", ""), "GIT_PROTOCOL": self.headers.get("git-protocol", "")}
            body = self.rfile.read(int(self.headers.get("content-length", 0)))
            head, _, out = subprocess.run([backend], input=body, env=env, capture_output=True).stdout.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
            self.send_response(int(fields.pop("Status", "200").split()[0]))
            for k, v in fields.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(out)

        do_POST = do_GET

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Backend)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/r.git"
    try:
        assert [(r.rel_path, r.size) for r in files.read_git(spark, url).collect()] == [("sub/a.py", 12)]
        monkeypatch.chdir(tmp_path)
        assert cli.main([url, "-o", "csv"]) == 0
        assert "Python,1,2," in capsys.readouterr().out
        with pytest.raises(files.GitError):
            files.read_git(spark, url.replace("r.git", "none.git"))
    finally:
        server.shutdown()


def test_tree_to_counts(spark, tree):
    read = files.read_tree(spark, tree)
    got = {r.rel_path: (r.lang, r.total_lines, r.code_lines, r.comment_lines, r.blank_lines) for r in file_stats(read, LANGUAGES).collect()}
    assert got == {"a.py": ("Python", 2, 1, 1, 0), "__init__.py": ("Python", 0, 0, 0, 0), "src/b.rs": ("Rust", 3, 1, 1, 1), "src/only.py": ("Python", 1, 1, 0, 0), "keep/out.py": ("Python", 1, 1, 0, 0)}
    assert {r.lang for r in file_stats(read, LANGUAGES, include=["RUST"], exclude=["rust"]).collect()} == {"Rust"}
    assert {r.lang for r in file_stats(read, LANGUAGES, exclude=["rust"]).collect()} == {"Python"}


def test_zip(spark, tree, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for full, rel, _, _ in files.listing(tree):
            z.write(full, rel)
    assert sorted(r.rel_path for r in files.read_zip(spark, path).collect()) == names(tree)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("../evil.py", "x")
    with pytest.raises(files.ZipError):
        files.read_zip(spark, path)
    path.write_bytes(b"no archive")
    with pytest.raises(files.ZipError):
        files.read_zip(spark, path)
    with pytest.raises(ValueError):
        files.clone("ssh://x/y", tmp_path / "c")


@pytest.fixture
def stats(spark):
    rnd = random.Random(1)
    rows = [(f"{d}/{i}.x" if d else f"{i}.x", lang, 10 * i, 6 * i, 3 * i, i, 0, 100 * i) for i, (d, lang) in enumerate([("a", "Rust"), ("b", "Rust"), ("a", "Go"), ("", "C"), ("b|c", "Go"), ("a", "C")], 1)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "rel_path string, lang string, total_lines long, code_lines long, comment_lines long, blank_lines long, shebang_lines long, size long")


def test_order_and_cuts(stats):
    groups = aggregate.by_language(stats)
    order = lambda *a, **k: [r["name"] for r in aggregate.top(groups, *a, **k).collect()]
    assert order() == ["C", "Go", "Rust"] and order("files") == ["Rust", "Go", "C"] and order("files", False) == ["C", "Go", "Rust"]
    assert order("name", False) == ["C", "Go", "Rust"] and order(n=2) == ["C", "Go"] and order(n=2, min_lines=90) == ["C"]
    assert aggregate.hidden(groups, aggregate.top(groups, n=2, min_lines=90)).first().hidden == 2


def test_reports(stats):
    view = report.View(verbosity=report.Verbosity.VERBOSE, top_languages=2, by_dir=True, number_style=M.NumberStyle.COMMA)
    data = json.loads(report.render(stats, "root", view, "json"))
    assert [x["name"] for x in data["languages"]] == ["C", "Go"] and data["languages_hidden"] == 1 and data["dirs_hidden"] == 2
    assert data["summary"]["total_lines"] == 210 and data["summary"]["code_percentage"] == 126 / 210 * 100
    assert [f["path"] for f in data["languages"][0]["files_detail"]] == ["a/6.x", "4.x"]
    assert report.render(stats, "root", view, "json-compact").count("\n") == 1
    text = report.render(stats, "root", view)
    assert "Directory breakdown:\na:\n\tFiles: 3 files (50.0% of total)." in text and text.endswith("(2 directories not shown)\n")
    quiet = report.render(stats, "root", report.View(verbosity=report.Verbosity.SUMMARY, top_languages=1))
    assert quiet.endswith("Languages: 2 C files (33.3%).\n")
    assert report.render(stats, "root", report.View(verbosity=report.Verbosity.SUMMARY, min_lines=10**6)).endswith("Languages: .\n")
    csv = report.render(stats, "a,b", report.View(), "csv").split("\n")
    assert csv[1].startswith("C,2,100,50.0,60,30,10,0,1000,1000 B,60.0")
    assert '"a,b"' in report.render(stats, "a,b", view, "csv") and "Go files:" in report.render(stats, "x", view, "tsv")
    assert "| b\\|c/5.x | 50 |" in report.render(stats, "x", view, "markdown")
    assert "<td>Go</td>" in report.render(stats, "<x>", view, "html") and "&lt;x&gt;" in report.render(stats, "<x>", view, "html")
    for output in report.FORMATS:
        assert report.render(stats.limit(0), "x", report.View(), output)
    with pytest.raises(ValueError):
        report.render(stats, "x", view, "xml")


def test_files_of_a_report_come_in_parts(stats):
    view = report.View(verbosity=report.Verbosity.VERBOSE)
    for output in report.FORMATS:
        pieces = list(report.parts(stats, "x", view, output))
        assert len(pieces) > 6 and "".join(pieces) == report.render(stats, "x", view, output)
    built = report.build(stats, "x", view)
    assert [[f["path"] for f in g["files_detail"]] for g in built["languages"]] == [["a/6.x", "4.x"], ["b|c/5.x", "a/3.x"], ["b/2.x", "a/1.x"]]
    assert [f["path"] for f in built["languages"][0]["files_detail"]] == ["a/6.x", "4.x"]  # asked again, they come again


def test_places_of_a_sort_over_tasks(spark):
    rows = spark.range(5000).selectExpr("id", "id * 7919 % 1000 AS k").repartition(7)
    got = {r.id: r.place for r in aggregate.with_place(rows, [F.desc("k"), F.asc("id")]).collect()}
    want = sorted(range(5000), key=lambda i: (-(i * 7919 % 1000), i))
    assert [got[i] for i in want] == list(range(1, 5001))
    assert aggregate.with_place(rows.limit(0), [F.asc("id")]).count() == 0


def test_candidates_need_no_shuffle(spark):
    frame = spark.range(10).selectExpr("CAST(id AS STRING) AS rel_path", "'a.py' AS name")
    assert "Exchange" not in detect.candidates(frame, LANGUAGES)._jdf.queryExecution().executedPlan().toString()


def test_completions(capsys):
    for shell in cli.SHELLS:
        assert cli.main(["completions", shell]) == 0
        said = capsys.readouterr().out
        assert "by-dir" in said and "langs" in said


def test_language_listing():
    assert report.language_listing(["A", "Bb", "C"], 6) == "Total number of supported programming languages: 3\nA, \nBb, C.\n"
    lines = report.language_listing([x.name for x in LANGUAGES], 60).split("\n")
    assert lines[0].endswith(str(len(LANGUAGES))) and all(len(x) <= 60 for x in lines[1:]) and lines[-2].endswith(".")


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text('path = "sub"\nprecision = 9\nexclude = ["a"]\nunknown = 1\n[display]\nsort_by = "size"\n')
    base = config.from_file(tmp_path / "s.toml")
    assert base.path == str(tmp_path / "sub")
    merged = config.merge(base, {"exclude": ["b"], "sort_direction": "asc", "by_dir": None})
    assert merged.exclude == ("a", "b") and merged.precision == 6 and merged.sort_by == "size" and not merged.view.descending
    with pytest.raises(config.ConfigError):
        config.merge(base, {"languages": ["a"], "exclude_languages": ["b"]})
    with pytest.raises(config.ConfigError):
        config.merge(base, {"output": "xml"})
    found = config.places(tmp_path, {"HOME": "/h", "XDG_CONFIG_HOME": "/x"})
    assert [str(p) for p in found] == [str(tmp_path / ".loomline.toml"), str(tmp_path / "loomline.toml"), "/x/loomline/config.toml", "/h/.loomline.toml"]
    assert config.discover(tmp_path, {"HOME": str(tmp_path)}) == config.Config()
    config.init(tmp_path / "new.toml")
    assert config.from_file(tmp_path / "new.toml") == config.Config()
    with pytest.raises(FileExistsError):
        config.init(tmp_path / "new.toml")
    config.init(tmp_path / "new.toml", force=True)


def test_command_line(spark, tree, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert cli.main([str(tree), "-o", "json", "-l", "Rust"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["total_files"] == 1
    assert cli.main(["langs", "--width", "50"]) == 0
    assert "Python" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["-q", "-v"])


def test_stream(spark, tree, tmp_path):
    from loomline.streaming.incremental import language_counts

    static = files.read_tree(spark, tree).drop("error")
    static.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))
    q = language_counts(stream, LANGUAGES).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        assert {r["name"]: r.files for r in spark.table("counts").collect()} == {"Python": 4, "Rust": 1}
    finally:
        q.stop()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
