"""A small HTTP service: a page with two forms, and reports of an uploaded zip archive or of a git repository.

GET / gives the page, GET /health says ok. POST /api/analyze/zip takes a multipart form whose first field is the archive, POST
/api/analyze/git takes {"url": ...}; both answer with the compact JSON report under default settings. What the caller got wrong
is answered with 400, all else that fails with 500, as {"error": ...}. Each request is a thread of its own on one session.
"""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .plans.analysis import file_stats
from .sources import catalog
from .sources.files import ZIP_LIMIT, GitError, ZipError, read_git, read_zip

PAGE = """<!DOCTYPE html>
<html lang="en">
<head><meta charset="utf-8" /><title>loomline</title></head>
<body>
<h1>loomline</h1>
<form id="zip"><label>Zip archive <input type="file" name="file" accept=".zip" required /></label> <button>Count</button></form>
<form id="git"><label>Git repository <input type="url" name="url" required /></label> <button>Count</button></form>
<p id="said"></p>
<table id="languages"></table>
<script>
const cell = (row, text) => { row.insertCell().textContent = text; };
async function show(path, options) {
  const said = document.getElementById("said"), table = document.getElementById("languages");
  said.textContent = "Counting...";
  table.replaceChildren();
  const answer = await fetch(path, { method: "POST", ...options }), got = await answer.json();
  if (!answer.ok) { said.textContent = got.error; return; }
  const sum = got.summary;
  said.textContent = `${sum.total_files} files, ${sum.total_lines} lines, ${sum.total_size_human}`;
  const head = table.insertRow();
  for (const name of ["Language", "Files", "Lines", "Code", "Comments", "Blanks", "Size"]) cell(head, name);
  for (const x of got.languages) {
    const row = table.insertRow();
    for (const v of [x.name, x.files, x.lines, x.code_lines, x.comment_lines, x.blank_lines, x.size_human]) cell(row, v);
  }
}
document.getElementById("zip").onsubmit = (e) => { e.preventDefault(); show("/api/analyze/zip", { body: new FormData(e.target) }); };
document.getElementById("git").onsubmit = (e) => {
  e.preventDefault();
  show("/api/analyze/git", { headers: { "content-type": "application/json" }, body: JSON.stringify({ url: e.target.url.value }) });
};
</script>
</body>
</html>
"""


class BadRequest(ValueError):
    pass


def first_field(kind: str, body: bytes) -> bytes:
    """The content of the first field of a multipart form."""
    m = re.search(r'boundary="?([^";,]+)"?', kind)
    start = body.find(b"\r\n\r\n") if m else -1
    mark = b"--" + m[1].encode() if m else b""
    if not m or not body.startswith(mark) or start < 0:
        raise BadRequest("a multipart form with the archive as its first field is wanted")
    end = body.find(b"\r\n" + mark, start + 4)
    if end < 0:
        raise BadRequest("the form breaks off")
    return body[start + 4 : end]


def compact_report(files: DataFrame, path: str) -> str:
    stats = file_stats(files.where(F.col("error").isNull()).drop("error"), catalog.load()).persist()
    try:
        return report.render(stats, path, output="json-compact")
    finally:
        stats.unpersist()


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 3000) -> ThreadingHTTPServer:
    """A server that is bound and ready for serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, kind: str, text: str) -> None:
            body = text.encode()
            self.send_response(status)
            self.send_header("content-type", kind)
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path == "/":
                self._answer(200, "text/html; charset=utf-8", PAGE)
            elif self.path == "/health":
                self._answer(200, "text/plain; charset=utf-8", "ok")
            else:
                self._answer(404, "application/json", json.dumps({"error": "not found"}))

        def do_POST(self) -> None:
            try:
                size = int(self.headers.get("content-length") or 0)
                if size > ZIP_LIMIT:
                    raise BadRequest("the upload is too large")
                body = self.rfile.read(size)
                if self.path == "/api/analyze/zip":
                    text = compact_report(read_zip(spark, first_field(self.headers.get("content-type", ""), body)), "archive.zip")
                elif self.path == "/api/analyze/git":
                    url = _url(body)
                    text = compact_report(read_git(spark, url), url)
                else:
                    self._answer(404, "application/json", json.dumps({"error": "not found"}))
                    return
                self._answer(200, "application/json", text)
            except (BadRequest, ZipError, GitError) as e:
                self._answer(400, "application/json", json.dumps({"error": str(e)}))
            except Exception as e:  # the service goes on
                self._answer(500, "application/json", json.dumps({"error": str(e)}))

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def _url(body: bytes) -> str:
    try:
        url = json.loads(body)["url"]
    except (ValueError, TypeError, KeyError) as e:
        raise BadRequest('{"url": ...} is wanted') from e
    if not isinstance(url, str):
        raise BadRequest('{"url": ...} is wanted')
    return url
