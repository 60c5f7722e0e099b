"""A small local page and JSON interface over the library; standard library only, bound to this machine."""

from __future__ import annotations

import io
import json
import os
import tempfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

import yaml
from pyspark.errors import PySparkException

from flatspark.cli import ERROR, OK, SCHEMA, VALIDATION, cause, session
from flatspark.operators.infer import infer_layout
from flatspark.plans.conversion import convert
from flatspark.plans.layout import LayoutError, build_layout
from flatspark.sinks.text import FORMATS, extension

PAGE = """<!doctype html><meta charset=utf-8><title>flatspark</title>
<h1>flatspark</h1><p><input id=path size=60 placeholder="file on this machine"> <select id=kind>
<option>json<option>csv<option>ndjson<option>sql<option>singer</select>
<button onclick="go('generate')">Infer layout</button> <button onclick="go('convert')">Preview</button>
<p><textarea id=layout rows=16 cols=90></textarea><pre id=shown></pre>
<script>
const at = id => document.getElementById(id);
async function go(what) {
  const body = {input: at('path').value, schema: at('layout').value, format: at('kind').value};
  const got = await (await fetch('/api/' + what, {method: 'POST', body: JSON.stringify(body)})).json();
  if (got.schema) at('layout').value = got.schema;
  at('shown').textContent = JSON.stringify(got, null, 1);
}
</script>"""


class BadRequest(ValueError):
    """A request that cannot be served; its text goes to the client."""


def _existing(body: dict[str, Any]) -> str:
    path = body.get("input") or ""
    if not os.path.exists(path):
        raise BadRequest("input file not found")
    return path


def generate(body: dict[str, Any]) -> dict[str, Any]:
    try:
        data = infer_layout(session(), _existing(body), codepage=body.get("codepage", "utf-8"), has_header=body.get("has_header"))
    except (OSError, LookupError, PySparkException) as e:
        raise BadRequest(cause(e)) from e
    return {"schema": yaml.safe_dump(data, sort_keys=False), "delimiter": data["delimiter"], "has_header": data["has_header"]}


def preview(path: str, fmt: str) -> Any:
    if fmt == "json" and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return json.load(f)[:5]
    if fmt == "csv" and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read().splitlines()[:6]
    return None


def converted(body: dict[str, Any]) -> dict[str, Any]:
    path, text, fmt = _existing(body), body.get("schema"), body.get("format", "json")
    if not text:
        raise BadRequest("schema required")
    if fmt not in FORMATS:
        raise BadRequest(f"unsupported output format: {fmt!r}")
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise BadRequest(f"invalid schema: {e}") from e
    told = io.StringIO()
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, f"out.{extension(fmt)}")
        try:
            layout = build_layout(data) if isinstance(data, dict) else build_layout({})
            done = convert(session(), path, layout, fmt, out)
            report = done.report
            told.write(f"records: {report.total} | ok: {report.ok} | errors: {report.errors}\n")
            for r in done.rejects().orderBy("line").toLocalIterator():
                told.write(f"  line {r.line}: {r.error}\n")
            for v in report.violations:
                told.write(f"  rule violation: {v.message}\n")
            code = VALIDATION if report.errors or report.violations else OK
        except LayoutError as e:
            code = SCHEMA
            told.write(f"schema error: {e}\n")
        except (OSError, ValueError, LookupError, PySparkException) as e:
            code = ERROR
            told.write(f"input error: {cause(e)}\n")
        return {"exit_code": code, "stdout": "", "stderr": told.getvalue(), "preview": preview(out, fmt)}


class Handler(BaseHTTPRequestHandler):
    routes = {"/api/generate": generate, "/api/convert": converted}

    def log_message(self, *_: Any) -> None:
        """Quiet."""

    def answer(self, code: int, body: bytes, kind: str) -> None:
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def data(self, code: int, body: dict[str, Any]) -> None:
        self.answer(code, json.dumps(body).encode(), "application/json")

    def do_GET(self) -> None:
        if self.path in ("/", "/index.html"):
            self.answer(200, PAGE.encode(), "text/html")
        else:
            self.data(404, {"error": "not found"})

    def do_POST(self) -> None:
        route = self.routes.get(self.path)
        if route is None:
            return self.data(404, {"error": "not found"})
        try:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            if not isinstance(body, dict):
                raise BadRequest("a mapping is needed")
            self.data(200, route(body))
        except ValueError as e:
            self.data(400, {"error": str(e)})


def serve(host: str = "127.0.0.1", port: int = 8000) -> None:
    with ThreadingHTTPServer((host, port), Handler) as server:
        print(f"flatspark on http://{host}:{server.server_address[1]}")
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            print("stopped")
