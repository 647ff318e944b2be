"""The service over HTTP, with the standard library's server."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from plumbline import __version__
from plumbline.config import Config
from plumbline.errors import ConfigError, DatasetError, NotFound, SecurityError
from plumbline.operators.pages import ImageFilter
from plumbline.service import AuditService, as_dict

ERRORS = {ConfigError: (400, "bad_request"), SecurityError: (400, "invalid_path"), NotFound: (404, "not_found"), DatasetError: (422, "invalid_dataset"), json.JSONDecodeError: (422, "validation_error")}
TYPES = {"json": "application/json", "csv": "text/csv", "html": "text/html; charset=utf-8", "pdf": "application/pdf"}


def _number(q: dict, name: str, default: int | None = None) -> int | None:
    if name not in q:
        return default
    try:
        return int(q[name][0])
    except ValueError as e:
        raise ConfigError(f"{name} must be a number") from e


def route(service: AuditService, method: str, path: str, q: dict, body: bytes) -> tuple[int, object, str]:
    """(status, content, type) of a request; content is JSON unless it is bytes or an iterator of them."""
    one = lambda n: q[n][0] if n in q else None
    given = lambda *names: {n: q[n][0] for n in names if n in q}
    paging = lambda size: {"page": _number(q, "page", 1), "size": _number(q, "page_size", size)}
    json_ = "application/json"

    def audit(id: str, rest: str) -> tuple[int, object, str]:
        if rest == "images":
            f = ImageFilter(one("split"), one("status"), one("q"), q.get("tag", []), None, None, *[_number(q, n) for n in ("min_width", "max_width", "min_height", "max_height")])
            return 200, service.image_page(id, f, one("finding"), one("class"), one("sort") or "path", one("order") or "asc", **paging(50)), json_
        if m := re.fullmatch(r"images/(\w+)", rest):
            return 200, service.image(id, m[1]), json_
        if m := re.fullmatch(r"images/(\w+)/thumbnail", rest):
            return 200, service.preview(id, m[1], max(32, min(1600, _number(q, "size", 256)))).read_bytes(), "image/jpeg"
        if rest == "annotations/issues":
            return 200, service.issues_page(id, **given("code", "level", "split", "q"), **paging(50)), json_
        if rest == "duplicates":
            return 200, service.duplicates_page(id, **given("kind", "scope", "split"), **paging(20)), json_
        if rest == "leakage":
            return 200, service.leakage(id), json_
        if rest == "findings":
            return 200, service.findings(id, **given("severity", "category")), json_
        if m := re.fullmatch(r"reports/(\w+)", rest):
            return 200, service.report(id, m[1], one("csv_kind") or "images", one("include_images") == "true")[1], TYPES.get(m[1], json_)
        raise NotFound(path)

    if (method, path) == ("GET", "/api/health"):
        return 200, {"status": "ok", "version": __version__, "allowed_roots": service.allowed or []}, json_
    if (method, path) == ("GET", "/api/config/defaults"):
        return 200, Config().to_dict(), json_
    if path == "/api/scans":
        if method == "POST":
            x = json.loads(body)
            if not isinstance(x, dict) or not isinstance(x.get("path"), str):
                raise ConfigError("path is missing")
            return 202, as_dict(service.submit(x["path"], x.get("mode", "scan"), x.get("config"))), json_
        return 200, [as_dict(j) for j in service.jobs()], json_
    if (method, path) == ("POST", "/api/scans/upload"):
        with tempfile.NamedTemporaryFile(suffix=".zip") as f:
            f.write(body)
            f.flush()
            return 202, as_dict(service.submit_archive(f.name, one("mode") or "scan")), json_
    if m := re.fullmatch(r"/api/scans/(\w+)", path):
        return 200, as_dict(service.cancel(m[1]) if method == "DELETE" else service.job(m[1])), json_
    if (method, path) == ("GET", "/api/audits"):
        return 200, service.audits(), json_
    if m := re.fullmatch(r"/api/audits/([\w-]+)", path):
        if method == "DELETE":
            service.delete(m[1])
            return 204, b"", json_
        return 200, service.overview(m[1]), json_
    if method == "GET" and (m := re.fullmatch(r"/api/audits/([\w-]+)/(.+)", path)):
        return audit(m[1], m[2])
    raise NotFound(path)


def handler(service: AuditService, max_body: int = 2048 * 1024 * 1024) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url = urlsplit(self.path)
            try:
                length = int(self.headers.get("Content-Length") or 0)
                if length > max_body:
                    raise ConfigError("the request is too large")
                status, content, kind = route(service, self.command, url.path, parse_qs(url.query), self.rfile.read(length))
            except Exception as e:  # whatever goes wrong is answered
                status, code = next((v for k, v in ERRORS.items() if isinstance(e, k)), (500, "internal_error"))
                content, kind = {"error": {"code": code, "message": str(e) if status < 500 else f"{type(e).__name__}"}}, "application/json"
            chunks = content if isinstance(content, Iterator) else iter([content if isinstance(content, bytes) else json.dumps(content, default=str).encode()])
            first = next(chunks, b"")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            if not isinstance(content, Iterator):
                self.send_header("Content-Length", str(len(first)))
            if kind.startswith("text/html"):
                self.send_header("Content-Security-Policy", "default-src 'none'; style-src 'unsafe-inline'; img-src data:")
            self.end_headers()
            # A stream's end is the connection's.
            self.wfile.write(first)
            self.wfile.writelines(chunks)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve(service: AuditService, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't running yet; call serve_forever."""
    return ThreadingHTTPServer((host, port), handler(service))


