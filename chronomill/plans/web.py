"""The queries over HTTP, as JSON: ``serve(catalog)`` starts a server, ``answer`` is what it says to a path.

Rows are written as Spark hands them over, a partition at a time, so an answer is never held whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.listing import DEFAULT_LIMIT
from .api import NotFound, Queries
from .catalog import Catalog


class BadRequest(ValueError):
    """A parameter that is missing or isn't a number."""


def _objects(rows: DataFrame) -> Iterator[str]:
    """Each row as a JSON object, nulls too."""
    for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")).toLocalIterator():
        yield r["json"]


def many(rows: DataFrame) -> Iterator[str]:
    yield "["
    for i, row in enumerate(_objects(rows)):
        yield f",{row}" if i else row
    yield "]"


def one(rows: DataFrame, missing: str | None = None) -> Iterator[str]:
    row = next(iter(_objects(rows.limit(1))), None)
    if row is None and missing:
        raise NotFound(missing)
    yield row or "null"


def by_language(rows: DataFrame) -> Iterator[str]:
    yield "{"
    for i, r in enumerate(rows.select("programming_language", "json").toLocalIterator()):
        yield f"{',' if i else ''}{json.dumps(r['programming_language'])}:{r['json']}"
    yield "}"


def number(given: dict[str, str], name: str, default: int) -> int:
    text = given.get(name, str(default))
    if not re.fullmatch(r"\d{1,10}", text):
        raise BadRequest(f"{name} must be a whole number")
    return int(text)


def page(given: dict[str, str]) -> tuple[int, int]:
    return number(given, "limit", DEFAULT_LIMIT), number(given, "offset", 0)


def wanted(given: dict[str, str]) -> tuple[str, int]:
    if "q" not in given:
        raise BadRequest("q is missing")
    return given["q"], number(given, "limit", DEFAULT_LIMIT)


#: Path, with {} for an id, and what answers it from (queries, id, parameters).
ROUTES: dict[str, Callable[[Queries, str, dict[str, str]], Iterator[str]]] = {
    "/health": lambda q, _, __: iter([json.dumps(q.health())]),
    "/codebases": lambda q, _, __: by_language(q.codebases_by_language()),
    "/codebase/{}": lambda q, i, _: one(q.codebase(i), f"codebase {i} not found"),
    "/codebase/{}/diff": lambda q, i, _: many(q.codebase_diffs(i)),
    "/codebase/{}/metrics": lambda q, i, _: many(q.codebase_metrics(i)),
    "/version/{}": lambda q, i, _: one(q.version(i), f"version {i} not found"),
    "/version/{}/changed_files": lambda q, i, given: many(q.changed_files(i, *page(given))),
    "/version/{}/files": lambda q, i, _: many(q.current_files(i)),
    "/version/{}/files/search": lambda q, i, given: many(q.search_filenames(i, *wanted(given), capped=True)),
    "/version/{}/diff": lambda q, i, _: one(q.version_diff(i)),
    "/version/{}/diffchange": lambda q, i, _: one(q.version_diff_changes(i)),
    "/version/{}/functions": lambda q, i, given: many(q.changed_functions(i, *page(given))),
    "/version/{}/functions/search": lambda q, i, given: many(q.search_functions(i, *wanted(given), capped=True)),
}
PATTERNS = [(re.compile(re.escape(route).replace(r"\{\}", "([^/]+)")), answers) for route, answers in ROUTES.items()]


def answer(queries: Queries, target: str) -> tuple[int, str, Iterator[str]]:
    """Status, content type and text of the answer to a path with its parameters."""
    parts = urlsplit(target)
    given = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    for pattern, answers in PATTERNS:
        if m := pattern.fullmatch(parts.path):
            row_id = unquote(m[1]) if m.groups() else ""
            try:
                # The first piece decides: what is not found shows before anything is sent.
                pieces = answers(queries, row_id, given)
                first = next(pieces)
            except BadRequest as e:
                return 400, "text/plain", iter([str(e)])
            except NotFound as e:
                text = str(e)
                return 404, "text/plain", iter([text if " " in text else f"version {text} not found"])
            return 200, "application/json", _chain(first, pieces)
    return 404, "text/plain", iter(["no such path"])


def _chain(first: str, rest: Iterator[str]) -> Iterator[str]:
    yield first
    yield from rest


def server(catalog: Catalog, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound to its port but doesn't run yet."""
    queries = Queries(catalog)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self) -> None:  # noqa: N802
            try:
                status, kind, pieces = answer(queries, self.path)
            except Exception as e:  # what went wrong is for the log, not for the caller
                self.log_error("%s", e)
                status, kind, pieces = 500, "text/plain", iter(["internal server error"])
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            for piece in pieces:
                data = piece.encode()
                if data:
                    self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")
            self.wfile.write(b"0\r\n\r\n")

    return ThreadingHTTPServer((host, port), Handler)


def serve(catalog: Catalog, host: str = "127.0.0.1", port: int = 8080) -> None:
    with server(catalog, host, port) as s:
        s.serve_forever()
