"""A thin HTTP front of an engine: ``/sparql``, ``/data``, ``/rest``; queries run side by side, updates one by one."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from urllib.parse import parse_qs, unquote, urlparse

from ontoloom.catalog import CatalogError
from ontoloom.engine import Engine
from ontoloom.plans.parser import QuerySyntaxError, parse
from ontoloom.sinks import writers


def is_update(engine: Engine, text: str) -> bool:
    return isinstance(parse(text, engine.catalog.namespaces, engine.catalog.base), list)


def lines(engine: Engine, text: str, accept: str = "xml") -> tuple[str, Iterator[str]]:
    """Media type and lines of a query, or of an update's reply (the description of what it created).

    The lines of a query come one partition at a time, so a long answer is never whole on the driver. A query
    reads the catalog as it is when it starts; an update replaces it and changes nothing that is being read.
    """
    if is_update(engine, text):
        made = engine.update(text)
        return "application/rdf+xml", (r.value for iri in made for r in writers.describe_rdf_xml(engine.catalog, engine.describe(iri)).collect())
    df = engine.query(text)
    if df.columns == ["s", "p", "o", "is_resource"]:
        return "application/rdf+xml", (r.value for r in writers.describe_rdf_xml(engine.catalog, df).toLocalIterator())
    if accept == "csv":
        return "text/csv", writers.csv(df)
    return "application/sparql-results+xml", writers.sparql_xml(df)


def answer(engine: Engine, text: str, accept: str = "xml") -> tuple[str, str]:
    """``lines`` as one text."""
    kind, body = lines(engine, text, accept)
    return kind, "\n".join(body)


def serve(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``; port 0 takes a free one."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, kind: str, *body: str) -> None:
            self._stream(status, kind, iter(body))

        def _stream(self, status: int, kind: str, parts: Iterator[str], between: str = "") -> None:
            """The body ends with the connection; its first part is there before the status is sent."""
            first = next(parts, None)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            for n, part in enumerate(chain([] if first is None else [first], parts)):
                self.wfile.write(((between if n else "") + part).encode())

        def _query(self, text: str, accept: str) -> None:
            try:
                if is_update(engine, text):
                    with lock:
                        kind, body = lines(engine, text, accept)
                        body = iter(list(body))  # the description of what one update created
                else:
                    kind, body = lines(engine, text, accept)
                self._stream(200, kind, body, "\n")
            except (QuerySyntaxError, CatalogError, ValueError) as e:
                self._send(400, "text/plain", str(e))

        def do_GET(self) -> None:
            url = urlparse(self.path)
            args = parse_qs(url.query)
            if url.path == "/sparql" and "query" in args:
                self._query(args["query"][0], args.get("format", ["xml"])[0])
            elif url.path.startswith("/rest"):
                self._stream(*writers.rest_parts(engine.catalog, unquote(url.path)))
            elif url.path.startswith("/r/"):
                body = writers.rendered(engine.catalog, unquote(url.path[3:]))
                self._send(200 if body is not None else 404, "text/plain", body if body is not None else "not found")
            elif url.path.startswith("/data/"):
                self._query(f"DESCRIBE <{unquote(url.path[6:])}>", "xml")
            else:
                self._send(404, "text/plain", "not found")

        def do_POST(self) -> None:
            text = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            if self.path.startswith("/rest"):
                self._send(405, "text/plain", "method not allowed")
            else:
                self._query(text, "csv" if "csv" in self.headers.get("Accept", "") else "xml")

    return ThreadingHTTPServer((host, port), Handler)
