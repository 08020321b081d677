"""A thin HTTP adapter: requests become rows, replies are matched by request_id.

The server is for the edge, not for data.  ``stream`` gives the requests as a streaming source;
without it, bodies are kept in memory until ``rows`` takes them.
"""

from __future__ import annotations

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.spool import Spool

#: ``nth`` numbers the requests of a route 0, 1, 2, ...
SCHEMA = "request_id long, method string, path string, nth long, body string"
COLUMNS = ("request_id", "method", "path", "nth", "body")


class HttpSource:
    """Routes are (method, path); each is served once, an unknown one is answered 404."""

    def __init__(self, port: int = 0, timeout: float = 30.0):
        self.routes: set[tuple[str, str]] = set()
        self._waiting: dict[int, tuple[threading.Event, list[str]]] = {}
        self._rows: list[tuple[int, str, str, int, str]] = []
        self._asked: Counter[tuple[str, str]] = Counter()
        self._spool: Spool | None = None
        self._lock, self._next, self._timeout = threading.Lock(), 0, timeout
        source = self

        class Handler(BaseHTTPRequestHandler):
            def _serve(self) -> None:
                if (self.command, self.path) not in source.routes:
                    self.send_error(404)
                    return
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
                said = source._ask(self.command, self.path, body)
                self.send_response(200 if said is not None else 504)
                self.send_header("Content-Type", "text/html; charset=utf-8")
                self.end_headers()
                self.wfile.write((said or "").encode())

            do_GET = do_POST = do_PUT = do_DELETE = _serve

            def log_message(self, *_) -> None:
                pass

        self._server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self._server.server_address[1]
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def route(self, method: str, path: str) -> HttpSource:
        if (method, path) in self.routes:
            raise ValueError(f"{method} {path} is served already")
        self.routes.add((method, path))
        return self

    def _ask(self, method: str, path: str, body: str) -> str | None:
        event, said = threading.Event(), []
        with self._lock:
            number, self._next = self._next, self._next + 1
            self._waiting[number] = (event, said)
            row = (number, method, path, self._asked[method, path], body)
            self._asked[method, path] += 1
            if self._spool:
                self._spool.put(dict(zip(COLUMNS, row, strict=True)))
            else:
                self._rows.append(row)
        event.wait(self._timeout)
        with self._lock:
            self._waiting.pop(number, None)
        return said[0] if said else None

    def rows(self, spark: SparkSession) -> DataFrame:
        """The requests that came since the last call."""
        with self._lock:
            rows, self._rows = self._rows, []
        return spark.createDataFrame(rows, SCHEMA)

    def stream(self, spark: SparkSession) -> DataFrame:
        """The requests as a stream, those that ``rows`` has not taken and all that come until ``close``.

        Every request is a row of the stream, and ``rows`` has none from then on.
        """
        with self._lock:
            if self._spool is None:
                self._spool = Spool(spark, SCHEMA, "requests")
                for row in self._rows:
                    self._spool.put(dict(zip(COLUMNS, row, strict=True)))
                self._rows = []
        return self._spool.stream()

    def reply(self, replies: DataFrame) -> None:
        """Answer the waiting requests; replies to others are ignored."""
        for number, body in replies.select("request_id", "body").toLocalIterator():
            with self._lock:
                waiting = self._waiting.get(number)
            if waiting:
                waiting[1].append(body)
                waiting[0].set()

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()
        if self._spool:
            self._spool.close()
