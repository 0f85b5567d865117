"""A small HTTP service of an engine: queries, tables, subscriptions, health.

``GET /health``; ``GET /tables``; ``POST /query`` with ``{"sql": ..., "at": ..., "min_seq": ...}``; ``GET
/subscribe?table=..&where=..&since=..&once=1``.  Rows come as lines of JSON, drawn a partition at a time, so no answer
is held whole; a frame of a subscription is one line ``{"seq": .., "rows": [..]}``.  Errors are
``{"code": .., "message": ..}``.  Any origin may ask.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import PySparkException

from .session import Engine
from .sources.log import LogError
from .sources.tables import shared_dir
from .spec import ColumnSpec, IndexSpec, SpecError, TableSpec


def specs_of(text: str) -> list[TableSpec]:
    """Declarations from JSON: name, columns ([name, kind] or [name, kind, nullable]), primary_key and indexes."""
    out = []
    for t in json.loads(text):
        indexes = tuple(IndexSpec(i["name"], tuple(i["keys"]), tuple(i.get("cover", ())), i.get("layout", "lexicographic")) for i in t.get("indexes", ()))
        out.append(TableSpec(t["name"], tuple(ColumnSpec(*c) for c in t["columns"]), tuple(t["primary_key"]), indexes))
    return out


def _plain(value):
    """What JSON has no type for: bytes in hexadecimal, all else as text."""
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)


class _Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    engine: Engine
    lock: threading.Lock

    def log_message(self, *args) -> None:
        pass

    def _begin(self, status: int = 200) -> None:
        self.send_response(status)
        self.send_header("Content-Type", "application/x-ndjson")
        self.send_header("Access-Control-Allow-Origin", "*")
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()

    def _line(self, value) -> None:
        data = json.dumps(value, default=_plain).encode() + b"\n"
        self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))

    def _end(self) -> None:
        self.wfile.write(b"0\r\n\r\n")

    def _answer(self, rows) -> None:
        """Headers wait for the first row, so that a query that fails is an error, not a broken answer."""
        begun = False
        try:
            for row in rows:
                if not begun:
                    self._begin()
                    begun = True
                self._line(row)
        except (LogError, SpecError, ValueError, PySparkException) as e:
            if not begun:
                self._begin(409 if isinstance(e, LogError) else 400)
            self._line({"code": getattr(e, "code", None) or type(e).__name__, "message": str(e).splitlines()[0]})
        else:
            if not begun:
                self._begin()
        self._end()

    def do_OPTIONS(self) -> None:
        self.send_response(204)
        for name, value in (("Origin", "*"), ("Methods", "GET, POST, OPTIONS"), ("Headers", "Content-Type")):
            self.send_header(f"Access-Control-Allow-{name}", value)
        self.send_header("Content-Length", "0")
        self.end_headers()

    def do_GET(self) -> None:
        url = urlsplit(self.path)
        asked = {k: v[0] for k, v in parse_qs(url.query).items()}
        if url.path == "/health":
            self._answer([{"status": "ok", "seq": self.engine.log.current()}])
        elif url.path == "/tables":
            self._answer(self.engine.tables())
        elif url.path == "/subscribe":
            self._subscribe(asked)
        else:
            self._begin(404)
            self._end()

    def do_POST(self) -> None:
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        if urlsplit(self.path).path != "/query":
            self._begin(404)
            self._end()
            return

        def rows():
            asked = json.loads(body)
            if not isinstance(asked, dict) or "sql" not in asked:
                raise ValueError("a query is an object with sql")
            with self.lock:  # views are the session's: a query is planned on its own snapshot
                df = self.engine.sql(asked["sql"], asked.get("at"), asked.get("min_seq"))
            for r in df.toLocalIterator():
                yield r.asDict(recursive=True)

        self._answer(rows())

    def _subscribe(self, asked: dict) -> None:
        try:
            checkpoint = f"{shared_dir(self.engine.spark)}/subscription"
            frame = lambda seq, df: self._line({"seq": seq, "rows": [r.asDict(recursive=True) for r in df.toLocalIterator()]})
            since = int(asked["since"]) if asked.get("since") else None
            q = self.engine.subscribe(asked.get("table", ""), asked.get("where", "true"), frame, checkpoint, since, once=asked.get("once") == "1")
        except (LogError, SpecError, ValueError, KeyError, PySparkException) as e:
            self._begin(400)
            self._line({"code": type(e).__name__, "message": str(e).splitlines()[0]})
            self._end()
            return
        self._begin()
        try:
            q.awaitTermination()  # a client that leaves ends it: its next frame cannot be written
        except PySparkException as e:
            code = "BATCH_EVICTED" if "BATCH_EVICTED" in str(e) else type(e).__name__
            self._line({"code": code, "message": str(e).splitlines()[0]})
        finally:
            q.stop()
        self._end()


def serve(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server in threads of its own (``server.server_port``, ``server.shutdown()``)."""
    handler = type("Handler", (_Handler,), {"engine": engine, "lock": threading.Lock()})
    server = ThreadingHTTPServer((host, port), handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
