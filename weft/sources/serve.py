"""The engine behind two local HTTP routes: POST /query {"query": ...} and GET /wordlist/PREFIX, both answered in JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from weft.plans.engine import Engine
from weft.sources.sinks import as_json


def server(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound, but not yet running: call serve_forever. Only answers, at most 50 of a query, pass through it; a request it can't read gets status 400."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: str, status: int = 200) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Headers", "Origin, X-Requested-With, Content-Type, Accept")
            self.end_headers()
            self.wfile.write(body.encode())

        def do_OPTIONS(self) -> None:  # noqa: N802
            self._send("")

        def do_POST(self) -> None:  # noqa: N802
            try:
                query = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["query"]
            except (ValueError, KeyError, TypeError):
                return self._send('{"error": "no query"}', 400)
            if self.path.rstrip("/") != "/query" or not isinstance(query, str):
                return self._send('{"error": "unknown"}', 404 if isinstance(query, str) else 400)
            return self._send("[" + ", ".join(r["value"] for r in as_json(engine.search(query)).collect()) + "]")

        def do_GET(self) -> None:  # noqa: N802
            head, _, prefix = self.path.partition("/wordlist/")
            if head or not prefix:
                return self._send('{"error": "unknown"}', 404)
            return self._send(json.dumps([r["term"] for r in engine.word_list(unquote(prefix)).toLocalIterator()]))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
