"""A store's metrics over HTTP, for those who ask for it: nothing listens by itself."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

from .store import Store

PATHS = ("/metrics", "/")


def serve_metrics(store: Store, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Answers in a thread of the driver, any method, until ``shutdown``; ``server_port`` says where."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            known = self.path in PATHS
            body = (store.snapshot_json() if known else '{"error":"not found"}').encode()
            self.send_response(200 if known else 404)
            for name, value in (("Content-Type", "application/json"), ("Access-Control-Allow-Origin", "*"), ("Content-Length", str(len(body)))):
                self.send_header(name, value)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = do_OPTIONS = _answer

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server
