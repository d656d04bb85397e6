"""A live view of a search: its events, replayed from the first, over HTTP on this machine."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from ..options import OPTIONS

PAGE = """<!doctype html><meta charset="utf-8"><title>Search</title><h1>Search</h1><pre id="log"></pre><script>
let seen = 0;
async function more() {
  const events = await (await fetch("/events?from=" + seen)).json();
  for (const e of events) document.getElementById("log").textContent += JSON.stringify(e) + "\\n";
  seen += events.length;
  setTimeout(more, 1000);
}
more();
</script>"""


class Viewer:
    """Serves ``/`` (a page) and ``/events?from=n`` (the events from the n-th on, as JSON)."""

    def __init__(self, port: int | None = None):
        events: list[dict] = []
        self.events = events

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802  the name that the server calls
                url = urlparse(self.path)
                if url.path == "/events":
                    start = int(parse_qs(url.query).get("from", ["0"])[0])
                    kind, body = "application/json", json.dumps(events[start:], default=str).encode()
                else:
                    kind, body = "text/html; charset=utf-8", PAGE.encode()
                self.send_response(200)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", int(OPTIONS["viewer_port"] if port is None else port)), Handler)
        self.thread = threading.Thread(target=self.server.serve_forever, daemon=True)
        self.thread.start()

    @property
    def url(self) -> str:
        return f"http://127.0.0.1:{self.server.server_address[1]}/"

    def send(self, event: dict) -> None:
        self.events.append(event)

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
