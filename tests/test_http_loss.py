"""A connection that ends before the announced length is resumed, or raises; it is never taken for the end."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tonelake.sources import http

BODY = bytes(range(256)) * 40


class Cutting(BaseHTTPRequestHandler):
    losses = 0

    def do_GET(self):
        first = int(self.headers["Range"].removeprefix("bytes=").split("-")[0])
        self.send_response(206)
        self.send_header("Content-Length", str(len(BODY) - first))
        self.end_headers()
        cut = len(BODY) if Cutting.losses <= 0 else first + 1000
        Cutting.losses -= 1
        self.wfile.write(BODY[first:cut])

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), Cutting)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/a"
    server.shutdown()


def test_open_range_goes_on_after_a_loss(url):
    Cutting.losses = 2
    assert b"".join(data for _, data in http.fetch(url, 0, None, 3, 5)) == BODY


def test_open_range_raises_when_losses_go_on(url):
    Cutting.losses = 99
    with pytest.raises(OSError):
        list(http.fetch(url, 0, None, 2, 5))
