"""Servers that go quiet, break off or never answer, and a restart in between."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tonelake.sources import follow

BODY = bytes(range(256)) * 60


class Moody(BaseHTTPRequestHandler):
    """By path: quiet after 1000 bytes three times; broken off at 4000 twice; mute for ever; gone; well."""

    asked: dict

    def do_GET(self):
        first = int(self.headers["Range"].removeprefix("bytes=").split("-")[0])
        own = self.asked.setdefault(self.path, [])
        own.append(first)
        if self.path == "/gone":
            self.send_error(404)
            return
        if first >= len(BODY):
            self.send_error(416)
            return
        self.send_response(206)
        self.send_header("Content-Length", str(len(BODY) - first))
        self.end_headers()
        if self.path == "/mute":
            self.wfile.flush()
            time.sleep(1.2)
            return
        if self.path == "/quiet" and len(own) <= 3:
            self.wfile.write(BODY[first : first + 1000])
            self.wfile.flush()
            time.sleep(1.2)
            return
        self.wfile.write(BODY[first : first + 4000] if self.path == "/broken" and len(own) <= 2 else BODY[first:])

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    kind = type("Own", (Moody,), {"asked": {}})
    s = ThreadingHTTPServer(("127.0.0.1", 0), kind)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield kind.asked, f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.url, r.offset)):
        path = "/" + r.url.rsplit("/", 1)[1]
        assert r.offset == len(out.get(path, b""))
        out[path] = out.get(path, b"") + bytes(r.data)
    return out


def test_asked_again_from_the_right_byte(spark, tmp_path, server):
    asked, url = server
    folder = f"file://{tmp_path}/follow"
    q = follow.follow(spark, [url + p for p in ("/quiet", "/broken", "/mute", "/gone", "/well")], folder, idle=0.4, attempts=2, piece=5000)
    q.processAllAvailable()
    q.stop()
    assert joined(follow.pieces(spark, folder).collect()) == {p: BODY for p in ("/quiet", "/broken", "/well")}
    assert asked["/quiet"][:4] == [0, 1000, 2000, 3000] and asked["/broken"][:3] == [0, 4000, 8000] and asked["/well"] == [0, 5000, 10_000, 15_000]
    assert asked["/mute"] == [0, 0] and asked["/gone"] == [0, 0]
    told = {(r.url.rsplit("/", 1)[1], r.offset, r.event) for r in follow.events(spark, folder, 2).collect()}
    assert told == {*(("quiet", 1000 * k, "slow stream") for k in (1, 2, 3)), ("broken", 4000, "connection lost"), ("broken", 8000, "connection lost"), ("mute", 0, "slow stream"), ("mute", 0, "given up"), ("gone", 0, "connection lost"), ("gone", 0, "given up")}


def test_restart(spark, tmp_path, server):
    asked, url = server
    folder = f"file://{tmp_path}/again"
    q = follow.follow(spark, [url + "/well"], folder, idle=0.4, piece=1000)
    for _ in range(100):
        if len(asked.get("/well", [])) >= 3:
            break
        time.sleep(0.1)
    q.stop()
    q = follow.follow(spark, [url + "/well"], folder, idle=0.4, piece=1000)
    q.processAllAvailable()
    q.stop()
    assert joined(follow.pieces(spark, folder).collect()) == {"/well": BODY}


def test_pull(server):
    _, url = server
    assert follow.pull(url + "/well", 0, 100, 1) == (BODY[:100], "more") and follow.pull(url + "/well", len(BODY) - 3, 100, 1) == (BODY[-3:], "ended")
    assert follow.pull(url + "/well", len(BODY), 100, 1) == (b"", "ended") and follow.pull("http://127.0.0.1:1/", 0, 9, 0.3)[1] == "lost"
