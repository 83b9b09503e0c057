import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.operators import enrich


@pytest.fixture
def server():
    """A generate endpoint that counts the calls it has at once, and fails where the prompt says so."""

    class Handler(BaseHTTPRequestHandler):
        now, most, calls, lock = 0, 0, {}, threading.Lock()

        def do_POST(self):  # noqa: N802
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            with Handler.lock:
                Handler.now += 1
                Handler.most = max(Handler.most, Handler.now)
                Handler.calls[text] = Handler.calls.get(text, 0) + 1
                tries = Handler.calls[text]
            time.sleep(0.05)
            with Handler.lock:
                Handler.now -= 1
            fails = "never" in text or "second" in text and tries < 2
            body = b"" if fails else json.dumps({"response": f"re {text}"}).encode()
            self.send_response(500 if fails else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_address[1]}", Handler
    http.shutdown()


def test_calls_in_flight_retries_and_order(spark, server):
    endpoint, handler = server
    rows = spark.createDataFrame([(k, f"{k}" + (" never" if k == 7 else " second" if k % 10 == 3 else "")) for k in range(64)], "id long, text string").coalesce(1)
    got = enrich.ask_model(rows, "id", "text", enrich.http_generate(endpoint, "m"), enrich.Calls(in_flight=8, tries=2, pause=0.01)).collect()
    assert [(r.id, r.reply) for r in got] == [(r.id, "" if r.id == 7 else f"re {r.text}") for r in rows.collect()]
    assert 4 <= handler.most <= 8
    assert handler.calls["7 never"] == 2 and handler.calls["13 second"] == 2 and handler.calls["5"] == 1


def test_texts_are_read_ahead_by_as_many_as_are_in_flight():
    read = []

    def texts():
        for k in range(100):
            read.append(k)
            yield str(k)

    replies = enrich.answers(texts(), lambda t: t.upper(), enrich.Calls(in_flight=5))
    assert next(replies) == "0" and len(read) <= 5
    assert list(replies) == [str(k) for k in range(1, 100)]
    assert list(enrich.answers(iter([]), str, enrich.Calls())) == []


def test_deadline():
    began, calls = time.monotonic(), []

    def slow(text):
        calls.append(text)
        time.sleep(0.2)
        raise OSError

    got = list(enrich.answers((str(k) for k in range(50)), slow, enrich.Calls(in_flight=2, tries=5, pause=0.05, deadline=0.5)))
    assert got == [""] * 50 and time.monotonic() - began < 2 and len(calls) <= 8
