"""Limits fall where an endpoint refuses, recover later, and a broken endpoint is left aside."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from marlstone.operators import model_calls, pacing


class Server:
    """Refuses what comes while ``allowed`` requests are open; breaks while it is down."""

    def __init__(self, allowed):
        self.allowed, self.open, self.peak, self.served, self.refused, self.down, self.lock = allowed, 0, 0, 0, 0, False, threading.Lock()

    def chat(self, messages, **parameters):
        with self.lock:
            if self.down:
                raise ConnectionError("down")
            if self.open >= self.allowed:
                self.refused += 1
                raise model_calls.RateLimited("busy")
            self.open += 1
            self.peak = max(self.peak, self.open)
        time.sleep(0.004)
        with self.lock:
            self.open -= 1
            self.served += 1
        return {"content": "x"}


def ask(client, n, threads=24):
    one = lambda _: model_calls.with_retry(lambda: client.chat([]), tries=50, base=1.0, pause=0.0, sleep=lambda s: None)
    with ThreadPoolExecutor(threads) as pool:
        return [r["content"] for r in pool.map(one, range(n))]


def test_limit_falls_and_recovers():
    server = Server(4)
    client = pacing.PacedClient((server,), "falls", most=24, pause=0.01)
    assert ask(client, 400) == ["x"] * 400
    e = client.shared().endpoints[0]
    settled = e.limits[len(e.limits) // 2 :]
    assert server.refused < 100 and 1 <= min(settled) and max(settled) <= 8 and e.open == 0
    server.allowed = 24
    ask(client, 1500)
    assert e.limit > 10 and server.peak > 8
    server.allowed = 2
    before = server.refused
    ask(client, 200)
    assert e.limit <= 4.5 and server.refused - before < 80


def test_a_broken_endpoint_is_left_aside_and_comes_back():
    good, bad = Server(50), Server(50)
    bad.down = True
    client = pacing.PacedClient((bad, good), "aside", most=8, pause=0.02)
    assert len(ask(client, 300)) == 300
    failed = sum(1 for _ in client.shared().endpoints[0].limits)
    assert good.served == 300 and failed < 60
    bad.down = False
    time.sleep(client.shared().endpoints[0].free_at - time.monotonic() if client.shared().endpoints[0].free_at > time.monotonic() else 0)
    ask(client, 300)
    assert bad.served > 50


def test_tasks_share_a_limit_and_an_http_endpoint_is_paced(spark):
    """All rows are answered though the server refuses what comes too fast, and tasks together stay near what it takes."""
    state = Server(4)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            try:
                state.chat([])
                code, body = 200, b'{"choices": [{"message": {"content": "ok"}, "finish_reason": "stop"}], "usage": {}}'
            except model_calls.RateLimited:
                code, body = 429, b"busy"
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        client = pacing.PacedClient((model_calls.ChatClient(model_calls.BackendSpec("x", "m", (f"http://127.0.0.1:{http.server_port}",))),), "http", most=8, tasks=4, pause=0.02)
        rows = spark.range(0, 200, 1, 4).select(F.col("id").cast("string").alias("key"), F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content"))).alias("messages"))
        got = model_calls.call(rows, client, tries=30, wait=0.001, in_flight=2).collect()
        assert len(got) == 200 and {r.content for r in got} == {"ok"} and state.served == 200 and state.peak <= 4
    finally:
        http.shutdown()
