"""A recognition service with failures, and files that arrive in turn."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from marlstone.sources import ocr
from marlstone.streaming import loads


@pytest.fixture(scope="module")
def server():
    calls = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            name = body.split(b"\r\n\r\n", 1)[1].split(b"\r\n--")[0].decode()
            calls[name] += 1
            bad = {"busy": calls[name] < 3, "gone": True, "refused": True}.get(name, False) or self.headers["Authorization"] != "Bearer k"
            self.send_response((422 if name == "refused" else 503) if bad else 200)
            self.end_headers()
            if not bad:
                self.wfile.write(b"{}" if name == "odd" else json.dumps({"blocks": [{"text": name}, {"type": "table", "text": "t", "page": 2, "confidence": 0.5}]}).encode())

        def log_message(self, *_):
            pass

    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}/", calls
    held.shutdown()


def test_pages_are_tried_one_by_one(spark, server):
    at, calls = server
    files = spark.createDataFrame([(n, None if n == "none" else bytearray(n.encode())) for n in ("a", "busy", "gone", "refused", "odd", "none")], "path string, content binary").repartition(2)
    got = sorted(map(tuple, ocr.recognised(files, ocr.service(at, "k"), wait=0.01, per_second=100).collect()), key=lambda r: (r[0], r[1] or 0))
    good = lambda n, tries: [(n, 0, "other", n, 1, 1.0, tries, None), (n, 1, "table", "t", 2, 0.5, tries, None)]
    assert [r for r in got if r[7] is None] == good("a", 1) + good("busy", 3)
    failed = {r[0]: (r[6], r[7]) for r in got if r[7]}
    assert failed["refused"] == (1, "answer 422") and failed["gone"][0] == 3 and "503" in failed["gone"][1] and failed["odd"][0] == 3 and failed["none"] == (0, "no content")
    assert (calls["a"], calls["busy"], calls["refused"]) == (1, 3, 1)


def test_the_fixed_engine(spark):
    files = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    assert [(r.type, r.page, r.confidence) for r in ocr.recognised(files, ocr.fixed).orderBy("seq").collect()] == [("heading", 1, 1.0), ("paragraph", 1, 1.0), ("table", 2, 1.0)]
    assert ocr.recognised(files.where("false"), ocr.fixed).count() == 0


def test_files_are_loaded_once(spark, tmp_path):
    source, at, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    write = lambda name, text: (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    write("a.txt", "one"), write("deep/b.txt", "two"), write("c.txt", "one"), write("d.bin", "three")
    texts = lambda: sorted(r.text for r in loads.loaded(spark, at).collect())
    assert loads.load_new(spark, source, at, state, "*.txt") >= 1 and texts() == ["one", "two"]
    assert loads.load_new(spark, source, at, state, "*.txt") == 0 and texts() == ["one", "two"]
    write("e.txt", "two"), write("f.txt", "가")
    loads.load_new(spark, source, at, state, "*.txt")
    assert texts() == ["one", "two", "가"] and loads.loaded(spark, at).select("sha256").distinct().count() == 3
