"""Tickets and sequences fetched from a server."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from strandline.functions.coords import parse_region
from strandline.sources import bam, bgzf, detect, remote

HEADER = bam.Header("@HD\tVN:1.6\n", [("sq0", 100)])
DATA = bgzf.compress(bam.header_bytes(HEADER) + b"".join(bam.encode({"name": f"r{i}", "flags": 0, "ref_id": 0, "pos": i + 1, "sequence": "ACGT"}) for i in range(50)))


class Handler(BaseHTTPRequestHandler):
    failures = {"left": 2}

    def do_GET(self):  # noqa: N802
        url = urlparse(self.path)
        base = f"http://127.0.0.1:{self.server.server_address[1]}"
        if url.path == "/reads/x":
            body = json.dumps({"htsget": {"format": "BAM", "urls": [{"url": "data:;base64," + __import__("base64").b64encode(DATA[:40]).decode()}, {"url": f"{base}/rest", "headers": {"X-Key": "k"}}]}})
        elif url.path == "/rest" and self.headers.get("X-Key") == "k":
            if self.failures["left"]:
                self.failures["left"] -= 1
                self.send_error(503)
                return
            self.answer(DATA[40:])
            return
        elif url.path.startswith("/sequence/"):
            q = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
            body = ("ACGTACGTTT" * 3)[q.get("start", 0) : q.get("end")]
        else:
            self.send_error(404)
            return
        self.answer(body.encode())

    def answer(self, body):
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_tickets_become_files(spark, server, tmp_path):
    folder = f"file://{tmp_path}/x"
    paths = remote.htsget(spark, [remote.htsget_url(server, "reads", "x", [parse_region("sq0:1-9")], "BAM")], folder, "bam")
    assert len(paths) == 1
    rows = detect.read_alignments(spark, folder).collect()
    assert sorted(r["pos"] for r in rows) == list(range(1, 51))
    with pytest.raises(Exception, match="404"):
        remote.htsget(spark, [f"{server}/reads/none"], folder, "bam")


def test_sequences(spark, server):
    df = spark.createDataFrame([("a", 2, 5), ("a", None, None), ("b", 29, None)], "id string, start bigint, end bigint")
    assert sorted(r["sequence"] for r in remote.refget(df, server).collect()) == sorted(["CGTA", "ACGTACGTTT" * 3, "TT"])
