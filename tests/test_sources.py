"""Files, snapshots, the command line, providers over HTTP, and streams."""

import json
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from samples import CSV, PROSE

from brevis.functions.providers import HttpProvider, distill
from brevis.operators import content, memory
from brevis.sources import text
from brevis.streaming import ingest

ROOT = str(Path(__file__).resolve().parents[1])


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("drei ü", encoding="utf-8")
    got = text.read_texts(spark, str(tmp_path / "in"))
    assert sorted(r["text"] for r in got.collect()) == ["drei ü", "one\ntwo\n"]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.collect()) == ["a.txt", "b.txt"]
    text.write_texts(got.select(F.upper("text").alias("compressed")).filter("compressed LIKE 'D%'"), str(tmp_path / "out"))
    assert "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*")) == "DREI Ü\n"


def test_snapshots(spark, tmp_path):
    state = spark.createDataFrame([(1, [{"turn": 0, "role": "user", "content": "hi"}], [{"id": "m0_0", "text": "f", "kind": "fact", "source": {"from": 0, "to": 3}}], 9, 4)], memory.STATE)
    text.save_snapshot(state, str(tmp_path / "s"))
    assert text.load_snapshot(spark, str(tmp_path / "s")).collect() == state.collect()
    state.select("conv_id", "recent").write.parquet(str(tmp_path / "old"))
    row = text.load_snapshot(spark, str(tmp_path / "old")).first()
    assert (row["memories"], row["raw_tokens"], row["ingested"]) == ([], 0, 1)


def run_cli(*args, stdin=None, cwd):
    return subprocess.run([sys.executable, "-m", "brevis", *args], input=stdin, capture_output=True, text=True, cwd=cwd, timeout=180, env={**__import__("os").environ, "PYTHONPATH": ROOT})


def test_command_line(tmp_path):
    (tmp_path / "t.csv").write_text(CSV, encoding="utf-8")
    out = run_cli("t.csv", "--aggressive", cwd=tmp_path)
    assert out.returncode == 0 and out.stdout.splitlines()[0] == "city;zip,country,state" and out.stdout.endswith("… 11 more rows …\n")
    assert "brevis: table · " in out.stderr and "% saved)" in out.stderr
    piped = run_cli("--type=prose", stdin=PROSE, cwd=tmp_path)
    assert piped.stdout.startswith("We saw Danube gauge")
    assert run_cli("missing.txt", cwd=tmp_path).returncode == 1
    assert run_cli("--type=poem", stdin="x", cwd=tmp_path).returncode == 2


class Endpoint(BaseHTTPRequestHandler):
    answers: list = []
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        self.seen.append((body, self.headers["x-api-key"]))
        status = self.answers.pop(0) if self.answers else 200
        self.send_response(status)
        self.end_headers()
        if status == 200:
            self.wfile.write(json.dumps({"content": [{"type": "text", "text": "- a fact\n"}, {"type": "image"}, {"type": "text", "text": "* more \n\n"}]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Endpoint.answers, Endpoint.seen = [], []
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_http_provider(endpoint, monkeypatch):
    p = HttpProvider(endpoint, "some-model", "k", pause=0)
    assert distill("user: hi", p) == ["a fact", "more"]
    body, key = Endpoint.seen[-1]
    assert (body["model"], body["max_tokens"], key) == ("some-model", 512, "k") and body["messages"][0]["content"].endswith("user: hi")
    Endpoint.answers = [503, 429]
    assert p.complete("x").startswith("- a fact") and len(Endpoint.seen) == 4
    for status, asked in ((400, 1), (500, 3)):
        Endpoint.answers, Endpoint.seen[:] = [status] * 5, []
        with pytest.raises(OSError):
            p.complete("x")
        assert len(Endpoint.seen) == asked
    monkeypatch.delenv("BREVIS_API_KEY", raising=False)
    with pytest.raises(ValueError):
        HttpProvider(endpoint, "m")


def test_counters_of_a_stream(spark, tmp_path):
    calls = spark.createDataFrame([(10, 4), (20, 5), (1, 1)], "original_tokens bigint, compressed_tokens bigint")
    for k in range(3):
        calls.limit(k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    assert tuple(ingest.drain_counters(stream).first()) == (6, 10 + 30 + 31, 4 + 9 + 10)
    empty = tmp_path / "none"
    empty.mkdir()
    assert tuple(ingest.drain_counters(spark.readStream.schema(calls.schema).parquet(str(empty))).first()) == (0, 0, 0)


def test_growing_store(spark, tmp_path):
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "k bigint, text string")
    texts.write.parquet(str(tmp_path / "texts"))
    stream = content.store(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "texts")), "k")
    for _ in range(2):
        ingest.append_store(stream, str(tmp_path / "store"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        texts.withColumn("k", F.col("k") + 2).write.mode("append").parquet(str(tmp_path / "texts"))
    found = spark.read.parquet(str(tmp_path / "store"))
    assert sorted((r["handle"], r["original"]) for r in found.collect()) == [("ccr_1", "one"), ("ccr_2", "two"), ("ccr_3", "one"), ("ccr_4", "two")]
