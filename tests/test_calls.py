"""Model calls: retries, errors as rows, answers that outlive tasks and runs, images, and a service over HTTP."""

import http.server
import json
import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import calls

ONE = {"tasks": 1, "at_once": 2, "pause": 0.0}


class Third:
    """Fails every third call of a worker, and writes down what it is asked."""

    def __init__(self, folder, kill=None):
        self.folder, self.kill, self.n = str(folder), kill, 0

    def send(self, request):
        self.n += 1
        if self.n % 3 == 0:
            raise calls.Refused(503, "busy")
        text = json.loads(request)["messages"][-1]["content"]
        with open(f"{self.folder}/{os.getpid()}-{threading.get_ident()}", "a") as f:
            f.write(text + "\n")
        if self.kill and text == "q7" and not os.path.exists(self.kill):
            Path(self.kill).write_text("once")
            os._exit(1)  # the worker dies, as with a lost executor
        return json.dumps({"choices": [{"message": {"content": text.upper()}}]})


def requests(spark, n):
    rows = spark.createDataFrame([(i, f"q{i % 20}" if i != 3 else None) for i in range(n)], "id long, q string")
    return rows.withColumn("request", calls.chat_request(F.lit("m"), F.lit("s"), F.col("q")))


def asked(folder):
    return sorted(x for f in Path(folder).iterdir() for x in f.read_text().split())


def test_failures_are_retried_and_nothing_is_asked_twice(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = str(tmp_path / "store")
    done = calls.answered(requests(spark, 50), "request", store, Third(log), **ONE).collect()
    assert {(r.id, r.answer, r.error) for r in done} == {(i, f"Q{i % 20}" if i != 3 else None, None) for i in range(50)} and len(done) == 50
    assert max(r.attempts or 0 for r in done) >= 2 and asked(log) == sorted(f"q{i}" for i in range(20))
    again = calls.answered(requests(spark, 60), "request", store, Third(log), **ONE)  # a later run asks nothing it knows
    assert again.filter("answer is null").count() == 1 and len(asked(log)) == 20
    assert not os.path.exists(f"{store}/journal")


def test_answers_outlive_a_killed_task(tmp_path):
    """In a session that repeats failed tasks: a worker dies in the middle, and what had been answered is read, not asked."""
    import subprocess
    import sys

    script = f"""
import sys; sys.path[:0] = [{str(Path(__file__).parents[1])!r}, {str(Path(__file__).parent)!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2, 3]").config("spark.ui.enabled", "false").getOrCreate()
from quarry.operators import calls
from test_calls import Third, requests
log = {str(tmp_path / "log")!r}
done = calls.answered(requests(spark, 50), "request", {str(tmp_path / "store")!r}, Third(log, {str(tmp_path / "killed")!r}), tasks=1, at_once=1, pause=0.0).collect()
assert sorted((r.id, r.answer or "") for r in done) == [(i, f"Q{{i % 20}}" if i != 3 else "") for i in range(50)]
"""
    (tmp_path / "log").mkdir()
    env = os.environ | {"PYTHONPATH": f"{Path(__file__).parents[1]}:{Path(__file__).parent}:{os.environ.get('PYTHONPATH', '')}"}
    run = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert (tmp_path / "killed").exists()
    assert sorted(asked(tmp_path / "log")) == sorted([*(f"q{i}" for i in range(20)), "q7"])  # only the one under way when it died


def test_errors_are_rows_and_are_asked_again(spark, tmp_path):
    class Never:
        def send(self, request):
            text = json.loads(request)["messages"][-1]["content"]
            if text == "q1":
                raise calls.Refused(401, "who are you")
            return "no JSON" if text == "q2" else json.dumps({"choices": [{"message": {"content": "x"}}]})

    store = str(tmp_path / "store")
    done = {r.q: r for r in calls.answered(requests(spark, 6), "request", store, Never(), **ONE).collect()}
    assert (done["q1"].error, done["q1"].attempts, done["q1"].answer) == ("401: who are you", 1, None)
    assert done["q2"].error.startswith("unreadable answer") and done["q2"].attempts == 3
    assert done["q4"].answer == "x" and done[None].answer is None and done[None].error is None
    later = {r.q: r.answer for r in calls.answered(requests(spark, 6), "request", store, Third(tmp_path), **ONE).collect()}
    assert later["q1"] == "Q1" and later["q4"] == "x"


def test_objects_and_vectors():
    chat = lambda text: json.dumps({"choices": [{"message": {"content": text}}]})
    assert json.loads(calls.object_answer(chat('Here:\n```json\n{"a": [1, {"b": "}"}]}\n```'))) == {"a": [1, {"b": "}"}]}
    assert json.loads(calls.object_answer(chat('{broken {"é": 1}'))) == {"é": 1}
    with pytest.raises(ValueError):
        calls.object_answer(chat("[1]"))
    assert calls.embedding_of('{"data": [{"index": 0, "embedding": [1, 2.5]}]}') == "[1, 2.5]"
    for bad in ('{"data": [{"embedding": []}]}', '{"data": [{"embedding": ["x"]}]}'):
        with pytest.raises(ValueError):
            calls.embedding_of(bad)


def test_requests_are_well_formed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(b"\x89PNG\x00")
    (tmp_path / "in/b.JPG").write_bytes(b"x")
    urls = {r.path.rpartition("/")[2]: r.url for r in calls.image_urls(spark, str(tmp_path / "in"), "*.{png,JPG}").collect()}
    assert urls == {"a.png": "data:image/png;base64,iVBORwA=", "b.JPG": "data:image/jpeg;base64,eA=="}
    row = spark.createDataFrame([('say "é"\n', ["u1", "u2"])], "q string, images array<string>")
    q = F.col("q")
    plain, shown, embed = row.select(calls.chat_request(F.lit('m"'), F.lit("s"), q, as_object=True), calls.chat_request(F.lit("m"), F.lit("s"), q, F.col("images")), calls.embed_request(F.lit("e"), q)).head()
    assert json.loads(plain) == {"model": 'm"', "temperature": 0.2, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": 'say "é"\n'}], "response_format": {"type": "json_object"}}
    assert json.loads(shown)["messages"][1]["content"] == [{"type": "text", "text": 'say "é"\n'}, {"type": "image_url", "image_url": {"url": "u1"}}, {"type": "image_url", "image_url": {"url": "u2"}}]
    assert json.loads(embed) == {"model": "e", "input": 'say "é"\n'}


def test_over_http(spark, tmp_path):
    class Service(http.server.BaseHTTPRequestHandler):
        n = 0

        def do_POST(self):  # noqa: N802
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Service.n += 1
            busy = Service.n == 1
            self.send_response(503 if busy else 401 if self.headers["Authorization"] != "Bearer k" else 200)
            self.end_headers()
            self.wfile.write(b"busy" if busy else json.dumps({"data": [{"embedding": [len(said["input"]), 0.5]}]}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("a",), ("bcd",), (None,)], "t string").withColumn("request", calls.embed_request(F.lit("e"), F.col("t")))
    url = f"http://127.0.0.1:{server.server_port}/"
    done = calls.answered(rows, "request", str(tmp_path / "s"), calls.Http(url, lambda: "k"), reads=calls.embedding_of, **ONE)
    assert sorted(((r.t or ""), r.v) for r in done.select("t", calls.vectors(F.col("answer")).alias("v")).collect()) == [("", None), ("a", [1.0, 0.5]), ("bcd", [3.0, 0.5])]
    assert asked_error(spark, tmp_path, calls.Http(url)) == "401"
    server.shutdown()
    server.server_close()
    assert asked_error(spark, tmp_path, calls.Http(url, timeout=2)) == "no connection"


def asked_error(spark, tmp_path, transport):
    rows = spark.createDataFrame([("zz",)], "t string").withColumn("request", calls.embed_request(F.lit("e"), F.col("t")))
    return calls.answered(rows, "request", str(tmp_path / "other"), transport, reads=calls.embedding_of, **ONE).head().error.partition(":")[0]
