import json
import sys
import threading
import time
import urllib.error
import urllib.request

import pytest

from samphire.plans import service
from samphire.plans.job import JobRunner
from samphire.sources import tagger


class Quick(JobRunner):
    """Ends at once, waits for cancellation, or fails, by the request's input."""

    def _run(self, request):
        self._enter("validate")
        if request.input_dir == "bad":
            raise FileNotFoundError(request.input_dir)
        while request.input_dir == "slow":
            time.sleep(0.02)
            self._enter("scan")
        self._enter("finalize")
        self.status.outputs = {"tag_metrics_enabled": request.enable_tag_metrics}


@pytest.fixture(autouse=True)
def elsewhere(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)  # jobs write where they are asked to


@pytest.fixture
def url(spark):
    server = service.serve(spark, make_runner=Quick)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ask(url, path, body=None, method=None):
    request = urllib.request.Request(url + path, None if body is None else json.dumps(body).encode(), method=method)
    try:
        with urllib.request.urlopen(request) as reply:
            return reply.status, json.loads(reply.read() or b"null")
    except urllib.error.HTTPError as error:
        return error.code, json.loads(error.read() or b"null")


def finished(url, job):
    for _ in range(200):
        code, told = ask(url, f"/jobs/{job}/result")
        if code == 200:
            return told
        time.sleep(0.02)
    raise AssertionError("not finished")


def test_jobs_over_http(url):
    assert ask(url, "/health")[1]["ok"] and ask(url, "/settings") == (200, {"telemetryEnabled": False, "telemetryMode": "opt-in"})
    assert ask(url, "/settings/telemetry", {"enabled": True}) == (200, {"telemetryEnabled": True})
    code, made = ask(url, "/jobs", {"inputDir": "in", "outputDir": "out", "enableTagMetrics": False, "more": 1})
    assert code == 202
    done = finished(url, made["jobId"])
    assert (done["state"], done["outputs"], done["error"]) == ("Completed", {"tagMetricsEnabled": False}, None)
    status = ask(url, f"/jobs/{made['jobId']}")[1]
    assert (status["percent"], status["isCancelable"]) == (100, False)
    assert [x["message"] for x in ask(url, f"/jobs/{made['jobId']}/logs")[1]["logs"]][0] == "checking the request"
    assert ask(url, f"/jobs/{made['jobId']}/cancel", {})[0] == 404


def test_cancel_failure_and_unknown(url):
    slow = ask(url, "/jobs", {"inputDir": "slow", "outputDir": "o"})[1]["jobId"]
    while ask(url, f"/jobs/{slow}")[1]["state"] != "Running":
        time.sleep(0.01)
    assert ask(url, f"/jobs/{slow}/cancel", {})[1] == {"jobId": slow, "canceled": True}
    assert finished(url, slow)["state"] == "Canceled"
    bad = ask(url, "/jobs", {"inputDir": "bad", "outputDir": "o"})[1]["jobId"]
    assert finished(url, bad)["error"] == "FileNotFoundError"
    assert ask(url, "/jobs", {"inputDir": "x"})[0] == 400 and ask(url, "/jobs/00")[0] == 404 and ask(url, "/none")[0] == 404


def test_tagger(spark):
    script = "import http.server as h\nclass H(h.BaseHTTPRequestHandler):\n  def do_GET(s):\n    s.send_response(200); s.end_headers()\n  def log_message(s,*a): pass\nx=h.HTTPServer(('127.0.0.1',%d),H); x.serve_forever()"
    import socket

    with socket.socket() as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    with tagger.TaggerProcess([sys.executable, "-c", script % port], f"http://127.0.0.1:{port}") as running:
        assert running._process.poll() is None
    with pytest.raises(TimeoutError):
        tagger.wait_until_healthy(f"http://127.0.0.1:{port}", timeout=0.3, period=0.05)
    files = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray())], "path string, content binary")
    assert {r.path: r.tags for r in tagger.tag_images(files, lambda b: [str(len(b))]).collect()} == {"a": ["2"], "b": ["0"]}
