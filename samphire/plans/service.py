"""Jobs over HTTP: start, look at, cancel, with the standard library's server.

GET /health, GET /settings, POST /settings/telemetry, POST /jobs, GET /jobs/{id}, POST /jobs/{id}/cancel,
GET /jobs/{id}/logs, GET /jobs/{id}/result. Bodies and answers are JSON with names in camel case.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from samphire.plans.job import CANCELED, JobRequest, JobRunner, JobStatus
from samphire.sources.sinks import camel

#: Fields of a request, in camel case.
REQUEST_FIELDS = {camel(f): f for f in JobRequest.__dataclass_fields__}


def _time(at: datetime | None) -> str | None:
    return at.isoformat() if at else None


class JobBoard:
    """Jobs by id. Each runs in a thread of its own; Spark's scheduler shares the cluster among them."""

    def __init__(self, spark: SparkSession, make_runner: Callable[..., JobRunner] = JobRunner):
        self.spark, self._make, self._jobs, self._lock = spark, make_runner, {}, threading.Lock()

    def start(self, request: JobRequest) -> str:
        runner = self._make(self.spark)
        with self._lock:
            self._jobs[runner.status.job_id] = runner

        def work() -> None:
            try:
                runner.run(request)
            except Exception as error:  # its type is in the status; texts may hold paths
                runner.status.log.append((datetime.now(timezone.utc), "Error", f"ended by {type(error).__name__}"))

        threading.Thread(target=work, name=f"job-{runner.status.job_id}", daemon=True).start()
        return runner.status.job_id

    def status(self, job_id: str) -> JobStatus | None:
        with self._lock:
            runner = self._jobs.get(job_id)
        return runner.status if runner else None

    def cancel(self, job_id: str) -> bool:
        with self._lock:
            runner = self._jobs.get(job_id)
        return bool(runner) and runner.cancel()


def told(status: JobStatus) -> dict[str, Any]:
    return {"jobId": status.job_id, "state": status.state, "percent": status.percent, "stage": status.stage, "message": status.message, "createdAtUtc": _time(status.created_at), "updatedAtUtc": _time(status.updated_at), "finishedAtUtc": _time(status.finished_at), "isCancelable": status.is_cancelable}


def answer(board: JobBoard, settings: dict[str, bool], method: str, path: str, body: Any) -> tuple[int, Any]:
    """(HTTP status, JSON) of a request."""
    if (method, path) == ("GET", "/health"):
        return 200, {"ok": True, "telemetryEnabled": settings["telemetry"], "time": _time(datetime.now(timezone.utc))}
    if (method, path) == ("GET", "/settings"):
        return 200, {"telemetryEnabled": settings["telemetry"], "telemetryMode": "opt-in"}
    if (method, path) == ("POST", "/settings/telemetry"):
        settings["telemetry"] = bool((body or {}).get("enabled"))
        return 200, {"telemetryEnabled": settings["telemetry"]}
    if (method, path) == ("POST", "/jobs"):
        try:
            request = JobRequest(**{REQUEST_FIELDS[k]: v for k, v in (body or {}).items() if k in REQUEST_FIELDS})
        except TypeError:
            return 400, {"message": "a request needs inputDir and outputDir"}
        return 202, {"jobId": board.start(request)}
    if not (found := re.fullmatch(r"/jobs/([0-9a-f-]+)(/cancel|/logs|/result)?", path)):
        return 404, None
    job_id, part = found.groups()
    status = board.status(job_id)
    if (method, part) == ("POST", "/cancel"):
        return (200, {"jobId": job_id, "canceled": True}) if board.cancel(job_id) else (404, {"message": "no such job, or it is over"})
    if status is None or method != "GET" or part == "/cancel":
        return 404, None
    if part == "/logs":
        return 200, {"jobId": job_id, "logs": [{"atUtc": _time(at), "level": level, "message": text} for at, level, text in status.log]}
    if part == "/result":
        if status.finished_at is None:
            return 404, None
        error = "canceled" if status.state == CANCELED else status.error
        return 200, {"jobId": job_id, "state": status.state, "outputs": {camel(k): v for k, v in status.outputs.items()}, "error": error, "finishedAtUtc": _time(status.finished_at)}
    return 200, told(status)


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 0, make_runner: Callable[..., JobRunner] = JobRunner) -> ThreadingHTTPServer:
    """A server bound to the address; call serve_forever() on it. Port 0 takes a free one."""
    board, settings = JobBoard(spark, make_runner), {"telemetry": False}

    class Handler(BaseHTTPRequestHandler):
        def _run(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else None
                code, out = answer(board, settings, method, self.path.split("?")[0], body)
            except (ValueError, AttributeError):
                code, out = 400, {"message": "the body is not JSON"}
            raw = b"" if out is None else json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._run("GET")

        def do_POST(self) -> None:
            self._run("POST")

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
