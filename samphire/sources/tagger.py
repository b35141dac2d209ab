"""An external tagger: its process, its health, and tags for images through it."""

from __future__ import annotations

import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: How long a tagger may take to start, and how often it is asked.
START_SECONDS, ASK_SECONDS = 20.0, 0.3


def wait_until_healthy(url: str, timeout: float = START_SECONDS, period: float = ASK_SECONDS) -> None:
    """Return once ``url``/health answers with success; TimeoutError if it doesn't in time."""
    until = time.monotonic() + timeout
    while time.monotonic() < until:
        try:
            with urllib.request.urlopen(f"{url.rstrip('/')}/health", timeout=period + 1) as reply:
                if 200 <= reply.status < 300:
                    return
        except OSError:
            pass
        time.sleep(period)
    raise TimeoutError("The tagger's health check timed out.")


class TaggerProcess:
    """A tagger that runs beside the driver, as a context: started and healthy inside, stopped after."""

    def __init__(self, command: Sequence[str], url: str, timeout: float = START_SECONDS):
        self.command, self.url, self.timeout, self._process = list(command), url, timeout, None

    def __enter__(self) -> TaggerProcess:
        if self._process is None or self._process.poll() is not None:
            self._process = subprocess.Popen(self.command, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        try:
            wait_until_healthy(self.url, self.timeout)
        except BaseException:
            self.__exit__()
            raise
        return self

    def __exit__(self, *_: object) -> None:
        if self._process is not None:
            self._process.kill()
            self._process.wait()
            self._process = None


def tag_images(files: DataFrame, tagger: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, tags) of binary files (path, content): ``tagger`` gets each file's bytes, in batches, on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "tags": [list(tagger(bytes(b))) for b in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, tags array<string>")
