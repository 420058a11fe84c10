"""Counters and histograms of a process, their text exposition, a listener of streaming queries, and JSON logs."""

from __future__ import annotations

import bisect
import json
import logging
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming import StreamingQueryListener

SECONDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 60.0)


class Metrics:
    """Metrics by name and labels. All methods may be called from any thread."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._values: dict[tuple, float] = {}
        self._spread: dict[tuple, tuple[list[int], list[float]]] = {}

    @staticmethod
    def _key(name: str, labels: dict) -> tuple:
        return name, tuple(sorted((k, str(v)) for k, v in labels.items()))

    def count(self, name: str, n: float = 1, **labels) -> None:
        with self._lock:
            k = self._key(name, labels)
            self._values[k] = self._values.get(k, 0) + n

    def gauge(self, name: str, value: float, **labels) -> None:
        with self._lock:
            self._values[self._key(name, labels)] = value

    def observe(self, name: str, value: float, **labels) -> None:
        with self._lock:
            buckets, total = self._spread.setdefault(self._key(name, labels), ([0] * (len(SECONDS) + 1), [0.0]))
            buckets[bisect.bisect_left(SECONDS, value)] += 1
            total[0] += value

    @contextmanager
    def timed(self, name: str, **labels) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.observe(name, time.perf_counter() - began, **labels)

    def value(self, name: str, **labels) -> float:
        with self._lock:
            return self._values.get(self._key(name, labels), 0)

    def text(self) -> str:
        """All metrics in the line format that scrapers read."""

        def line(name: str, labels: tuple, value: float) -> str:
            said = ",".join(f"{k}={json.dumps(v)}" for k, v in labels)
            return f"{name}{{{said}}} {value:g}" if said else f"{name} {value:g}"

        with self._lock:
            out = [line(n, labels, v) for (n, labels), v in sorted(self._values.items())]
            for (n, labels), (buckets, total) in sorted(self._spread.items()):
                upto = 0
                for edge, k in zip((*SECONDS, float("inf")), buckets, strict=True):
                    upto += k
                    out.append(line(f"{n}_bucket", (*labels, ("le", "+Inf" if edge == float("inf") else f"{edge:g}")), upto))
                out += [line(f"{n}_count", labels, upto), line(f"{n}_sum", labels, total[0])]
        return "\n".join(out) + "\n"

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        """Serves the text on this machine; ``server_port`` says where, ``shutdown`` ends it."""
        metrics = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                body = metrics.text().encode()
                self.send_response(200)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args) -> None:
                pass

        server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


#: The metrics of this process.
METRICS = Metrics()


class StreamMetrics(StreamingQueryListener):
    """Counts rows and times batches of the streaming queries of a session: ``spark.streams.addListener(StreamMetrics())``."""

    def __init__(self, metrics: Metrics = METRICS) -> None:
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.count("stream_started_total")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.count("stream_rows_total", p.numInputRows)
        self.metrics.count("stream_batches_total")
        self.metrics.observe("stream_batch_seconds", p.durationMs.get("triggerExecution", 0) / 1000)

    def onQueryIdle(self, event) -> None:
        self.metrics.count("stream_idle_total")

    def onQueryTerminated(self, event) -> None:
        self.metrics.count("stream_ended_total", failed=event.exception is not None)


class JsonLines(logging.Formatter):
    """One JSON object per record; fields given as ``extra={"fields": {...}}`` stand beside the message."""

    def format(self, record: logging.LogRecord) -> str:
        doc = {"time": record.created, "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            doc["error"] = self.formatException(record.exc_info)
        return json.dumps(doc | getattr(record, "fields", {}), default=str)
