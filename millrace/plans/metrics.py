"""Counters of a session from Spark's status store, as Prometheus text and over HTTP."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

# The counters' names and meanings.
HELP = {
    "task_attempts_total": "Tasks started, each attempt counted.",
    "task_failures_total": "Task attempts that failed.",
    "task_retries_total": "Task attempts after a first one.",
    "task_duration_microseconds_total": "Run time of all task attempts.",
    "network_sent_bytes_total": "Shuffle bytes written.",
    "network_received_bytes_total": "Shuffle bytes read.",
    "spill_written_bytes_total": "Bytes spilled to disk.",
    "spill_read_bytes_total": "Bytes of spills read back: Spark reads each spilled byte once, to merge it.",
    "dispatch_disconnects_total": "Executors lost or removed.",
    "shuffle_map_records_total": "Records written to shuffles.",
}


class Metrics:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _stages(self) -> Iterator:
        sc = self.spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        jvm, gateway = sc._jvm, sc._gateway
        none = gateway.new_array(jvm.double, 0)
        found = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        for i in range(found.size()):
            yield found.apply(i)

    def counters(self) -> dict[str, int]:
        out = dict.fromkeys(HELP, 0)
        for s in self._stages():
            done = s.numCompleteTasks() + s.numFailedTasks() + s.numKilledTasks() + s.numActiveTasks()
            out["task_attempts_total"] += done
            out["task_failures_total"] += s.numFailedTasks()
            out["task_retries_total"] += max(0, done - s.numTasks())
            out["task_duration_microseconds_total"] += s.executorRunTime() * 1000
            out["network_sent_bytes_total"] += s.shuffleWriteBytes()
            out["network_received_bytes_total"] += s.shuffleReadBytes()
            out["spill_written_bytes_total"] += s.diskBytesSpilled()
            out["spill_read_bytes_total"] += s.diskBytesSpilled()
            out["shuffle_map_records_total"] += s.shuffleWriteRecords()
        found = self.spark.sparkContext._jsc.sc().statusStore().executorList(False)
        out["dispatch_disconnects_total"] = sum(not found.apply(i).isActive() for i in range(found.size()))
        return out

    def of_executors(self, metric: str) -> dict[str, int]:
        found = self.spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return {x.id(): int(getattr(x, metric)()) for x in (found.apply(i) for i in range(found.size()))}

    def input_tasks(self) -> int:
        return sum(s.numCompleteTasks() for s in self._stages() if s.inputBytes() > 0)

    def render(self) -> str:
        """Prometheus text format."""
        return "".join(f"# HELP millrace_{k} {HELP[k]}\n# TYPE millrace_{k} counter\nmillrace_{k} {v}\n" for k, v in self.counters().items())


class MetricsServer:
    """GET /metrics on a local port; 404 for all else; ``close`` ends its thread."""

    def __init__(self, metrics: Metrics, host: str = "127.0.0.1", port: int = 0):
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                body = metrics.render().encode() if self.path == "/metrics" else b"not found\n"
                self.send_response(200 if self.path == "/metrics" else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args: object) -> None:
                pass

        self._server = ThreadingHTTPServer((host, port), Handler)
        self._thread = threading.Thread(target=self._server.serve_forever, daemon=True)
        self._thread.start()

    @property
    def address(self) -> tuple[str, int]:
        return self._server.server_address[:2]

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()
        self._thread.join()

    def __enter__(self) -> MetricsServer:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


def task_events(event_log: str | Path) -> Iterator[dict]:
    """task_started and task_finished events of an uncompressed Spark event log, file or folder.

    Each names its job, stage, stage attempt, partition, attempt and executor.
    """
    jobs: dict[int, int] = {}
    at = Path(event_log)
    for file in sorted(p for p in at.rglob("*") if p.is_file() and not p.name.startswith((".", "appstatus"))) if at.is_dir() else [at]:
        for line in file.open():
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                jobs |= dict.fromkeys(e["Stage IDs"], e["Job ID"])
            if e["Event"] in ("SparkListenerTaskStart", "SparkListenerTaskEnd"):
                info = e["Task Info"]
                out = {"event": "task_started", "job": jobs.get(e["Stage ID"]), "stage": e["Stage ID"], "stage_attempt": e.get("Stage Attempt ID", 0), "partition": info["Index"], "attempt": info["Attempt"], "executor": info.get("Executor ID"), "at_ms": info["Launch Time"]}
                if e["Event"].endswith("End"):
                    out |= {"event": "task_finished", "success": not info["Failed"], "duration_us": 1000 * (info["Finish Time"] - info["Launch Time"])}
                yield out
