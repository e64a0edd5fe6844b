"""Health of the engine by polling, and continuous counts of a check's violations."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seconds.
TIMEOUT, INTERVAL = 5.0, 15.0
_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


@dataclass
class Metrics:
    """up, connected, failures, last success and a histogram of durations, in the text format of Prometheus."""

    up: int = 1
    connected: int = 0
    failures: int = 0
    last_ok: float = 0.0
    #: Durations up to each bound and beyond all, and their sum: nothing grows with the time that it runs.
    buckets: list[int] = field(default_factory=lambda: [0] * (len(_BOUNDS) + 1))
    seconds: float = 0.0

    def record(self, ok: bool, seconds: float, now: float | None = None) -> None:
        self.connected = int(ok)
        self.buckets[bisect_left(_BOUNDS, seconds)] += 1
        self.seconds += seconds
        if ok:
            self.last_ok = time.time() if now is None else now
        else:
            self.failures += 1

    def text(self) -> str:
        lines = [f"graph_up {self.up}", f"graph_connected {self.connected}", f"graph_health_failures_total {self.failures}", f"graph_last_success_timestamp_seconds {self.last_ok}"]
        upto = list(accumulate(self.buckets))
        lines += [f'graph_health_duration_seconds_bucket{{le="{b:g}"}} {n}' for b, n in zip(_BOUNDS, upto)]
        lines += [f'graph_health_duration_seconds_bucket{{le="+Inf"}} {upto[-1]}', f"graph_health_duration_seconds_sum {self.seconds}", f"graph_health_duration_seconds_count {upto[-1]}"]
        return "\n".join(lines) + "\n"


def check_health(spark: SparkSession, timeout: float = TIMEOUT) -> bool:
    """Does a trivial query come back in time?"""
    found: list = []

    def ask():
        try:
            found.append(spark.sql("SELECT 1 AS ok").first()["ok"] == 1)
        except Exception:  # an engine that answers with an error is not healthy
            found.append(False)

    worker = threading.Thread(target=ask, daemon=True)
    worker.start()
    worker.join(timeout)
    return bool(found and found[0])


def monitor(spark: SparkSession, metrics: Metrics, stop: threading.Event, interval: float = INTERVAL, timeout: float = TIMEOUT) -> None:
    """Polls until told to stop."""
    while not stop.is_set():
        began = time.monotonic()
        metrics.record(check_health(spark, timeout), time.monotonic() - began)
        stop.wait(interval)


def violation_counts(stream: DataFrame, violation: Column, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, population and violations of a predicate over a stream of nodes; rows later than `late` are left out."""
    counts = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window)).agg(F.count("*").alias("population"), F.count_if(violation).alias("violation_count"))
    return counts.select(F.col("window.start").alias("window_start"), "population", "violation_count")


def start_monitor_stream(counts: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Hands each closed window to sink(rows, batch id); the checkpoint makes a restart go on where it stopped."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
