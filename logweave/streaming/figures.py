"""Running figures of a stream: events so far, events per second in each interval, time of the last event."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logweave.functions.times import epoch_seconds


class LiveFigures:
    """Figures of one stream on the driver, reported once an interval whether events come or not.

    Batches are counted by their tasks while they are written (:meth:`observed`, no extra pass) and noted under their id,
    so a batch that is replayed counts once. The rate is (events - events at the last report) divided by the interval, whole numbers;
    an interval in which no batch ends reports 0. ``clock`` gives epoch seconds.
    """

    def __init__(self, interval_seconds: int, emit: Callable[[dict], None], clock: Callable[[], float] = time.time):
        self.interval_seconds, self.emit, self.clock = interval_seconds, emit, clock
        self._lock, self._stopped = threading.Lock(), threading.Event()
        self._total, self._reported, self._last, self._last_batch = 0, 0, None, -1
        self._timer: threading.Thread | None = None

    def observed(self, df: DataFrame, ts: str = "event_ts") -> tuple[DataFrame, Observation]:
        """``df`` as it is, and what the first action that reads all of it saw."""
        seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("events"), F.max(epoch_seconds(F.col(ts))).alias("last")), seen

    def took(self, batch_id: int, seen: Observation) -> None:
        """Note a batch whose rows are written."""
        found = seen.get
        with self._lock:
            if batch_id > self._last_batch:
                self._last_batch = batch_id
                self._total += found["events"]
                if found["last"] is not None:
                    self._last = found["last"] if self._last is None else max(self._last, found["last"])

    def report(self) -> None:
        """Close an interval and emit its figures: events, total, avg_per_second, last_event and lag_seconds (none before the first event)."""
        with self._lock:
            events, self._reported = self._total - self._reported, self._total
            lag = None if self._last is None else int(self.clock()) - self._last
            figures = {
                "events": events, "total": self._total, "avg_per_second": events // self.interval_seconds,
                "last_event": self._last, "lag_seconds": lag,
            }
        self.emit(figures)

    def __enter__(self) -> LiveFigures:
        """Report by a timer until left."""

        def run() -> None:
            while not self._stopped.wait(self.interval_seconds):
                self.report()

        self._stopped.clear()
        self._timer = threading.Thread(target=run, daemon=True)
        self._timer.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stopped.set()
        self._timer.join()
