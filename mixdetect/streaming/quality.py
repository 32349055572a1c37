"""Quality counts of a scoring stream, delivered with each micro-batch's progress."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.quality import observed
from ..plans.detector import DetectorModel

METRICS = "mixdetect_quality"


def score_stream_observed(model: DetectorModel, stream: DataFrame, name: str = METRICS) -> DataFrame:
    """The scored stream with its quality metrics under ``name``; no second pass and no state."""
    return observed(model.transform(stream), model.spec, model.layout, name)


class QualityListener(StreamingQueryListener):
    """Adds up the quality counts of the streams that observe ``name``.

    ``spark.streams.addListener(listener)`` before the query starts.  Counts
    are kept per query run and batch, so a batch that is reported again counts
    once; ``alert`` (optional) is called with (batch id, counts) of every batch
    whose share of dirty rows is above ``max_dirty``.
    """

    def __init__(self, name: str = METRICS, max_dirty: float = 1.0, alert=None):
        self.name, self.max_dirty, self.alert = name, max_dirty, alert
        self._lock = threading.Lock()
        self._totals: dict[str, dict[str, int]] = {}
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = (progress.observedMetrics or {}).get(self.name)
        if row is None:
            return
        counts = {k: int(v or 0) for k, v in row.asDict().items()}
        run = str(progress.runId)
        with self._lock:
            if progress.batchId <= self._last.get(run, -1):
                return
            self._last[run] = progress.batchId
            totals = self._totals.setdefault(run, {})
            for k, v in counts.items():
                totals[k] = totals.get(k, 0) + v
        if self.alert is not None and counts["n_dirty"] > self.max_dirty * counts["n_rows"]:
            self.alert(progress.batchId, counts)

    def totals(self, run_id: str | None = None) -> dict[str, int]:
        """Counts of one query run, or of all."""
        with self._lock:
            runs = [self._totals.get(run_id, {})] if run_id is not None else list(self._totals.values())
        out: dict[str, int] = {}
        for counts in runs:
            for k, v in counts.items():
                out[k] = out.get(k, 0) + v
        return out
