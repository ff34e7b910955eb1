"""Counters of a running stream."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from sightline.streaming.topk import spaced_top_stream

SEEN, CHOSEN = "seen", "chosen"


class Progress(StreamingQueryListener):
    """Of each query by name: batches, rows in, and of the top-k stream the rows that came late (dropped), the
    observations that its tracks keep, and tracks touched. spark.streams.addListener(progress) starts it."""

    def __init__(self) -> None:
        self._lock, self.queries = threading.Lock(), {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.queries[event.name] = {"batches": 0, "rows": 0, "kept": 0, "late": 0, "tracks": 0, "ended": False, "id": str(event.id)}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            now = self.queries.setdefault(p.name, {"batches": 0, "rows": 0, "kept": 0, "late": 0, "tracks": 0, "ended": False, "id": str(p.id)})
            seen, chosen = p.observedMetrics.get(SEEN), p.observedMetrics.get(CHOSEN)
            now["batches"] += 1
            now["rows"] += (seen.n or 0) if seen else p.numInputRows
            if chosen:
                now["kept"] += chosen.gained or 0
                now["late"] += chosen.late or 0
                now["tracks"] += chosen.tracks or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            for now in self.queries.values():
                if now["id"] == str(event.id):
                    now["ended"] = True

    def of(self, name: str) -> dict[str, int]:
        with self._lock:
            return dict(self.queries[name])


def counted_top_stream(candidates: DataFrame, k: int = 5, gap: int = 5) -> DataFrame:
    """spaced_top_stream() with the counts that Progress adds up: rows in, and of each batch the late rows, and the change of
    the number of observations kept."""
    seen = candidates.observe(SEEN, F.count(F.lit(1)).alias("n"))
    out = spaced_top_stream(seen, k, gap)
    first = F.col("rank") == 1
    return out.observe(CHOSEN, F.sum(F.when(first, F.col("gained"))).alias("gained"), F.sum(F.when(first, F.col("new_late"))).alias("late"), F.count_if(first).alias("tracks"))
