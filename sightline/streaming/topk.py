"""Spaced top-k selection as a stream: the state of a track is its kept observations.

Frames of a track must arrive in order; within one micro-batch rows are sorted by (frame, seq). A row whose
frame is before the last one seen is late: it is dropped and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "track_id long, rank int, frame long, seq long, score double, late long, gained long, new_late long"
STATE = "frames array<bigint>, seqs array<bigint>, scores array<double>, last bigint, late bigint"


def fold(kept: list[tuple[int, int, float]], frame: int, seq: int, score: float, k: int, gap: int) -> list[tuple[int, int, float]]:
    """One more observation: it replaces the first kept one that is near if its score is higher, or is
    added if none is near; the list stays in order of score and is cut to k."""
    near = next((i for i, x in enumerate(kept) if abs(x[0] - frame) < gap), None)
    if near is None:
        kept = [*kept, (frame, seq, score)]
    elif score > kept[near][2]:
        kept = [*kept[:near], (frame, seq, score), *kept[near + 1 :]]
    return sorted(kept, key=lambda x: -x[2])[:k]


def spaced_top_stream(candidates: DataFrame, k: int = 5, gap: int = 5) -> DataFrame:
    """candidates (track_id, frame, seq, score), streaming: after each micro-batch the current selection of
    every track that it touched (update mode), with its late rows so far, and of this batch the observations gained and
    the late rows."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, last, late = [], None, 0
        if state.exists:
            frames, seqs, scores, last, late = state.get
            kept = list(zip(frames, seqs, scores))
        before, late_before = len(kept), late
        rows = sorted(x for b in batches for x in zip(b["frame"].tolist(), b["seq"].tolist(), b["score"].tolist()))
        for frame, seq, score in rows:
            if last is not None and frame < last:
                late += 1
                continue
            last = frame
            kept = fold(kept, frame, seq, score, k, gap)
        state.update(([x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept], last, late))
        yield pd.DataFrame([(key[0], i, *x, late, len(kept) - before, late - late_before) for i, x in enumerate(kept, 1)], columns=["track_id", "rank", "frame", "seq", "score", "late", "gained", "new_late"])

    return candidates.groupBy("track_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
