"""Image measures and model stages, as partition-level functions.

A model is any callable that is made once for each partition by a factory, so that it is loaded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def sharpness(gray: np.ndarray) -> float:
    """Variance of the Laplacian (neighbours less four times the pixel, mirrored at the edges)."""
    p = np.pad(gray.astype(np.float64), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def contrast(gray: np.ndarray) -> float:
    return float(gray.astype(np.float64).std())


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by 0, 90, 180 or 270 degrees."""
    if degrees % 90:
        raise ValueError("whole quarters only")
    return np.rot90(image, -degrees // 90)


def measured(images: DataFrame) -> DataFrame:
    """images (id, width, height, content: gray bytes row by row) to id, sharpness, contrast; null for
    content of another size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, w, h, c in zip(b["id"], b["width"], b["height"], b["content"]):
                g = np.frombuffer(c, np.uint8) if c is not None else np.zeros(0, np.uint8)
                out.append((i, *((sharpness(g.reshape(h, w)), contrast(g.reshape(h, w))) if len(g) == w * h and len(g) else (None, None))))
            yield pd.DataFrame(out, columns=["id", "sharpness", "contrast"])

    return images.select("id", "width", "height", "content").mapInPandas(run, "id long, sharpness double, contrast double")


def extracted(rows: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A model stage: factory() gives the model of a partition, which turns a batch of rows into any number
    of rows (detections, readings)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or factory()
            yield model(b)

    return rows.mapInPandas(run, schema)
