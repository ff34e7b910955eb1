"""Guarded ratios and detection metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import _c


def safe_div(a, b) -> Column:
    return F.when(_c(b) != 0, _c(a) / _c(b)).otherwise(0.0)


def f1(precision, recall) -> Column:
    p, r = _c(precision), _c(recall)
    return safe_div(2 * p * r, p + r)


def prf(tp, fp, fn) -> dict[str, Column]:
    tp, fp, fn = map(_c, (tp, fp, fn))
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": f1(p, r)}


def fps(ms) -> Column:
    return F.when(_c(ms) > 0, 1000.0 / _c(ms)).otherwise(0.0)
