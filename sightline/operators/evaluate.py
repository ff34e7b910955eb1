"""Accuracy, error rates, detection metrics, bounds and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.metrics import f1, prf, safe_div
from sightline.operators.prefix import ranked, running
from sightline.plans.lineage import cut


def detection_metrics(rows: DataFrame, by: str | None = None) -> DataFrame:
    """tp, fp, fn summed, and precision, recall, f1: for each value of `by` and, in the same pass, for all
    (where it is null)."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    total = rows.rollup(by).agg(*sums) if by else rows.agg(*sums)
    return total.withColumns({k: F.round(v, 9) for k, v in prf("tp", "fp", "fn").items()})


def reading_metrics(rows: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Exact share, micro character error rate (edits over truth characters) and blank share."""
    edits = F.levenshtein(F.col(pred), F.col(truth))
    return rows.agg(
        F.count("*").alias("n"), F.sum((F.col(pred) == F.col(truth)).cast("int")).alias("exact"), F.round(F.avg((F.col(pred) == F.col(truth)).cast("int")), 9).alias("accuracy"),
        F.sum(edits).alias("edits"), F.round(F.sum(edits) / F.sum(F.length(truth)), 9).alias("cer"), F.round(F.avg((F.col(pred) == "").cast("int")), 9).alias("blank_rate"),
    )


def evidence_bounds(rows: DataFrame) -> DataFrame:
    """rows (detections, visible): what must be wrong whatever matches, and the metrics at best."""
    d, v = F.col("detections"), F.col("visible")
    sums = rows.agg(
        F.sum(F.when(v == 0, d).otherwise(0)).alias("guaranteed_fp"), F.sum(F.when(d == 0, v).otherwise(0)).alias("guaranteed_fn"),
        F.sum(F.least(d, v)).alias("max_tp"), F.sum(d).alias("n_det"), F.sum(v).alias("n_vis"),
    )
    sums = sums.withColumn("min_fp", F.col("n_det") - F.col("max_tp")).withColumn("min_fn", F.col("n_vis") - F.col("max_tp"))
    return sums.withColumns({f"best_{k}": F.round(x, 9) for k, x in prf("max_tp", "min_fp", "min_fn").items()})


def sweep(rows: DataFrame, thresholds: list[float], score: str = "score", truth: str = "truth") -> DataFrame:
    """tp, fp, fn and metrics at each threshold, in one pass: conditional sums, no join."""
    s, t = F.col(score), F.col(truth) == 1
    aggs = []
    for i, x in enumerate(thresholds):
        hit = s >= x
        aggs += [F.sum((hit & t).cast("int")).alias(f"tp{i}"), F.sum((hit & ~t).cast("int")).alias(f"fp{i}"), F.sum((~hit & t).cast("int")).alias(f"fn{i}")]
    one = rows.agg(*aggs)
    packed = F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, x in enumerate(thresholds)])
    return one.select(F.inline(packed)).withColumns({k: F.round(v, 9) for k, v in prf("tp", "fp", "fn").items()})


def operating_point(points: DataFrame, least_recall: float) -> DataFrame:
    """The point of highest F1 (then precision, then lowest threshold) among those of enough recall; among
    all, if none has."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct((F.col("recall") >= least_recall).alias("ok"), "f1", "precision", (-F.col("threshold")).alias("t")))
    return points.agg(best.alias("p")).select("p.*")


def curve(rows: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """threshold, tp, fp, fn, precision, recall and f1 at every score that occurs: rows of that score or above are taken. Equal
    scores are summed first, then totals run over ranges of scores: no grid, and no task that orders all scores. Rows without
    a score are never taken, but those that are true count as missed."""
    is_true = F.coalesce((F.col(truth) == 1).cast("long"), F.lit(0))
    each = cut(rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(is_true).alias("t"), F.sum(1 - is_true).alias("f")))
    positives = each.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n")).first().n
    points = running(each.filter("threshold is not null"), [F.col("threshold").desc()], {"tp": F.col("t"), "fp": F.col("f")})
    points = points.select("threshold", "tp", "fp", (F.lit(positives) - F.col("tp")).alias("fn"))
    return points.withColumns(prf("tp", "fp", "fn"))


def curve_point(points: DataFrame, least_recall: float) -> DataFrame:
    """The point of a curve (in one row, with the reason) of highest F1 among those of enough recall; of those as close to that
    F1 as a float comparison would let pass (a hundred-thousandth of it and 1e-8), the one of highest precision, then of
    lowest threshold. If none has enough recall: that of highest F1, then lowest threshold."""
    points = cut(points)
    ok = F.col("recall") >= least_recall
    top = points.agg(F.max(F.when(ok, F.col("f1"))).alias("kept"), F.max("f1").alias("any")).first()
    low = (-F.col("threshold")).alias("t")
    if top.kept is not None:
        near = points.filter(ok & (F.abs(F.col("f1") - top.kept) <= 1e-8 + 1e-5 * abs(top.kept)))
        best, why = F.struct("precision", low), f"highest F1 with recall of {least_recall} or more"
    else:
        near, best, why = points.filter(F.col("f1") == top.any), F.struct(low), f"highest F1; no recall of {least_recall}"
    point = near.agg(F.max_by(F.struct(*points.columns), best).alias("p")).filter("p is not null")
    return point.select("p.*", F.lit(why).alias("reason"))


def best_overlap(runs: DataFrame) -> DataFrame:
    """Of runs (iou, map50_95, map50, f1) the one of highest map50_95, then map50, then f1, then of lowest iou."""
    best = F.max_by(F.struct(*runs.columns), F.struct("map50_95", "map50", "f1", (-F.col("iou")).alias("i")))
    return runs.agg(best.alias("p")).filter("p is not null").select("p.*")


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n and `value`: sorted[n // 2] of each group, by repeated histograms: no group is gathered, however large."""
    return ranked(rows, group, value, F.floor(F.col("n") / 2))


def weighted_confidence(conf: str, text: str) -> Column:
    """Mean confidence weighted by characters."""
    n = F.length(text)
    return safe_div(F.sum(F.col(conf) * n), F.sum(n))


def last_per_group(rows: DataFrame, group: str, order: str, *cols: str) -> DataFrame:
    return rows.groupBy(group).agg(F.max_by(F.struct(order, *cols), F.col(order)).alias("r")).select(group, "r.*")


def rejects(bounds: DataFrame, precision: float, recall: float, f: float) -> DataFrame:
    """Whether even the best case is below a baseline in all three metrics."""
    return bounds.withColumn("reject", (F.col("best_precision") < precision) & (F.col("best_recall") < recall) & (F.col("best_f1") < f))


__all__ = [
    "best_overlap", "curve", "curve_point", "detection_metrics", "evidence_bounds", "f1", "last_per_group", "operating_point", "reading_metrics", "rejects", "sweep", "upper_medians", "weighted_confidence",
]
