"""Validation and upsert of human annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import clean_text


def review_counts(rows: DataFrame) -> DataFrame:
    """rows (detections, visible, correct): derived tp, fp, fn; valid tells if correct passes neither."""
    return rows.withColumn("valid", (F.col("correct") <= F.col("detections")) & (F.col("correct") <= F.col("visible")) & (F.col("correct") >= 0)).withColumns(
        {"tp": F.col("correct"), "fp": F.col("detections") - F.col("correct"), "fn": F.col("visible") - F.col("correct")}
    )


def inconsistent(rows: DataFrame) -> DataFrame:
    """Rows whose counts don't add up: tp + fp = detections, tp + fn = visible."""
    return rows.filter("tp + fp <> detections or tp + fn <> visible")


def reading_ok(status: Column | str, text: Column | str, least: int = 5) -> Column:
    s, t = (F.col(x) if isinstance(x, str) else x for x in (status, text))
    return s.isin("UNREADABLE", "NOT_A_PLATE") | ((s == "VERIFIED") & (F.length(t) >= least))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes replace the rows of their keys, and are added where there are none."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_absent(table: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    return table.unionByName(seed.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def next_open(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The first item that has no annotation yet."""
    return items.join(done.select(key), key, "left_anti").orderBy(key).limit(1)


def posted_readings(posts: DataFrame, samples: DataFrame, key: str = "sample_id", least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert, rejected posts with a reason) of posts (key, status, text, ord), checked against samples (key, others).
    Texts are cleaned, and blank unless VERIFIED. The last good post of a key counts (by ord). least: characters of a verified
    text, 5 for samples and 4 for tracks."""
    known = posts.join(samples.withColumn("_known", F.lit(True)), key, "left").withColumn("_clean", clean_text("text"))
    statuses = ("VERIFIED", "UNREADABLE", "NOT_A_PLATE")
    reason = (
        F.when(F.col("_known").isNull(), f"unknown {key}").when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "invalid status")
        .when((F.col("status") == "VERIFIED") & (F.length("_clean") < least), "text too short")
    )
    judged = known.withColumn("reason", reason)
    rows = judged.filter("reason is null").withColumns({"text": F.when(F.col("status") == "VERIFIED", F.col("_clean")).otherwise(""), "annotation_source": F.lit("manual_visual")}).drop("reason", "_known", "_clean")
    others = [c for c in rows.columns if c not in (key, "ord")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), "ord").alias("r")).select(key, "r.*")
    return last, judged.filter("reason is not null").select(*posts.columns, "reason")


def posted_boxes(posts: DataFrame, tasks: DataFrame) -> DataFrame:
    """posts (index, sample_id, boxes: xc, yc, w, h) with reason, the first rule that one breaks, null for none: tasks
    (index, sample_id, expected) must have the index, for the same sample, and expect as many boxes; their numbers lie in 0 to 1
    and their sides are above 0. A post without boxes has none."""
    own = tasks.select("index", F.col("sample_id").alias("_id"), F.col("expected").alias("_n"))
    boxes = F.coalesce("boxes", F.array().cast(posts.schema["boxes"].dataType))
    outside = F.exists(boxes, lambda b: F.exists(F.array(b["xc"], b["yc"], b["w"], b["h"]), lambda v: ~F.coalesce(v.between(0, 1), F.lit(False))))
    reason = (
        F.when(F.col("_id").isNull(), "invalid task index").when(~F.col("sample_id").eqNullSafe(F.col("_id")), "sample mismatch").when(F.size(boxes) != F.col("_n"), F.concat(F.lit("expected "), F.col("_n").cast("string"), F.lit(" boxes")))
        .when(outside, "outside").when(F.exists(boxes, lambda b: (b["w"] <= 0) | (b["h"] <= 0)), "no area")
    )
    return posts.join(own, "index", "left").select(*posts.columns, reason.alias("reason"))


def progress(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: total, completed (items with an annotation), and the key of the next item without one (null if none)."""
    marked = items.select(key).join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("total"), F.count("_done").alias("completed"), F.min(F.when(F.col("_done").isNull(), F.col(key))).alias("next"))


def box_issues(boxes: DataFrame, key: str = "image") -> DataFrame:
    """boxes (image, class, xc, yc, w, h, expected): all that is wrong with an image's boxes, joined by '; '."""
    outside = F.exists(F.array("xc", "yc", "w", "h"), lambda v: (v < 0) | (v > 1))
    per = F.array_compact(F.array(F.when(F.col("class") != 0, "bad class"), F.when(outside, "outside"), F.when((F.col("w") <= 0) | (F.col("h") <= 0), "no area")))
    g = boxes.withColumn("per", per).groupBy(key).agg(F.count("*").alias("n"), F.first("expected").alias("expected"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("per")))).alias("issues"))
    counted = F.when(F.col("n") != F.col("expected"), F.array(F.lit("count"))).otherwise(F.array().cast("array<string>"))
    return g.select(key, F.array_join(F.concat(counted, "issues"), "; ").alias("issues"))


def expect_count(rows: DataFrame, n: int, what: str) -> DataFrame:
    """rows, or an error if there are not n of them."""
    got = rows.count()
    if got != n:
        raise ValueError(f"{what}: {n} rows expected, {got} found")
    return rows
