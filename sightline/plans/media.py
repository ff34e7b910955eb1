"""Queries of frame containers, image variants, file digests and placement, and of the curve of all thresholds. Their files
are made from the embeddings: a vector is an image of 8 x 8 gray pixels, a hundred vectors are a video."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.operators import evaluate, images, selection, variants
from sightline.plans import views
from sightline.plans.lineage import shared_dir
from sightline.plans.queries import query
from sightline.plans.views import plain, view
from sightline.sources import frames, store

SIDE, LENGTH = 8, 100


def _pixels(spark, d: str) -> DataFrame:
    """vec_id and 64 gray bytes; entries that a vector lacks, or that are no numbers, are 0."""

    @F.pandas_udf("binary")
    def gray(vectors: pd.Series) -> pd.Series:
        def one(v) -> bytes:
            x = np.zeros(SIDE * SIDE)
            v = np.array([] if v is None else v, dtype=np.float64)[: SIDE * SIDE]
            x[: len(v)] = v
            return np.clip(np.floor((np.nan_to_num(x, posinf=1, neginf=-1) + 1) * 127.5), 0, 255).astype(np.uint8).tobytes()

        return vectors.map(one)

    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select("vec_id", gray(F.coalesce("embedding", F.array().cast("array<float>"))).alias("content"))


def _containers(spark, d: str) -> DataFrame:
    rows = _pixels(spark, d).withColumn("video", F.floor(F.col("vec_id") / LENGTH))
    at = F.row_number().over(Window.partitionBy("video").orderBy("vec_id")) - 1  # a hundred rows
    rows = rows.select("video", at.cast("long").alias("frame"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), "content")
    return frames.write_frames(rows, f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}")


@query
def frame_samples(spark, d):
    """Measures of the frames sampled twice a second, read at random from the containers."""
    made = _containers(spark, d)
    first = made.head()
    folder = first.path.rpartition("/")[0] if first else shared_dir(spark)
    sampled = selection.sample_frames(LENGTH / 30, 2.0, 30.0, LENGTH, spark)
    found = frames.frames_at(spark, folder, sampled)
    ids = (F.regexp_extract("path", r"(\d+)\.y4m$", 1).cast("long") * LENGTH + F.col("frame")).alias("id")
    rows = images.measured(found.select(ids, "width", "height", "content"))
    whole = lambda c: F.round(c * SIDE**4).cast("long")  # noqa: E731  variances of 64 whole numbers, in 4096ths
    return rows.select("id", whole(F.col("sharpness")).alias("sharpness"), whole(F.col("contrast") ** 2).alias("contrast"))


@query
def image_variants(spark, d):
    """A digest of every variant of every image."""
    rows = _pixels(spark, d).select(F.col("vec_id").alias("id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(1).alias("channels"), "content")
    made = variants.variants(rows, "two_line").withColumn("stage", F.lit("two_line")).union(variants.variants(rows, "consensus").withColumn("stage", F.lit("consensus")))
    return made.select("id", "stage", "variant", "width", "height", F.md5("content").alias("digest"))


@query
def container_digests(spark, d):
    made = _containers(spark, d)
    found = store.hashed(made).withColumnRenamed("path", "_p")
    return made.join(found, F.col("path") == F.col("_p")).select(F.col("video").cast("long").alias("video"), "frames", F.col("length").alias("bytes"), "sha256", "md5")


@query
def placed_files(spark, d):
    """Containers placed in folders by split, and what is in place then."""
    made = _containers(spark, d).withColumn("split", F.when(F.col("video").cast("long") % 10 < 8, "train").otherwise("test"))
    folder = f"{shared_dir(spark)}/placed-{uuid.uuid4().hex}"
    done = store.materialised(made.select(F.col("path").alias("source"), F.concat("split", F.lit("/"), "video", F.lit(frames.SUFFIX)).alias("name")), folder, link=False)
    found = store.hashed(done.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"))).select(F.substring("path", len(folder) + 2, 1000).alias("_n"), "sha256")
    return done.join(found, F.col("name") == F.col("_n")).select("name", "mode", F.col("length").alias("bytes"), "sha256")


def _scores(spark, d):
    return view(spark, d, SCORES)


@query
def threshold_curve(spark, d):
    points = evaluate.curve(_scores(spark, d))
    return points.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def curve_point(spark, d):
    point = evaluate.curve_point(evaluate.curve(_scores(spark, d)), 0.95)
    return point.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "reason")


@query
def best_overlap(spark, d):
    runs = view(spark, d, views.COUNTS).groupBy((F.col("id") % 5 / 10 + 0.3).alias("iou")).agg(F.sum("correct").alias("tp"), F.sum("detections").alias("n"), F.sum("visible").alias("v"))
    runs = runs.select("iou", (F.floor(F.col("tp") / F.col("n") * 10) / 10).alias("map50_95"), (F.floor(F.col("tp") / F.col("v") * 20) / 20).alias("map50"), (2 * F.col("tp") / (F.col("n") + F.col("v"))).alias("f1"))
    best = evaluate.best_overlap(runs)
    return best.select(F.round("iou", 3).alias("iou"), F.round("map50_95", 9).alias("map50_95"), F.round("map50", 9).alias("map50"), F.round("f1", 9).alias("f1"))


#: A score with ties, higher for rows that count as true.
SCORES = """
SELECT CAST(CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS DOUBLE) / 8000 + CASE WHEN l_returnflag = 'R' THEN 0.3 ELSE 0.0 END AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS truth FROM {lineitem}"""
_BYTES = "list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((x::DOUBLE + 1) * 127.5))) AS INT))"
_FRAMES = f"f AS (SELECT vec_id // {LENGTH} AS video, row_number() OVER (PARTITION BY vec_id // {LENGTH} ORDER BY vec_id) - 1 AS frame, {_BYTES} AS b FROM embeddings)"
_LAPLACE = "list_transform(range(64), lambda p: b[abs(p // 8 - 1) * 8 + p % 8 + 1] + b[(7 - abs(6 - p // 8)) * 8 + p % 8 + 1] + b[p // 8 * 8 + abs(p % 8 - 1) + 1] + b[p // 8 * 8 + 7 - abs(6 - p % 8) + 1] - 4 * b[p + 1])"
_FILES = f"""{_FRAMES}, c AS (SELECT video, count(*) AS frames, unhex(hex('YUV4MPEG2 W8 H8 F30:1 Cmono' || chr(10)) ||
    string_agg(hex('FRAME' || chr(10)) || array_to_string(list_transform(b, lambda x: printf('%02X', x)), ''), '' ORDER BY frame)) AS content FROM f GROUP BY 1)"""
_POINTS = f"""s AS ({plain(SCORES)}), g AS (SELECT score AS threshold, sum(truth) AS t, count(*) - sum(truth) AS n FROM s GROUP BY 1),
    a AS (SELECT threshold, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(t) OVER () AS BIGINT) AS p FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT threshold, tp, fp, p - tp AS fn, tp / (tp + fp) AS precision, tp / p AS recall FROM a),
    c AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""
_ROUNDED = "threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"
ORACLES: dict[str, str] = {
    "frame_samples": f"""WITH {_FRAMES} SELECT video * {LENGTH} + frame AS id, CAST(round(list_aggregate({_LAPLACE}, 'var_pop') * {SIDE**4}) AS BIGINT) AS sharpness, CAST(round(list_aggregate(b, 'var_pop') * {SIDE**4}) AS BIGINT) AS contrast FROM f WHERE frame % 15 = 0""",
    "container_digests": f"WITH {_FILES} SELECT video, frames, octet_length(content) AS bytes, sha256(content) AS sha256, md5(content) AS md5 FROM c",
    "placed_files": f"WITH {_FILES} SELECT CASE WHEN video % 10 < 8 THEN 'train/' ELSE 'test/' END || video || '.y4m' AS name, 'copy' AS mode, octet_length(content) AS bytes, sha256(content) AS sha256 FROM c",
    "threshold_curve": f"WITH {_POINTS} SELECT {_ROUNDED} FROM c",
    "curve_point": f"""WITH {_POINTS}, k AS (SELECT *, recall >= 0.95 AS ok, max(f1) FILTER (recall >= 0.95) OVER () AS top, max(f1) OVER () AS whole FROM c)
        SELECT {_ROUNDED}, CASE WHEN top IS NULL THEN 'highest F1; no recall of 0.95' ELSE 'highest F1 with recall of 0.95 or more' END AS reason FROM k
        WHERE CASE WHEN top IS NULL THEN f1 = whole ELSE ok AND abs(f1 - top) <= 1e-8 + 1e-5 * top END ORDER BY CASE WHEN top IS NULL THEN 0 ELSE k.precision END DESC, threshold LIMIT 1""",
    "best_overlap": f"""WITH r AS (SELECT id % 5 / 10 + 0.3 AS iou, sum(correct) AS tp, sum(detections) AS n, sum(visible) AS v FROM ({plain(views.COUNTS)}) GROUP BY 1),
        m AS (SELECT iou, floor(tp / n * 10) / 10 AS map50_95, floor(tp / v * 20) / 20 AS map50, 2 * tp / (n + v) AS f1 FROM r)
        SELECT round(iou, 3) AS iou, round(map50_95, 9) AS map50_95, round(map50, 9) AS map50, round(f1, 9) AS f1 FROM m ORDER BY m.map50_95 DESC, m.map50 DESC, m.f1 DESC, m.iou LIMIT 1""",
}
