"""Selection of the best observations of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spaced_top(candidates: DataFrame, track: str = "track_id", k: int = 5, gap: int = 5) -> DataFrame:
    """Up to k observations of each track, at least `gap` frames apart as they arrive in order of (frame,
    seq): one that is near a kept one replaces the first such only if its score is higher. The list is kept
    in order of score (stable) and cut to k after each step. A fold in one expression, so a track is one
    row of (frame, seq, score) structs; nothing else is gathered."""
    items = F.array_sort(F.collect_list(F.struct("frame", "seq", "score")))
    empty = F.array().cast("array<struct<frame:bigint,seq:bigint,score:double>>")
    # only positions and scores matter, and score ties keep their order

    def step(kept: Column, x: Column) -> Column:
        near = F.transform(F.filter(F.transform(kept, lambda e, i: F.struct(e["frame"].alias("f"), i.alias("i"), e["score"].alias("s"))), lambda e: F.abs(e["f"] - x["frame"]) < gap), lambda e: e)
        first = F.get(near, F.lit(0))
        one = F.array(F.struct(x["frame"].cast("long").alias("frame"), x["seq"].cast("long").alias("seq"), x["score"].cast("double").alias("score")))
        swapped = F.transform(kept, lambda e, i: F.when(i == first["i"], F.get(one, F.lit(0))).otherwise(e))
        new = F.when(first.isNull(), F.concat(kept, one)).when(x["score"] > first["s"], swapped).otherwise(kept)
        order = F.array_sort(F.transform(new, lambda e, i: F.struct((-e["score"]).alias("s"), i.alias("i"), e.alias("e"))))
        return F.slice(F.transform(order, lambda o: o["e"]), 1, k)

    done = candidates.groupBy(track).agg(F.aggregate(items, empty, step).alias("kept"))
    return done.select(track, F.posexplode("kept").alias("at", "e")).select(track, (F.col("at") + 1).alias("rank"), "e.frame", "e.seq", "e.score")


def best_per_source(rows: DataFrame, source: str, score: str, ord_col: str) -> DataFrame:
    """One row for each source: the highest score, first seen on a tie."""
    w = Window.partitionBy(source).orderBy(F.desc(score), ord_col)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows of all; an error later than this if there are fewer is the caller's choice."""
    return rows.orderBy(*order).limit(n)


def sample_frames(duration: float, rate: float, fps: float, total: int, spark) -> DataFrame:
    """Frame indices sampled at a rate: banker's rounding of t * fps, those inside the video, ascending."""
    n = int(duration * rate) + 1
    return spark.range(n).select(F.bround(F.col("id") / F.lit(rate) * F.lit(fps)).cast("long").alias("frame")).filter(F.col("frame") < total).distinct().orderBy("frame")
