"""Votes over repeated observations, ranking of candidates, fragments, and evidence status.

Each generation of the consensus has rules of its own; they are separate functions on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.text import longest_common_substring, min_fragment, mixed_alphanumeric


def with_clusters(obs: DataFrame, mapping: DataFrame, track: str = "track_id") -> DataFrame:
    """cluster_id of each observation's track; a track without one is its own cluster."""
    m = mapping.select(F.col(track).alias("_t"), F.col("cluster_id").alias("_c"))
    return obs.join(m, F.col(track) == F.col("_t"), "left").withColumn("cluster_id", F.coalesce("_c", track)).drop("_t", "_c")


def is_first(*keys: str) -> Column:
    """Whether a row is the one that counts of all with the same keys: for counts of distinct values where rows lie together by
    the first key, without a copy of each row for each count."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(keys[-1])) == 1


def votes(obs: DataFrame) -> DataFrame:
    """obs (cluster_id, plate, frame, track_id, confidence, correction, quality, ord) by cluster and plate:
    supports over distinct frames and tracks, means over all rows. Blank plates don't vote. Where obs lies in buckets of
    cluster_id nothing is shuffled."""
    rows = obs.filter("plate <> ''").withColumn("_f", is_first("cluster_id", "plate", "frame")).withColumn("_t", is_first("cluster_id", "plate", "track_id"))
    return rows.groupBy("cluster_id", "plate").agg(
        F.count(F.when(F.col("_f"), F.col("frame"))).alias("frame_support"),
        F.count(F.when(F.col("_t"), F.col("track_id"))).alias("track_support"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("correction").alias("mean_correction"),
        F.avg("quality").alias("mean_quality"),
        F.min("ord").alias("first_seen"),
    )


def ranked(options: DataFrame, places: int = 9) -> DataFrame:
    """candidate_rank in each cluster: more frames, higher confidence, fewer corrections, higher quality,
    first seen. Means are compared at `places` decimals, so that the order of a sum doesn't decide."""
    r = lambda c: F.round(c, places)
    order = Window.partitionBy("cluster_id").orderBy(F.desc("frame_support"), r("mean_confidence").desc(), r("mean_correction").asc(), r("mean_quality").desc(), F.asc("first_seen"))
    return options.withColumn("candidate_rank", F.row_number().over(order)).withColumn("selected", F.col("candidate_rank") == 1)


def fragments(selected: DataFrame, obs: DataFrame) -> DataFrame:
    """The best fragment of each independent frame: selected (cluster_id, plate), obs (cluster_id, frame,
    track_id, text, plate, ord). A frame is independent if no reading of it gave the selected plate. A fragment is the
    longest run shared with the plate, long enough and of letters and digits; of equally long ones the first
    observation's."""
    chosen = selected.select("cluster_id", F.col("plate").alias("candidate"))
    read = F.max(F.coalesce(F.col("plate") == F.col("candidate"), F.lit(False))).over(Window.partitionBy("cluster_id", "frame"))
    # a null frame is no frame that the plate was read in
    rest = obs.join(chosen, "cluster_id").withColumn("_read", read & F.col("frame").isNotNull()).filter("not _read").drop("_read")
    found = rest.withColumn("fragment", longest_common_substring("candidate", "text")).filter((F.length("fragment") >= min_fragment("candidate")) & mixed_alphanumeric("fragment"))
    top = F.max_by(F.struct("fragment", "track_id"), F.struct(F.length("fragment").alias("n"), (-F.col("ord")).alias("o")))
    # a frame's place is that of its first fragment, whichever of its fragments wins
    best = found.groupBy("cluster_id", "candidate", "frame").agg(top.alias("top"), F.min("ord").alias("ord"))
    return best.select("cluster_id", "candidate", "frame", "top.fragment", "top.track_id", F.length("top.fragment").alias("fragment_length"), "ord")


def best_fragments(found: DataFrame) -> DataFrame:
    """The longest fragment of each cluster, its length, and the numbers of frames and tracks that gave fragments. Of equally long ones that of the frame wins
    which gave the first fragment of any length."""
    top = F.max_by("fragment", F.struct("fragment_length", (-F.col("ord")).alias("o")))
    return found.groupBy("cluster_id").agg(top.alias("best_fragment"), F.max("fragment_length").alias("best_fragment_length"), F.count("*").alias("fragment_support"), F.countDistinct("track_id").alias("fragment_tracks"))


def status(frames: Column, fragment_frames: Column | None = None) -> Column:
    """VERIFIED_FULL from two frames, else CORROBORATED_FRAGMENT with a fragment, NEEDS_REVIEW, or REJECTED
    without a candidate. Without fragments two frames are VERIFIED."""
    full = F.when(frames.isNull() | (frames == 0), "REJECTED")
    if fragment_frames is None:
        return full.when(frames >= 2, "VERIFIED").otherwise("NEEDS_REVIEW")
    return full.when(frames >= 2, "VERIFIED_FULL").when(fragment_frames >= 1, "CORROBORATED_FRAGMENT").otherwise("NEEDS_REVIEW")


def consensus(clusters: DataFrame, options: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each cluster of clusters (cluster_id, track_id): its tracks, selected plate, supports, means
    (null without a candidate) and evidence status."""
    chosen = options.filter("selected").select("cluster_id", "plate", "frame_support", "track_support", "mean_confidence", "mean_correction", "mean_quality")
    members = clusters.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_set("track_id")), "|").alias("member_tracks"))
    rows = members.join(chosen, "cluster_id", "left").join(best_fragments(found), "cluster_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "cluster_id", "member_tracks", F.coalesce("plate", F.lit("")).alias("final_plate"), *map(count, ("frame_support", "track_support", "fragment_support", "fragment_tracks")),
        F.coalesce("best_fragment", F.lit("")).alias("best_fragment"), count("best_fragment_length"), F.round("mean_confidence", 6).alias("mean_confidence"), F.round("mean_correction", 4).alias("mean_correction"),
        F.round("mean_quality", 4).alias("mean_quality"), status(F.col("frame_support"), F.coalesce("fragment_support", F.lit(0))).alias("evidence_status"),
    )


def fused(readings: DataFrame) -> DataFrame:
    """The two-line fusion: readings (track_id, plate, frame, confidence, cost, score) to the best plate of
    each track, by distinct frames and 2 frames + 0.15 variants + scores."""
    r = readings.filter("plate <> ''").groupBy("track_id", "plate").agg(
        F.countDistinct("frame").alias("frame_support"), F.count("*").alias("variant_support"), F.avg("confidence").alias("mean_confidence"), F.avg("cost").alias("mean_cost"), F.sum("score").alias("total"), F.min("ord").alias("first_seen")
    )
    r = r.withColumn("fusion_score", F.round(2.0 * F.col("frame_support") + 0.15 * F.col("variant_support") + F.col("total"), 6))
    best = Window.partitionBy("track_id").orderBy(F.desc("frame_support"), F.desc("fusion_score"), "first_seen")
    s = F.when((F.col("frame_support") >= 2) & (F.col("mean_confidence") >= 0.6), "VERIFIED").when(F.col("mean_confidence") >= 0.5, "NEEDS_REVIEW").otherwise("REJECTED")
    return r.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("track_id", F.col("plate").alias("final_plate"), s.alias("status"), "frame_support", "variant_support", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("mean_cost", 6).alias("mean_cost"), "fusion_score")


def weighted_vote(readings: DataFrame) -> DataFrame:
    """The first consensus: readings (track_id, text, valid, plausible, weight, fallback, ord). Valid texts
    vote by weight; without any, the plausible text of the highest confidence + quality is for review."""
    valid = readings.filter("valid").groupBy("track_id", "text").agg(F.round(F.sum("weight"), 9).alias("w"), F.count("*").alias("support"), F.min("ord").alias("o"))
    top = valid.groupBy("track_id").agg(F.max_by(F.struct("text", "support"), F.struct("w", (-F.col("o")).alias("o"))).alias("best"), F.sum("support").alias("valid_candidates"))
    spare = readings.filter("plausible and not valid").groupBy("track_id").agg(F.max_by("text", F.struct(F.round("fallback", 9).alias("f"), (-F.col("ord")).alias("o"))).alias("spare"))
    rows = readings.select("track_id").distinct().join(top, "track_id", "left").join(spare, "track_id", "left")
    support, n = F.col("best.support"), F.col("valid_candidates")
    ratio = F.coalesce(support / n, F.lit(0.0))
    s = F.when((support >= 2) & (ratio >= 0.5), "VERIFIED").when(n.isNotNull() | F.col("spare").isNotNull(), "NEEDS_REVIEW").otherwise("REJECTED")
    return rows.select(
        "track_id", F.coalesce("best.text", "spare", F.lit("")).alias("final_text"), s.alias("status"), F.coalesce(support, F.when(F.col("spare").isNotNull(), 1), F.lit(0)).alias("support"),
        F.coalesce(n, F.lit(0)).alias("valid_candidates"), F.round(ratio, 6).alias("consensus_ratio"),
    )


def truth_status(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """labels (cluster_id, track_id) and truth (track_id, text): whether a cluster's truths agree."""
    g = labels.join(truth, "track_id", "left").groupBy("cluster_id").agg(F.array_sort(F.collect_set("text")).alias("t"))
    return g.select("cluster_id", F.array_join("t", "|").alias("truth"), F.when(F.size("t") == 0, "NO_VERIFIED_GT").when(F.size("t") == 1, "CONSISTENT").otherwise("GT_CONFLICT").alias("truth_status"))


def members_split(clusters: DataFrame, members: str = "members", as_type: str = "bigint") -> DataFrame:
    """(cluster_id, track_id) of clusters whose tracks stand in one text, joined by |; a cluster without tracks has no row."""
    parts = F.filter(F.split(F.col(members), r"\|"), lambda x: x != "")
    return clusters.select("cluster_id", F.explode(F.transform(parts, lambda x: x.cast(as_type))).alias("track_id"))


def shared_frames(crops: DataFrame) -> DataFrame:
    """Pairs of tracks (a < b) with the same content digest in the same frame, and how often."""
    x, y = crops.alias("x"), crops.alias("y")
    # equal crops of one track in one frame count once, so a digest's rows are its tracks
    same = (F.col("x.digest") == F.col("y.digest")) & (F.col("x.frame") == F.col("y.frame")) & (F.col("x.track_id") < F.col("y.track_id"))
    return x.join(y, same).groupBy(F.col("x.track_id").alias("a"), F.col("y.track_id").alias("b")).agg(F.count("*").alias("matches"))


def pick_attempt(attempts: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first attempt of each key in the given order: rotations by cost, characters removed, confidence
    and angle; variants by cost, removed, confidence and priority."""
    return attempts.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def rescue(rows: DataFrame, solved: Column, stage) -> DataFrame:
    """Run a costly stage on the unsolved rows only: solved rows pass by."""
    return rows.filter(solved).unionByName(stage(rows.filter(~solved)), allowMissingColumns=True)


def linked_tracks(crops: DataFrame) -> DataFrame:
    """(a, b): each track tied to the smallest one that has the same digest in the same frame. For
    clustering: as many edges as rows, however many tracks share a digest."""
    least = crops.groupBy("digest", "frame").agg(F.min("track_id").alias("a"))
    return crops.join(least, ["digest", "frame"]).select("a", F.col("track_id").alias("b")).filter("a <> b").distinct()
