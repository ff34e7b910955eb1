"""Queries of the engine's operators over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions import geometry as geo
from sightline.functions import metrics as met
from sightline.functions import plates
from sightline.functions import text as tx
from sightline.operators import annotations, evaluate, evidence, graph, layout, leakage, prefix, selection
from sightline.plans import views
from sightline.plans.lineage import bucketed, cut
from sightline.plans.views import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

THRESHOLDS = [0.1, 0.2, 0.3, 0.5, 0.7]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _obs(spark, d):
    """Observations with their parsed plate, in clusters: parsed once, as what follows reads them several times, and in buckets of
    their cluster, by which all of that groups and joins."""
    obs = view(spark, d, views.OBSERVATIONS).withColumn("text", tx.clean_text("raw_text")).withColumn("parsed", plates.parse_plate("raw_text"))
    obs = obs.select("*", F.col("parsed.plate").alias("plate"), F.col("parsed.cost").alias("correction")).drop("parsed")
    used = obs.select("track_id", "frame", "ord", "text", "plate", "correction", "confidence", "quality")
    return bucketed(evidence.with_clusters(used, view(spark, d, views.MAPPING)), "cluster_id", n=views.parts_of(spark, d, "lineitem"))


def _selected(spark, d, obs):
    """The selected plate of each cluster, in the buckets of obs."""
    return bucketed(evidence.ranked(evidence.votes(obs)).filter("selected"), "cluster_id", n=views.parts_of(spark, d, "lineitem"))


def _options(spark, d):
    return evidence.ranked(evidence.votes(_obs(spark, d)))


@query
def consensus(spark, d):
    obs = _obs(spark, d)
    selected = _selected(spark, d, obs)
    return evidence.consensus(obs, selected, evidence.fragments(selected, obs))


@query
def clean_text(spark, d):
    return view(spark, d, views.OBSERVATIONS).select("ord", tx.clean_text("raw_text").alias("clean"), tx.mixed_alphanumeric(tx.clean_text("raw_text")).alias("mixed"))


@query
def parse_plate(spark, d):
    return view(spark, d, views.OBSERVATIONS).withColumn("p", plates.parse_plate("raw_text")).select("ord", "p.plate", "p.cost", "p.removed", "p.start")


@query
def parse_fused(spark, d):
    return view(spark, d, views.OBSERVATIONS).withColumn("p", plates.parse_fused("raw_text")).select("ord", "p.plate", "p.cost")


@query
def correct_plate(spark, d):
    return view(spark, d, views.OBSERVATIONS).withColumn("p", plates.correct_plate("raw_text")).select("ord", "p.plate", "p.cost")


@query
def plate_validity(spark, d):
    t = tx.clean_text("raw_text")
    return view(spark, d, views.OBSERVATIONS).select(
        "ord", plates.plausible_counts(t).alias("by_counts"), plates.plausible_state("raw_text").alias("by_state"), plates.format_valid(t).alias("format_ok"),
        plates.valid_format("raw_text").alias("state_ok"), plates.classify(t, "confidence").alias("class"),
    )


@query
def attempt_scores(spark, d):
    rows = view(spark, d, views.OBSERVATIONS).withColumn("c", plates.correct_plate("raw_text"))
    r = lambda c: F.round(c, 6)
    return rows.select(
        "ord", r(plates.attempt_score(F.col("c"), "raw_text", "confidence")).alias("s1"), r(plates.attempt_score_simple(tx.clean_text("raw_text"), "confidence")).alias("s2"),
        r(plates.fusion_weight("confidence", "quality", "detection", F.coalesce("c.cost", F.lit(-1)))).alias("fusion"), r(plates.vote_weight("confidence", "quality", "detection")).alias("vote"),
    )


@query
def common_substrings(spark, d):
    rows = view(spark, d, views.OBSERVATIONS).withColumn("text", tx.clean_text("raw_text"))
    return rows.select("ord", tx.longest_common_substring("truth", "text").alias("lcs"), tx.min_fragment("truth").alias("least"))


@query
def reading_errors(spark, d):
    rows = view(spark, d, views.READINGS).withColumn("d1", F.levenshtein("pred", "truth")).withColumn("d2", F.levenshtein("other", "truth"))
    return rows.select(
        "id", "d1", "d2", tx.error_class("pred", "truth").alias("first_class"), tx.error_class("pred", "truth", False).alias("second_class"), tx.winner("d1", "d2", ("first", "second")).alias("winner"),
        tx.change_status("d2", "d1", "pred", "truth").alias("change"), tx.contains_truth("pred", "truth").alias("contains"), tx.first_filled("pred", "other").alias("filled"),
    )


@query
def reading_metrics(spark, d):
    return evaluate.reading_metrics(view(spark, d, views.READINGS))


@query
def augmented_sources(spark, d):
    url = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.lit("V_P_I_"), F.col("page_id") % 50, F.lit("_jpg.rf."), F.md5("url"), F.lit(".jpg")).alias("name"))
    return url.select("page_id", tx.source_of_augmented("name").alias("source"), tx.source_of_frame("name").alias("frame"))


@query
def box_geometry(spark, d):
    b = view(spark, d, views.BOXES).withColumn("box", geo.coco_to_yolo("w_img", "h_img", "x", "y", "w", "h")).filter("box is not null")
    b = b.withColumn("px", geo.yolo_to_pixels("box", "w_img", "h_img")).withColumn("pad", geo.padded("px", "w_img", "h_img")).withColumn("in", geo.pixels_inside("px", "w_img", "h_img"))
    r = lambda c: F.round(c, 9)
    return b.select("id", r("box.xc").alias("xc"), r("box.yc").alias("yc"), r("box.w").alias("bw"), r("box.h").alias("bh"), r("px.x1").alias("x1"), r("px.y2").alias("y2"), r(geo.area_share("px", "w_img", "h_img")).alias("share"), geo.big_enough("w", "h", 10, 5).alias("big"))


@query
def quality_scores(spark, d):
    rows = view(spark, d, views.BOXES)
    return rows.select("id", F.round(geo.tracking_quality(F.col("w") / 40, F.col("w") * F.col("h") * 20, F.col("x") * 6, "h"), 9).alias("q1"), F.round(geo.benchmark_quality(F.col("w") * 6, F.col("h") * 3, F.col("y") * 10, "x"), 9).alias("q2"))


@query
def crop_names(spark, d):
    rows = view(spark, d, views.CANDIDATES).select("seq", geo.crop_name("track_id", F.col("seq") % 5, "frame", F.floor("score") + F.lit(0.5)).alias("name"))
    p = geo.parse_crop_name("name")
    return rows.select("seq", "name", p["track"].alias("track"), p["frame"].alias("frame"), p["score"].alias("score"))


@query
def label_hard_examples(spark, d):
    rows = annotations.review_counts(view(spark, d, views.COUNTS))
    return rows.select("id", "valid", "tp", "fp", "fn", tx.hard_example_labels("fp", "fn", "visible").alias("labels"))


@query
def inconsistent_counts(spark, d):
    rows = annotations.review_counts(view(spark, d, views.COUNTS)).withColumn("fn", F.when(F.col("id") % 9 == 0, F.col("fn") + 1).otherwise(F.col("fn")))
    return annotations.inconsistent(rows).select("id", "tp", "fp", "fn")


@query
def detection_metrics(spark, d):
    return evaluate.detection_metrics(annotations.review_counts(view(spark, d, views.COUNTS)), "video")


@query
def evidence_bounds(spark, d):
    return evaluate.rejects(evaluate.evidence_bounds(view(spark, d, views.COUNTS)), 0.99, 0.9, 0.95)


def _scored(spark, d):
    return view(spark, d, views.COUNTS).select("id", (F.col("id") % 97 / 97.0).alias("score"), (F.col("visible") > 0).cast("int").alias("truth"))


@query
def threshold_sweep(spark, d):
    return evaluate.sweep(_scored(spark, d), THRESHOLDS)


@query
def operating_point(spark, d):
    return evaluate.operating_point(evaluate.sweep(_scored(spark, d), THRESHOLDS), 0.75)


@query
def cluster_votes(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return evidence.votes(_obs(spark, d)).select("cluster_id", "plate", "frame_support", "track_support", r("mean_confidence"), r("mean_correction"), r("mean_quality"))


@query
def candidate_ranks(spark, d):
    return _options(spark, d).select("cluster_id", "plate", "frame_support", "candidate_rank", "selected")


@query
def fragment_evidence(spark, d):
    obs = _obs(spark, d)
    return evidence.fragments(evidence.ranked(evidence.votes(obs)).filter("selected"), obs).select("cluster_id", "candidate", "frame", "fragment", "fragment_length")


@query
def status_histogram(spark, d):
    return consensus(spark, d).groupBy("evidence_status").agg(F.count("*").alias("n"), F.countDistinct("final_plate").alias("plates"))


@query
def fused_tracks(spark, d):
    rows = view(spark, d, views.OBSERVATIONS).withColumn("p", plates.parse_fused("raw_text"))
    rows = cut(rows.select("track_id", "frame", "ord", "confidence", "quality", "detection", "p.plate", "p.cost"))  # parsed once
    return evidence.fused(rows.withColumn("score", plates.fusion_weight("confidence", "quality", "detection", "cost")))


@query
def weighted_consensus(spark, d):
    rows = view(spark, d, views.OBSERVATIONS).withColumn("c", plates.correct_plate("raw_text"))
    rows = cut(rows.select("track_id", "ord", F.coalesce("c.plate", tx.clean_text("raw_text")).alias("text"), F.col("c").isNotNull().alias("valid"), plates.plausible_state("raw_text").alias("plausible"), plates.vote_weight("confidence", "quality", "detection").alias("weight"), (F.col("confidence") + F.col("quality")).alias("fallback")))
    return evidence.weighted_vote(rows)


@query
def truth_of_clusters(spark, d):
    obs = evidence.with_clusters(view(spark, d, views.OBSERVATIONS), view(spark, d, views.MAPPING))
    truth = obs.filter("confidence >= 0.95").select("track_id", F.col("truth").alias("text")).distinct()
    members = obs.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("track_id")), "|").alias("members"))
    return evidence.truth_status(evidence.members_split(members), truth)


@query
def shared_crops(spark, d):
    return evidence.shared_frames(view(spark, d, views.CROPS))


@query
def track_clusters(spark, d):
    crops = view(spark, d, views.CROPS)
    return graph.clusters(crops, evidence.linked_tracks(crops), "track_id")


@query
def cluster_members(spark, d):
    return graph.members(track_clusters(spark, d), "track_id")


@query
def spaced_top_k(spark, d):
    return selection.spaced_top(view(spark, d, views.CANDIDATES)).select("track_id", "rank", "frame", "seq", "score")


@query
def best_attempt(spark, d):
    rows = view(spark, d, views.OBSERVATIONS).withColumn("p", plates.parse_plate("raw_text"))
    cost = F.when(F.col("p.cost") < 0, 99).otherwise(F.col("p.cost"))
    return evidence.pick_attempt(rows.withColumn("cost", cost), "track_id", F.asc("cost"), F.asc("p.removed"), F.desc("confidence"), F.asc("ord")).select("track_id", "ord", "p.plate", "cost")


@query
def best_of_source(spark, d):
    return selection.best_per_source(view(spark, d, views.IMAGES), "source_id", "quality", "image_id").select("source_id", "image_id", "quality")


@query
def top_images(spark, d):
    return selection.top_n(view(spark, d, views.IMAGES), 30, F.desc("quality"), F.asc("image_id")).select("image_id", "quality")


@query
def split_leaks(spark, d):
    return leakage.leaks(view(spark, d, views.IMAGES))


@query
def source_split(spark, d):
    return leakage.split_by_source(view(spark, d, views.IMAGES))


@query
def hash_sample(spark, d):
    return leakage.sample_rows(view(spark, d, views.IMAGES), "image_id", 50).select("image_id")


@query
def mixed_dataset(spark, d):
    rows = view(spark, d, views.IMAGES)
    road = leakage.repeated(rows.filter("split = 'val'"), 20).select("image_id", F.lit("road").alias("domain"), "repeat")
    return rows.filter("split = 'train'").select("image_id", F.lit("base").alias("domain"), F.lit(1).alias("repeat")).unionByName(road)


@query
def domain_shares(spark, d):
    rows = mixed_dataset(spark, d).groupBy("domain").agg(F.count("*").alias("n"))
    return rows.select("domain", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 9).alias("share"))  # a row for each domain


@query
def region_rows(spark, d):
    return layout.rows_by_bucket(view(spark, d, views.REGIONS), "image")


@query
def clustered_rows(spark, d):
    r = view(spark, d, views.REGIONS).groupBy("image").agg(F.collect_list(F.struct("y", "x", F.lit(12.0).alias("h"), "text")).alias("r"))
    return r.select("image", F.array_join(layout.cluster_rows(F.col("r")), "|").alias("rows"))


@query
def latency_medians(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", "value")
    upper = evaluate.upper_medians(rows, "event_type", "value").select(F.col("event_type").alias("_t"), F.col("value").alias("upper"), "n")
    lower = prefix.ranked(rows, "event_type", "value", F.floor((F.col("n") - 1) / 2)).select(F.col("event_type").alias("_u"), F.col("value").alias("lower"))
    both = upper.join(lower, F.col("_t").eqNullSafe(F.col("_u"))).select("_t", "upper", ((F.col("lower") + F.col("upper")) / 2).alias("middle"))
    sums = rows.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0)), 6).alias("extra"), F.round(met.fps(F.avg("value")), 6).alias("fps"))
    return sums.join(both, F.col("event_type").eqNullSafe(F.col("_t")), "left").drop("_t")


@query
def last_epochs(spark, d):
    return evaluate.last_per_group(spark.read.parquet(f"{d}/events.parquet").withColumn("epoch", F.col("event_id")), "user_id", "epoch", "value", "event_type")


@query
def open_items(spark, d):
    items = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    return annotations.next_open(items, spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


@query
def upserted(spark, d):
    table = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    changes = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("state")).filter("state = 'R'")
    return annotations.upsert(table, changes, "id")


@query
def seeded(spark, d):
    table = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("quality"))
    seed = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit(-1).alias("quality"))
    return annotations.insert_absent(table, seed, "doc_id")


@query
def annotation_rules(spark, d):
    rows = view(spark, d, views.READINGS)
    status = F.when(F.col("id") % 4 == 0, "UNREADABLE").when(F.col("id") % 4 == 1, "NOT_A_PLATE").when(F.col("id") % 4 == 2, "VERIFIED").otherwise("OTHER")
    return rows.select("id", annotations.reading_ok(status, "pred").alias("sample_ok"), annotations.reading_ok(status, "pred", 4).alias("track_ok"))


@query
def box_issues(spark, d):
    b = view(spark, d, views.BOXES).select((F.col("id") % 500).alias("image"), (F.col("id") % 3 % 2).alias("class"), (F.col("x") / 100).alias("xc"), (F.col("y") / 80).alias("yc"), (F.col("w") / 100).alias("w"), (F.col("h") / 80).alias("h"), F.lit(4).alias("expected"))
    return annotations.box_issues(b)


@query
def sampled_frames(spark, d):
    return selection.sample_frames(20.0, 2.0, 29.97, 500, spark)


@query
def lenient_casts(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).when(F.col("c_custkey") % 3 == 1, F.lit("1.5")).otherwise(F.lit("x")).alias("v"))
    return rows.select("c_custkey", tx.to_int("v").alias("i"), tx.to_double("v").alias("f"), tx.to_bool(F.when(F.col("c_custkey") % 2 == 0, "True").otherwise("no")).alias("b"))
