"""Votes, fragments and sources of readings by one dealing of the rows, against plain Python."""

import random

from sightline.operators import comparison, evidence
from sightline.plans import views
from sightline.plans.lineage import bucketed


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def observations(spark):
    r = random.Random(2)
    pick = lambda xs: xs[r.randrange(len(xs))]
    rows = [(pick([1, 2, 3, None]), pick([10, 11, None]), pick([7, 14, 21, None]), i, pick(["MH12AB1234", "MH12AB12", "DL01CD5678"]), pick(["MH12AB1234", "DL01CD5678", "", None]), 0, 0.5, 0.25) for i in range(400)]
    return rows, spark.createDataFrame(rows, "cluster_id long, track_id long, frame long, ord long, text string, plate string, correction int, confidence double, quality double")


def test_votes_of_rows_in_buckets(spark):
    rows, df = observations(spark)
    found = evidence.votes(bucketed(df, "cluster_id"))
    want = {}
    for c, t, f, o, _, p, *_ in rows:
        if p:
            frames, tracks, first = want.setdefault((c, p), (set(), set(), [o]))
            frames.add(f)
            tracks.add(t)
    got = {(x.cluster_id, x.plate): (x.frame_support, x.track_support, x.first_seen) for x in found.collect()}
    assert got == {k: (len(f - {None}), len(t - {None}), o[0]) for k, (f, t, o) in want.items()}
    assert shuffles(found) == 0 and "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_fragments_and_consensus_of_rows_in_buckets(spark):
    rows, df = observations(spark)
    obs = bucketed(df, "cluster_id")
    chosen = {1: "MH12AB1234", 2: "DL01CD5678"}
    picked = bucketed(spark.createDataFrame(list(chosen.items()), "cluster_id long, plate string"), "cluster_id")
    found = evidence.fragments(picked, obs)
    read = {(c, f) for c, _, f, _, _, p, *_ in rows if chosen.get(c) == p and f is not None}
    want = {(c, f) for c, _, f, _, t, *_ in rows if c in chosen and (c, f) not in read and (t == chosen[c] or t == chosen[c][:8])}
    assert {(x.cluster_id, x.frame) for x in found.collect()} == want and want
    assert shuffles(found) == 0
    ranked = bucketed(evidence.ranked(evidence.votes(obs)).filter("selected"), "cluster_id")
    assert shuffles(evidence.consensus(obs, ranked, evidence.fragments(ranked, obs))) == 0


def test_sources_count_once_dealt(spark):
    r = random.Random(8)
    rows = [(r.randrange(12), r.choice([7, 14, None]), r.choice(["mh-12", "MH12", "", "dl01"]), r.choice(["clahe", "threshold"])) for _ in range(300)]
    df = spark.createDataFrame([(*x, x[2].replace("0", "O")) for x in rows], "track_id long, frame long, raw string, variant string, retry string")
    mapping = spark.createDataFrame([(t, t - t % 4) for t in range(9)], "track_id long, cluster_id long")
    found = comparison.source_counts(comparison.retried_observations(df, mapping, 3))
    old = comparison.observations_of(df.select("track_id", "frame", "raw"), df.select("track_id", "frame", "variant", "retry").withColumnRenamed("retry", "raw"), mapping)
    want = {}
    for x in old.collect():
        n, texts, frames = want.setdefault((x.cluster_id, x.source), ([], set(), set()))
        n.append(1)
        texts.add(x.text)
        frames |= {(x.track_id, x.frame)} if x.frame is not None else set()
    assert {(x.cluster_id, x.source): (x.n, x.texts, x.frames) for x in found.collect()} == {k: (len(n), len(t), len(f)) for k, (n, t, f) in want.items()}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert views.parts_of(spark, tmp_path, "lineitem") == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(views, "PART_ROWS", 30)
    assert views.parts_of(spark, tmp_path, "lineitem") == 34
