"""Staged models, tables in versions, posts and progress counters."""

import os
import threading
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import annotations
from sightline.operators.stages import Stage, _run, staged
from sightline.sources import versions
from sightline.streaming.progress import Progress, counted_top_stream
from sightline.streaming.topk import fold


def counting(folder, name, solves):
    """A model that leaves a file for each row that it gets, and reads what it can solve."""

    def factory():
        def model(b):
            assert len(b) <= 3
            for k in b["id"]:
                open(os.path.join(folder, f"{name}-{k}-{uuid.uuid4().hex}"), "w").close()
            return pd.DataFrame({"reading": [f"{name}{k}" if solves(k) else None for k in b["id"]]})

        return model

    return Stage(name, factory, batch=3)


def test_stages_run_on_unsolved_rows_only(spark, tmp_path):
    rows = spark.range(50).withColumn("content", F.lit("x")).repartition(4)
    steps = [counting(str(tmp_path), "a", lambda k: k % 2 == 0), counting(str(tmp_path), "b", lambda k: k % 3 == 0), counting(str(tmp_path), "c", lambda k: k % 5 == 0)]
    got = {r.id: r for r in staged(rows, "id", steps, "reading string", F.col("reading").isNotNull()).collect()}
    called = {s: sorted(int(f.split("-")[1]) for f in os.listdir(tmp_path) if f.startswith(s)) for s in "abc"}
    assert called["a"] == list(range(50))
    # no call for a row that is solved
    assert called["b"] == [k for k in range(50) if k % 2] and called["c"] == [k for k in range(50) if k % 2 and k % 3]
    for k, r in got.items():
        name, runs = ("a", 1) if k % 2 == 0 else ("b", 2) if k % 3 == 0 else ("c", 3) if k % 5 == 0 else ("", 3)
        assert (r.stage, r.stages_run, r.reading) == (name, runs, f"{name}{k}" if name else None)
    assert staged(rows.filter("false"), "id", steps, "reading string", F.col("reading").isNotNull()).count() == 0
    bad = Stage("bad", lambda: lambda b: pd.DataFrame({"reading": ["one"]}), batch=3)
    with pytest.raises(Exception, match="3 rows in, 1 out"):
        staged(spark.range(0, 9, 1, 1), "id", [bad], "reading string", F.col("reading").isNotNull())


def test_a_batch_comes_back_as_one_frame():
    """The model gets three rows at most; Spark gets a frame for each of its own batches, and none for an empty one."""
    sizes = []

    def model(b):
        sizes.append((len(b), list(b.index)))
        return pd.DataFrame({"reading": [str(k) for k in b["id"]]}, index=range(5, 5 + len(b)))

    got = list(_run(iter([pd.DataFrame({"id": range(10)}), pd.DataFrame({"id": []}), pd.DataFrame({"id": [7]})]), "id", Stage("a", lambda: model, batch=3)))
    assert [len(x) for x in got] == [10, 1] and list(got[0]["reading"]) == [str(k) for k in range(10)] and list(got[0]["id"]) == list(range(10))
    assert [n for n, _ in sizes] == [3, 3, 3, 1, 1] and all(at == list(range(n)) for n, at in sizes)


def test_two_writers_lose_nothing(spark, tmp_path):
    path, schema, tried, failed = str(tmp_path / "table"), "k long, v string", [], []

    def writer(name, start):
        try:
            for i in range(4):
                rows = spark.createDataFrame([(start + i, name), (100, name)], schema)

                def change(t, rows=rows):
                    tried.append(name)
                    return annotations.upsert(t, rows, "k")

                versions.update(spark, path, schema, change)
        except Exception as e:  # noqa: BLE001  shown below
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(n, s)) for n, s in (("a", 0), ("b", 10))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = {r.k: r.v for r in versions.read_version(spark, path, schema).collect()}
    assert set(got) == {0, 1, 2, 3, 10, 11, 12, 13, 100} and all(got[k] == ("a" if k < 10 else "b") for k in got if k < 100)
    assert versions.versions(spark, path) == list(range(8)) and len(tried) >= 8
    folders = [d for d in os.listdir(path) if d.startswith("data-")]
    assert len(folders) == 8  # a change that came second leaves nothing
    assert not versions.claim(spark, f"{path}/_versions/{3:012d}", "other")
    assert versions.read_version(spark, path, schema, 0).count() == 2
    assert versions.vacuum(spark, path, 3) == [0, 1, 2, 3, 4] and versions.read_version(spark, path, schema).count() == 9
    with pytest.raises(ValueError):
        versions.read_version(spark, path, schema, 0)
    assert versions.read_version(spark, str(tmp_path / "new"), schema).count() == 0


def test_posts(spark):
    samples = spark.createDataFrame([("s1", "dev"), ("s2", "test")], "sample_id string, split string")
    posts = [("s1", "VERIFIED", "kl-01 ab 1", 1), ("s1", "VERIFIED", "ab", 2), ("s2", "UNREADABLE", "KL01", 1), ("s3", "VERIFIED", "KL01AB", 1), ("s2", "odd", "KL01AB", 5), ("s2", None, "KL01AB", 6), ("s1", "VERIFIED", None, 9)]
    good, bad = annotations.posted_readings(spark.createDataFrame(posts, "sample_id string, status string, text string, ord int"), samples)
    assert {(r.sample_id, r.text, r.split) for r in good.collect()} == {("s1", "KL01AB1", "dev"), ("s2", "", "test")}
    assert sorted((r.sample_id, r.reason) for r in bad.collect()) == [("s1", "text too short"), ("s1", "text too short"), ("s2", "invalid status"), ("s2", "invalid status"), ("s3", "unknown sample_id")]
    box = lambda *v: dict(zip(("xc", "yc", "w", "h"), v))
    tasks = spark.createDataFrame([(0, "a", 1), (1, "b", 0)], "index int, sample_id string, expected int")
    rows = [(0, "a", [box(0.5, 0.5, 0.1, 0.1)]), (0, "b", [box(0.5, 0.5, 0.1, 0.1)]), (2, "a", []), (0, "a", []), (0, "a", [box(1.5, 0.5, 0.1, 0.1)]), (0, "a", [box(0.5, 0.5, 0.0, 0.1)]), (1, "b", None), (0, "a", [box(None, 0.5, 0.1, 0.1)])]
    got = annotations.posted_boxes(spark.createDataFrame(rows, "index int, sample_id string, boxes array<struct<xc:double,yc:double,w:double,h:double>>").repartition(1), tasks)
    assert sorted((r["index"], r.sample_id, r.reason or "") for r in got.collect()) == [(0, "a", ""), (0, "a", "expected 1 boxes"), (0, "a", "no area"), (0, "a", "outside"), (0, "a", "outside"), (0, "b", "sample mismatch"), (1, "b", ""), (2, "a", "invalid task index")]
    at = annotations.progress(samples, spark.createDataFrame([("s1",), ("s1",), ("zz",)], "sample_id string"), "sample_id").first()
    assert tuple(at) == (2, 1, "s2")


def test_progress_counts_rows_in_kept_and_late(spark, tmp_path):
    schema, batches = "track_id long, frame long, seq long, score double", [[(1, 0, 1, 0.5), (1, 2, 2, 0.9), (2, 0, 3, 0.1)], [(1, 10, 4, 0.2), (1, 1, 5, 0.99), (3, 7, 6, 0.4)]]
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        query = (
            counted_top_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))).writeStream.foreachBatch(lambda df, i: df.collect() and None).queryName("top")
            .outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = progress.of("top")
    finally:
        spark.streams.removeListener(progress)
    assert got["rows"] == 6 and got["late"] == 1 and got["ended"]
    # track 1 keeps two observations, tracks 2 and 3 one each
    kept = []
    for frame, seq, score in ((0, 1, 0.5), (2, 2, 0.9), (10, 4, 0.2)):
        kept = fold(kept, frame, seq, score, 5, 5)
    assert got["kept"] == len(kept) + 2
