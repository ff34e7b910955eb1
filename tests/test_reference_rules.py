"""Rules of the reference that its queries' data don't tell apart, on rows that do."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import evidence, layout
from sightline.sources import files


def test_best_fragment_is_of_the_frame_that_was_first_seen(spark):
    obs = [(1, 7, 5, "MH12AB", "", 1), (1, 14, 6, "12AB1234", "", 2), (1, 7, 8, "MH12AB12", "", 3), (1, 21, 5, "MH12AB1234", "MH12AB1234", 4)]
    obs = spark.createDataFrame(obs, "cluster_id long, frame long, track_id long, text string, plate string, ord long")
    found = evidence.fragments(spark.createDataFrame([(1, "MH12AB1234")], "cluster_id long, plate string"), obs)
    best = evidence.best_fragments(found).first()
    assert (best.best_fragment, best.best_fragment_length, best.fragment_support, best.fragment_tracks) == ("MH12AB12", 8, 2, 2)
    assert {r.frame: r.track_id for r in found.collect()} == {7: 8, 14: 6}  # the track of the fragment that won


def test_rows_use_the_upper_median_height(spark):
    regions = spark.createDataFrame([(1, 0.0, 0.0, 10.0, "a"), (1, 15.0, 5.0, 30.0, "b")], "image long, y double, x double, h double, text string")
    rows = regions.groupBy("image").agg(F.collect_list(F.struct("y", "x", "h", "text")).alias("r")).select(layout.cluster_rows(F.col("r")).alias("rows"))
    assert rows.first().rows == ["ab"]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\nx,1\n,no\n")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "a int, b string, c string", required=("c",)).collect()
    assert [tuple(r) for r in got] == [(1, "x", ""), (None, "", "")]
    with pytest.raises(ValueError, match="no column"):
        files.read_csv(spark, str(tmp_path / "a.csv"), "a int, d string")


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.1 0.2 0.3 0.4\n0 x 0.2 0.3 0.4\n1 0.1 0.2 0.3 0.4\n0 1\n")
    (tmp_path / "b.txt").write_text("")
    assert {r.path[-5:]: r.n for r in files.count_labels(spark, str(tmp_path)).collect()} == {"a.txt": 3, "b.txt": 0}
    assert files.read_labels(spark, str(tmp_path), strict=False).count() == 1


def test_one_file_for_each_key(spark):
    listed = spark.createDataFrame([("/x/A1_q.jpg", "A1_q.jpg"), ("/x/A2_q.jpg", "A2_q.jpg"), ("/x/A2_r.jpg", "A2_r.jpg")], "path string, name string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "id string")
    assert files.find_one(keys("A1"), listed, "id", "(A[0-9]+)_").first().path == "/x/A1_q.jpg"
    for k in ("A2", "A3"):
        with pytest.raises(Exception, match="not one file"):
            files.find_one(keys("A1", k), listed, "id", "(A[0-9]+)_").collect()


def test_label_files_lie_in_buckets(spark, tmp_path):
    from sightline.sources import sinks, store

    boxes = [(f"img{i}", (0.5, 0.25, 0.125, 0.5)) for i in range(40)] + [("img1", (0.1, 0.2, 0.3, 0.4)), ("none", None)]
    df = spark.createDataFrame(boxes, "image string, box struct<xc:double,yc:double,w:double,h:double>")
    done = sinks.write_labels(df, str(tmp_path), 4)
    found = {r.path.rpartition("/")[2]: (r.path.split("/")[-2], open(r.path).read()) for r in store.listed(spark, str(tmp_path)).collect()}
    assert len(found) == 41 == done.count() and {f for f, _ in found.values()} <= {"0000", "0001", "0002", "0003"}
    assert found["img1.txt"][1] == "0 0.100000 0.200000 0.300000 0.400000\n0 0.500000 0.250000 0.125000 0.500000\n" and found["none.txt"][1] == ""
    assert {r.path.rpartition("/")[2]: r.n for r in files.count_labels(spark, str(tmp_path)).collect()}["img1.txt"] == 2


def test_gain_is_over_the_chosen_baseline(spark):
    from sightline.operators.comparison import AblationStage, ablation, stage_row

    df = spark.createDataFrame([("abc", "abd", "abc", 10.0), ("xyz", "", "xyw", 20.0)], "truth string, a string, b string, ms double")
    table = ablation(df, [AblationStage("one", "m1", F.col("a"), "BASELINE"), AblationStage("two", "m2", F.col("b"), "KEEP", "better", F.col("ms"))], "two")
    one, two = sorted(table.collect(), key=lambda r: r.place)
    assert (one.gain_pp, two.gain_pp, two.step_pp, two.latency_ms, one.latency_ms, two.reason) == (-50.0, 0.0, 50.0, 15.0, None, "better")
    assert stage_row(table, "two").first().method == "m2"
    with pytest.raises(ValueError, match="one stage"):
        stage_row(table, "three")


def test_member_lists_are_split(spark):
    from sightline.operators.evidence import members_split

    rows = members_split(spark.createDataFrame([(1, "3|4"), (2, "7"), (5, "")], "cluster_id int, members string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 3), (1, 4), (2, 7)]
