import random

from pyspark.sql import functions as F

from sightline.functions import plates
from sightline.functions import text as tx
from sightline.operators import annotations, evidence, graph, images, layout, selection
from sightline.sources import files, sinks
from sightline.streaming.topk import fold, spaced_top_stream

CAND = "track_id long, seq long, frame long, score double"


def brute_top(rows, k=5, gap=5):
    kept = []
    for frame, seq, score in sorted(rows):
        kept = fold(kept, frame, seq, score, k, gap)
    return kept


def candidates(n=400):
    r = random.Random(3)
    return [(r.randrange(8), i, i // 3, r.choice([0.1, 0.5, 0.9])) for i in range(n)]


def test_spaced_top_batch_is_the_fold(spark):
    rows = candidates()
    got = selection.spaced_top(spark.createDataFrame(rows, CAND)).orderBy("track_id", "rank").collect()
    for t in {r[0] for r in rows}:
        want = brute_top([(f, s, x) for tt, s, f, x in rows if tt == t])
        assert [(r.frame, r.seq, r.score) for r in got if r.track_id == t] == want


def test_spaced_top_stream_is_the_fold(spark, tmp_path):
    rows = candidates(120)
    for i in range(3):
        spark.createDataFrame(rows[40 * i : 40 * (i + 1)], CAND).coalesce(1).write.json(f"{tmp_path}/in", mode="append")
    src = spark.readStream.schema(CAND).json(f"{tmp_path}/in")
    q = spaced_top_stream(src).writeStream.outputMode("update").format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("kept").collect()
    for t in {r[0] for r in rows}:
        want = brute_top([(f, s, x) for tt, s, f, x in rows if tt == t])
        assert {(r.frame, r.seq, r.score) for r in got if r.track_id == t} >= set(want)


def test_components_against_union_find(spark):
    r = random.Random(5)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(30)] + [(None, 3), (7, 7)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            a, b = find(a), find(b)
            par[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for x in par}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parser_examples(spark):
    rows = spark.createDataFrame([("mh 12-ab 1234",), ("INDMHI2AB1234",), ("XX99",), (None,), ("",)], "t string").select(plates.parse_plate("t").alias("p")).collect()
    assert [(r.p.plate, r.p.cost, r.p.removed) for r in rows] == [("MH12AB1234", 0, 0), ("MH12AB1234", 1, 3), ("", -1, 999), ("", -1, 999), ("", -1, 999)]


def test_common_substring_takes_the_first(spark):
    r = spark.createDataFrame([("ABCDEF", "xCDxAB"), ("", "A"), (None, "A"), ("AB", "")], "a string, b string").select(tx.longest_common_substring("a", "b").alias("s")).collect()
    assert [x.s for x in r] == ["AB", "", "", ""]


def test_rows_are_clustered_by_running_mean(spark):
    data = [("A", 0.0, 2.0), ("B", 4.0, 1.0), ("C", 40.0, 1.0), ("D", 44.0, 0.0)]
    r = spark.createDataFrame([(1, t, y, x) for t, y, x in data], "i int, text string, y double, x double")
    got = r.groupBy("i").agg(F.collect_list(F.struct("y", "x", F.lit(20.0).alias("h"), "text")).alias("r")).select(layout.cluster_rows(F.col("r")).alias("rows")).first()
    assert got.rows == ["BA", "DC"]
    back = spark.createDataFrame([(["1234", "MH12AB"],)], "rows array<string>").select(layout.reversed_if_better(F.col("rows"), lambda c: plates.parse_plate(c)["plate"]).alias("t")).first()
    assert back.t == "MH12AB1234"


def test_rescue_runs_on_unsolved_rows_only(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "")], "id int, plate string")
    seen = evidence.rescue(rows, F.col("plate") != "", lambda d: d.withColumn("plate", F.lit("new"))).orderBy("id").collect()
    assert [r.plate for r in seen] == ["a", "new"]


def test_csv_blanks_and_keys(spark, tmp_path):
    p = f"{tmp_path}/t"
    sinks.write_csv(spark.createDataFrame([("a", None), ("b", "x")], "k string, v string"), p, ["k", "v", "w"], 1)
    got = files.read_csv(spark, p, "k string, v string, w string").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", "", ""), ("b", "x", "")]
    assert files.read_or_empty(spark, f"{tmp_path}/none", "k string").count() == 0
    assert files.read_keyed(spark, p, "k string, v string, w string", "k").count() == 2


def test_labels_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.1 0.1\n0 0.5\n")
    assert files.read_labels(spark, str(tmp_path / "a.txt"), strict=False).count() == 1
    try:
        files.read_labels(spark, str(tmp_path / "a.txt")).collect()
    except Exception as e:
        assert "not a label" in str(e)
    else:
        raise AssertionError("a bad line must be an error")


def test_image_measures(spark):
    import numpy as np

    flat, board = np.full((4, 4), 7, np.uint8), (np.indices((4, 4)).sum(0) % 2 * 255).astype(np.uint8)
    rows = [(1, 4, 4, bytearray(flat.tobytes())), (2, 4, 4, bytearray(board.tobytes())), (3, 4, 4, bytearray(b"12"))]
    got = {r.id: r for r in images.measured(spark.createDataFrame(rows, "id long, width int, height int, content binary")).collect()}
    assert got[1].sharpness == 0 and got[1].contrast == 0 and got[2].sharpness > 0 and got[3].sharpness is None
    assert (images.rotate(np.array([[1, 2], [3, 4]]), 90) == np.array([[3, 1], [4, 2]])).all()


def test_upsert_replaces_and_adds(spark):
    t, c = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, annotations.upsert(t, c, "k").collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, annotations.insert_absent(t, c, "k").collect())) == [(1, "a"), (2, "b"), (3, "y")]
