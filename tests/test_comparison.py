import pytest
from pyspark.sql import functions as F

from sightline.operators import comparison, layout


def test_gates_and_strict_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    b = spark.createDataFrame([(1, "p")], "k long, b string")
    with pytest.raises(Exception, match="no k 2"):
        comparison.strict_join(a, b, "k").collect()
    assert comparison.strict_join(a.filter("k = 1"), b, "k").collect() == [(1, "x", "p")]
    assert [r.b for r in comparison.with_defaults(a, b, "k", {"b": "-"}).orderBy("k").collect()] == ["p", "-"]
    comparison.gate(comparison.missing_keys(b, a, "k"), "unknown")
    with pytest.raises(ValueError, match="both"):
        comparison.gate(comparison.shared_keys(a, b, "k"), "both")


def test_cascade_takes_the_first_stage_with_a_valid_attempt(spark):
    rows = [(1, 0, "", -1, 0, 0.9, 0), (1, 1, "P", 2, 0, 0.5, 90), (1, 1, "Q", 2, 0, 0.5, 180), (1, 2, "R", 0, 0, 0.9, 0), (2, 0, "", -1, 0, 0.1, 0), (2, 1, "", -1, 0, 0.1, 90), (3, 0, "S", 3, 1, 0.2, 0), (3, 1, "T", 0, 0, 0.9, 90)]
    got = comparison.cascade(spark.createDataFrame(rows, "k long, stage int, plate string, cost int, removed int, confidence double, tie int"), "k").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "P", 1, 2, 90), (2, "", 1, None, None), (3, "S", 0, 3, 0)]


def test_row_rules_differ(spark):
    # two heights: the first rule takes the upper middle height for all, the second each line's and region's own
    rows = [(0.0, 0.0, 10.0, "a"), (15.0, 1.0, 30.0, "b"), (26.0, 0.0, 10.0, "c")]
    df = spark.createDataFrame([(rows,)], "r array<struct<y:double,x:double,h:double,text:string>>")
    got = df.select(layout.cluster_rows(F.col("r")).alias("one"), layout.cluster_lines(F.col("r")).alias("two")).first()
    assert got.one == ["a", "b", "c"]
    assert got.two == ["ab", "c"]


def test_result_regions_of_odd_input(spark):
    odd = ['{"rec_texts":["a","b"],"rec_scores":[0.5]}', '{"res":{"rec_texts":["--"]}}', "{}", "not json", None]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, j string").orderBy("i").select(layout.result_regions("j").alias("r")).collect()]
    assert [tuple(x) for x in got[0]] == [(0, "A", 0.5, 0.5, 0.5, 1.0), (1, "B", 0.0, 1.5, 0.5, 1.0)]
    assert [x or [] for x in got[1:]] == [[]] * 4
