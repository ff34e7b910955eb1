"""Running totals and ranks over ranges against plain sorts."""

import random

from pyspark.sql import functions as F

from sightline.operators.prefix import ranked, running


def test_running_totals(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(50), i, r.choice([None, *range(9)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v int")
    got = {x.i: (x.total, x.at) for x in running(df, [F.col("k"), F.col("i")], {"total": F.col("v"), "at": F.lit(1).cast("long")}, by=["g"]).collect()}
    sums, count = {}, {}
    for g, _, i, v in sorted(rows, key=lambda x: (x[1], x[2])):
        sums[g], count[g] = sums.get(g, 0) + (v or 0), count.get(g, 0) + 1
        assert (got[i][0] or 0, got[i][1]) == (sums[g], count[g])
    whole = running(df, [F.col("k").desc(), F.col("i")], {"at": F.lit(1).cast("long")})
    assert [x.i for x in whole.orderBy("at").collect()] == [x[2] for x in sorted(rows, key=lambda x: (-x[1], x[2]))]
    assert running(df.filter("false"), [F.col("k")], {"at": F.lit(1)}).count() == 0


def test_ranks_of_groups(spark):
    r = random.Random(4)
    rows = [("big", r.choice([r.random(), r.random() * 1e6, 7.5, -3.0, 1e-300, None])) for _ in range(4000)] + [("one", 2.5), ("same", 1.0), ("same", 1.0), (None, 3.0), (None, 1.0), ("none", None)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 1e-308, 5.0, 5.000000000000001)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.n, x.v) for x in ranked(df, "g", "v", F.floor(F.col("n") / 2)).collect()}
    want = {}
    for g in {g for g, _ in rows} - {"none"}:
        v = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = (len(v), v[len(v) // 2])
    assert got == want
    assert ranked(df.filter("false"), "g", "v", F.lit(0)).count() == 0
