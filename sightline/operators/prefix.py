"""Running totals, ranks and order statistics over tables and groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.plans.lineage import cut

#: Slices of a value range in one round of ranked().
SLICES = 512


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """rows and, for each name in sums, the total of its column over the rows with equal `by` (nulls are equal) up to and
    with this one in the given order. Rows that tie in the order get some order among them; nulls count as nothing.

    Rows are dealt into ranges of the order and written; a range is summed by itself, and starts with the total of the
    ranges before it. So neither the table nor a hot group is ever one task. What one task sees whole is a row for each
    range of a group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({f"_add_{k}": c for k, c in sums.items()})
    dealt = cut(named.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(f"_add_{k}").alias(k) for k in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", F.lit(0).alias("_own"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).cast(totals.schema[k].dataType).alias(f"_add_{k}") for k in sums])
    # the start of a range is its first row
    both = dealt.withColumn("_own", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    until = Window.partitionBy("_range", *by).orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumns({k: F.sum(f"_add_{k}").over(until) for k in sums}).filter("_own = 1")
    return out.select(*rows.columns, *sums)


def ranked(rows: DataFrame, group: str, value: str, rank: Column) -> DataFrame:
    """group, n and `value`: of each group's values (nulls apart) in ascending order the one at place rank, an expression of
    n that counts from 0. Exact, and no group is gathered: each round counts the values of SLICES slices of the range that
    holds the place, and goes on with the least and greatest value of the slice that has it, until these are equal. After
    one round a group keeps a small part of its values.
    """
    values = rows.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    first = values.groupBy(group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = cut(first.select(group, "n", rank.cast("long").alias("at"), "lo", "hi"))
    while not state.filter("lo < hi").isEmpty():
        todo = state.filter("lo < hi").withColumnRenamed(group, "_g")
        held = values.join(todo, F.col(group).eqNullSafe(F.col("_g"))).filter("v between lo and hi")
        step = F.col("hi") / SLICES - F.col("lo") / SLICES
        # monotone in v, so that slices are ranges; the least value of a slice is above all of the slice before
        piece = F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(SLICES)).cast("int")
        counted = held.groupBy("_g", piece.alias("piece")).agg(F.count("*").alias("m"), F.min("v").alias("l"), F.max("v").alias("h"), F.first("n").alias("n"), F.first("at").alias("at"))
        upto = F.sum("m").over(Window.partitionBy("_g").orderBy("piece"))  # SLICES + 1 rows of a group at most
        found = counted.withColumn("upto", upto).filter("upto > at and upto - m <= at")
        state = cut(state.filter("lo >= hi").union(found.select("_g", "n", F.col("at") - (F.col("upto") - F.col("m")), "l", "h")))
    return state.select(group, "n", F.col("lo").alias(value))
