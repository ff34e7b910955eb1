"""Dataset splits by source, and leaks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.plans.lineage import cut


def leaks(rows: DataFrame, source: str = "source_id", split: str = "split") -> DataFrame:
    """Sources that stand in more than one split, with those splits: one grouped pass for all pairs."""
    g = rows.groupBy(source).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("n"))
    return g.filter(F.size("splits") > 1).select(source, F.array_join("splits", "|").alias("splits"), "n")


def hash_order(key: Column | str, seed: int) -> Column:
    return F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f"|{seed}")))


def split_by_source(rows: DataFrame, source: str = "source_id", shares: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """source and split: sources in hash order, the first int(80 %) for training, the next int(10 %) for
    validation, the rest for testing. Ranks are counted by the first byte of the hash, so that no task
    orders all sources."""
    ids = cut(rows.select(source).distinct().withColumn("h", hash_order(source, seed)).withColumn("b", F.substring("h", 1, 3)))
    sizes = {r.b: r.n for r in ids.groupBy("b").agg(F.count("*").alias("n")).collect()}  # 4096 rows at most
    total, before, starts = sum(sizes.values()), 0, []
    for b in sorted(sizes):
        starts.append((b, before))
        before += sizes[b]
    n_train, n_val = int(total * shares[0]), int(total * shares[1])
    base = F.broadcast(ids.sparkSession.createDataFrame(starts, "b string, start long"))
    from pyspark.sql.window import Window

    at = F.col("start") + F.row_number().over(Window.partitionBy("b").orderBy("h", source))
    return ids.join(base, "b").withColumn("at", at).select(source, F.when(F.col("at") <= n_train, "train").when(F.col("at") <= n_train + n_val, "val").otherwise("test").alias("split"))


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones every time: the first in hash order."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, numbered from 1."""
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))
