"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.graph import components
from sightline.plans.lineage import bucketed, cut, delete, discard, let, note, release, scope, shared_dir

__all__ = ["bucketed", "by_second", "compared", "components", "cut", "delete", "discard", "let", "linked_groups", "note", "release", "scope", "shared_dir", "small_batches", "table"]

#: Rows of an Arrow batch that carries texts.
BATCH_ROWS = 512
#: Nodes of one part that are compared one by one at most; beyond that the part is split.
CROWD = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers: a batch of texts has at most BATCH_ROWS rows, unless the session sets fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def compared(pairs: DataFrame, held: DataFrame, similar: Callable[[str, str], Column]) -> DataFrame:
    """The pairs (a, b) whose bodies are similar(); held: (node, body)."""
    sides = [held.select(F.col("node").alias(x), F.col("body").alias(f"{x}_body")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(similar("a_body", "b_body")).select("a", "b")


def by_second(crowded: DataFrame, prefixes: DataFrame) -> DataFrame:
    """crowded (part, node, root), dealt by a second element; prefixes (node, ps): the parts of a node in the common order, and one
    more of its elements in that order behind them. Similar nodes share two elements of these."""
    longer = crowded.join(prefixes, "node")
    second = F.explode(F.slice("ps", F.array_position("ps", F.col("part")).cast("int") + 1, F.size("ps")))
    return longer.select("part", "node", "root", second.alias("other")).select(F.xxhash64("part", "other").alias("part"), "node", "root")


def linked_groups(
    rows: DataFrame, facts_of: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame], likely: DataFrame | None = None
) -> DataFrame:
    """(node, root) for every node that is similar to another, at 0.8 or above. rows: (part, node), both whole numbers,
    dealt by part; similar nodes share a part. facts_of(nodes) gives (node, body), small facts by which near(a, b) rules
    out most pairs that are not similar; verify(pairs) leaves the pairs (a, b) that are. again(crowded) deals rows
    (part, node, root) of crowded parts in another way, so that similar nodes of a crowded part share one of the new parts. likely: pairs (a, b) that
    another method has found; they are verified with the pairs of heads, and need no comparison in the parts when they hold.

    Nodes that share a part are first held against the least of them. Only nodes that are in different groups after that
    are compared one by one, so that a large group of near copies costs its size. A part with more than CROWD nodes that
    are apart is dealt again.
    """
    heads = rows.groupBy("part").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head <> last").drop("last")
    spark = rows.sparkSession
    shared = cut(rows.join(heads.hint("shuffle_hash"), "part"))
    release(spark)
    facts = cut(facts_of(shared.select("node").distinct()))
    release(spark)

    def passed(pairs: DataFrame) -> DataFrame:
        return verify(cut(compared(pairs, facts, near)))

    first = shared.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    done = cut(passed(first if likely is None else first.union(likely).distinct()))
    groups = cut(components(done))
    named = shared.join(groups, "node", "left").select("part", "node", F.coalesce("root", "node").alias("root"), (F.col("node") == F.col("head")).alias("is_head"))
    # heads are done, so a part whose others are of one group is too
    others = named.filter("not is_head").drop("is_head")
    mixed = others.groupBy("part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).filter("lo <> hi").select("part", "members")
    # (part, node, root) of what may still be apart
    apart = cut(others.join(mixed, "part"))
    discard(shared, groups)
    release(spark)
    crowded = apart.filter(F.col("members") > CROWD)
    dealt = apart.filter(F.col("members") <= CROWD).select("part", "node", "root")
    if not crowded.isEmpty():
        dealt = dealt.union(again(crowded.select("part", "node", "root")))
    dealt = dealt.join(facts, "node")
    sides = [dealt.select("part", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "root", "body")]) for x in "ab"]
    pairs = sides[0].join(sides[1], "part").filter((F.col("a_root") < F.col("b_root")) & near("a_body", "b_body")).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    pairs = cut(pairs)
    discard(apart, facts)
    release(spark)
    return components(done.union(cut(verify(pairs))))
