"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source queues its documents in shuffled order, again and again for as many epochs as its target takes. A document
is queued in packets of PACKET words at most, as a long one would hold its source back or carry it far past its target.
A packet's virtual finish time is its source's words up to its end, over the source's target. Packets of all sources are
range-sorted by it and served until the budget is used up; the packet that crosses the budget is served in part.
A packet that would start after its source's target is never reached and isn't queued.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import cut
from sightline.llm.packing import tokens
from sightline.operators.prefix import running

WEIGHTS, EPOCHS, SEED, PACKET = (5, 2, 1), 3, 1, 256


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """row, id, source, size (words; 0 for null and blank texts) and h, by which documents are shuffled; written once."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), (tokens(text) - 1).alias("size"), h.alias("h"), F.xxhash64(text).alias("th"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, place, source_size and target. Sources by code point, null last, take the weights in turn and share the
    words of all; a target stops at `epochs` times the source's size, and what is above goes to the others by weight, until
    none is above. So a target is the least of that and of weight * level, with the one level at which targets add up to
    all words: a source is full if the level at which it fills up gives less than all.
    """
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    every = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    placed = running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    placed = placed.withColumns({"weight": F.get(every, ((F.col("place") - 1) % len(weights)).cast("int")), "most": F.col("source_size") * epochs}).withColumn("fill", F.col("most") / F.col("weight"))
    levels = cut(running(placed, [F.col("fill"), F.col("place")], {"mosts": F.col("most"), "weights": F.col("weight")}))
    whole = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    full = F.col("mosts") + F.col("fill") * (whole.weight - F.col("weights")) < whole.size
    used = levels.filter(full).agg(F.coalesce(F.sum("most"), F.lit(0)).alias("most"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level = F.lit(float(whole.size - used.most)) / F.lit(float(max(1, whole.weight - used.weight)))
    target = F.when(full, F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), level * F.col("weight")))
    return levels.select("source", "place", "source_size", target.alias("target"))


def mix(rows: DataFrame, aims: DataFrame, epochs: int = EPOCHS, packet: int = PACKET) -> DataFrame:
    """What is served, from sized() and targets(): row, id, source, epoch (from 0), packet (from 0, of the document in this
    epoch), words, finish and position (the words served before it): sort by it to get the mix in order.

    Sources are joined by value, nulls with nulls. Repeated rows and ids are documents of their own; documents without
    words are never served. No rows give no rows.
    """
    # the sum of the targets is the sum of all sizes
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first().b
    queued = rows.filter("size > 0").join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    queued = running(queued, [F.col(c) for c in ("h", "id", "size", "th", "row")], {"upto": F.col("size")}, by=["place"])
    queued = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("start", F.col("epoch") * F.col("source_size") + F.col("upto") - F.col("size"))
    queued = queued.filter(F.col("start") < F.col("target"))
    last = F.least(F.ceil(F.col("size") / packet), F.ceil((F.col("target") - F.col("start")) / packet)) - 1
    packets = queued.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("packet") * packet))
    end = F.col("start") + F.col("packet") * packet + F.col("words")
    packets = packets.select("row", "id", "source", "h", "place", "epoch", "packet", "words", (end / F.col("target")).alias("finish"))
    served = running(packets, [F.col(c) for c in ("finish", "h", "place", "epoch", "packet", "row")], {"upto": F.col("words")})
    position = F.col("upto") - F.col("words")
    return served.filter(position < budget).select("row", "id", "source", "epoch", "packet", F.least("words", F.lit(budget) - position).alias("words"), "finish", position.alias("position"))


def taken(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, packet: int = PACKET) -> DataFrame:
    """id_col, size, source_size, target and taken (the words that the mix takes, repeats counted) of every row of docs.
    Extra columns play no part. Jobs run while this is built."""
    rows = sized(docs, id_col, text, source)
    aims = cut(targets(rows, weights, epochs))
    served = mix(rows, aims, epochs, packet).groupBy("row").agg(F.sum("words").alias("taken"))
    slim = rows.select("row", "id", "source", "size").join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return slim.join(served, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def oracle_sql() -> str:
    """The query as DuckDB SQL over documents."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, row_number() OVER () AS r FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (place - 1) % {len(WEIGHTS)}] AS weight, source_size * {EPOCHS} AS most FROM s),
f AS (
  SELECT *, CAST(most AS DOUBLE) / weight AS fill FROM w),
l AS (
  SELECT *, CAST(sum(most) OVER o AS BIGINT) AS mosts, CAST(sum(weight) OVER o AS BIGINT) AS weights, CAST(sum(source_size) OVER () AS BIGINT) AS whole, CAST(sum(weight) OVER () AS BIGINT) AS all_weights
  FROM f WINDOW o AS (ORDER BY fill, place ROWS UNBOUNDED PRECEDING)),
u AS (
  SELECT *, mosts + fill * (all_weights - weights) < whole AS is_full FROM l),
a AS (
  SELECT source, place, source_size, whole, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE),
    CAST(whole - coalesce(sum(most) FILTER (is_full) OVER (), 0) AS DOUBLE) / CAST(greatest(1, all_weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0)) AS DOUBLE) * weight) END AS target FROM u),
q AS (
  SELECT d.*, a.place, a.source_size, a.target, a.whole, CAST(sum(size) OVER (PARTITION BY a.place ORDER BY h, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS c0
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
e AS (
  SELECT q.*, x.epoch, x.epoch * source_size + c0 AS start FROM q, (SELECT unnest(range({EPOCHS})) AS epoch) x WHERE size > 0),
k AS (
  SELECT *, unnest(range(CAST(least(ceil(CAST(size AS DOUBLE) / {PACKET}), ceil((target - start) / {PACKET})) AS BIGINT))) AS packet FROM e WHERE start < target),
p AS (
  SELECT *, least({PACKET}, size - packet * {PACKET}) AS words FROM k),
t AS (
  SELECT r, words, whole, CAST(sum(words) OVER (ORDER BY CAST(start + packet * {PACKET} + words AS DOUBLE) / target, h, place, epoch, packet, r ROWS UNBOUNDED PRECEDING) AS BIGINT) - words AS position FROM p),
g AS (
  SELECT r, CAST(sum(least(words, whole - position)) AS BIGINT) AS taken FROM t WHERE position < whole GROUP BY r)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0) AS taken FROM q LEFT JOIN g ON q.r = g.r"""
