"""Packing into optimal length buckets.

The global histogram of lengths is gathered: one count for each distinct length, so at most as many as the longest text
has words. Dynamic programming over it chooses the bucket boundaries that minimise the padding when each sequence is
padded to its bucket's boundary. Inside a bucket sequences are numbered in hash order and cut into batches of at most
`budget` padded tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import cut

BUCKETS, BUDGET = 16, 65_536
#: Sequences of one slice of a bucket on average; slices are numbered apart, so no bucket is one task.
SLICE_ROWS = 20_000


def tokens(text: str = "text") -> Column:
    """Words (runs without ASCII white space) of a text and one end mark; 1 for null and blank texts."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return (F.length(squeezed) - F.length(F.replace(squeezed, F.lit("x"), F.lit(""))) + 1).cast("long")


def boundaries(tops: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` buckets with the least total padding. tops: the distinct lengths, ascending;
    counts: the sequences of each. A bucket pads all of its sequences to its largest length, so the total is
    sum(counts * bound) less a constant. Ties take the smaller split.

    With c(i) sequences up to length i, best(k, j) = min over i of best(k - 1, i) + top(j) * (c(j) - c(i)). For one k this
    is the lower envelope of lines of slope -c(i) at the ascending points top(j), so each k takes one pass.
    """
    n = len(tops)
    if not n:
        return []
    c = [0]
    for x in counts:
        c.append(c[-1] + int(x))
    tops = [int(t) for t in tops]
    best, split = [t * m for t, m in zip(tops, c[1:])], []  # one bucket
    for _ in range(1, min(buckets, n)):
        # a line for each i: the buckets before hold the lengths below i; with none of them its height is 0
        hull: list[tuple[int, int, int]] = []
        now, cuts, at = [], [], 0
        for j in range(n):
            slope, height = -c[j], best[j - 1] if j else 0
            # the middle line goes if the new one takes over before it would begin
            while len(hull) > 1 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) < (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, height, j))
            at = min(at, len(hull) - 1)
            value = lambda q: hull[q][0] * tops[j] + hull[q][1]  # noqa: B023, E731
            while at + 1 < len(hull) and value(at + 1) < value(at):
                at += 1
            now.append(tops[j] * c[j + 1] + value(at))
            cuts.append(hull[at][2])
        best = now
        split.append(cuts)
    out, j = [], n - 1
    for cuts in [*split[::-1], None]:
        out.append(tops[j])
        if cuts is None or not cuts[j]:
            break
        j = cuts[j] - 1
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id") -> DataFrame:
    """id_col, length, bucket, bound, batch, slot and padding, one row for each row of docs.

    A batch (numbered from 0 in its bucket) has as many sequences as fit `budget` padded tokens, at least
    one: a sequence above the budget is a batch of its own, never cut or dropped. Repeated rows, equal and null
    ids are packed like any other, each row by itself. An empty table gives no rows.
    """
    length = tokens() if length is None else length
    # texts are read once; what is numbered below is an id and a length
    rows = cut(docs.select(F.col(id_col), length.alias("length"), F.monotonically_increasing_id().alias("_row")))
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()
    bounds = boundaries([r.length for r in histogram], [r.n for r in histogram], buckets)
    slices = max(1, -(-sum(r.n for r in histogram) // SLICE_ROWS))
    if not bounds:
        bounds = [1]
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("length")))).withColumn("bound", F.get(edges, F.col("bucket")))
    # hash order; a slice is a range of hashes, so numbers go on from slice to slice. The row's number keeps equal ids apart
    order = placed.withColumn("h", F.xxhash64(id_col, "length", "_row")).withColumn("slice", F.floor((F.shiftrightunsigned("h", 32) * slices).cast("double") / 2.0**32).cast("int"))
    inside = order.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("h", "_row")) - 1)
    sizes = order.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bound"))).cast("long")
    at = F.col("start") + F.col("at")
    return inside.join(starts, ["bucket", "slice"]).select(
        id_col, "length", "bucket", "bound", F.floor(at / fit).cast("long").alias("batch"), (at % fit).cast("int").alias("slot"), (F.col("bound") - F.col("length")).alias("padding")
    )
