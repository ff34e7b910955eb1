"""Embedding whitening: exactly centred rows, MLlib's Gramian, a local eigendecomposition and a broadcast projection.

Entries become whole numbers, so that sums are exact and rows are centred without rounding: n * x - S is a whole number,
and only its quotient by n is rounded. That matters, as the entries' offset is far larger than their spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import cut

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Eigenvalues below this share of the largest are rounding noise: such components have no variance to divide by.
NOISE = 1e-12


def whole_vectors(rows: DataFrame, vector: str, id_col: str) -> DataFrame:
    """id and x: floor(1024 * c) + 100000 for each entry c. Rows whose vector is null, empty, or holds null or non-finite
    entries go, as do those of another length than most (on a tie, than the longer ones)."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(vector) > 0)
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("long") + OFFSET)
    return rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias(vector)).filter(fine).select("id", x.alias("x"))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of the outer products of an array column's rows: d * d numbers from each task, added up in a tree."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def centred(x: Column | str, n: int, sums: list[int]) -> Column:
    """n * x - S, whole numbers. An overflow fails the job (ANSI), it never wraps."""
    s = F.lit(sums).cast("array<bigint>")
    return F.transform(x, lambda v, i: v * F.lit(n).cast("long") - F.get(s, i))


def whiten(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained and identity_error: for each vector that can be used and
    each of the first `components` principal components (or as many as a vector has entries).

    The vectors that fit the model are all of these. whitened is the centred vector along the component over the square
    root of its variance; null for a component without variance (equal rows, too few rows), as are explained if no entry
    varies and identity_error if no component does. Components have the sign that makes their largest entry positive.
    Repeated and null ids are rows like any other. No usable vector gives no rows. Extra columns play no part.
    The driver holds d * d numbers for vectors of d entries. Jobs run while this is built.
    """
    spark = rows.sparkSession
    all_x = whole_vectors(rows, vector, id_col)
    usual = all_x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    out = "id {}, whitened array<double>, deviation long".format(all_x.schema["id"].dataType.simpleString())
    d, n = (usual.d, usual.n) if usual else (0, 0)
    x = cut(all_x.filter(F.size("x") == d))
    sums = [r.s for r in x.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).orderBy("at").collect()]  # a row for each dimension
    rows_c = x.select("id", centred("x", n, sums).alias("c"))
    scaled = F.transform("c", lambda v: v.cast("double") / float(max(n, 1)))
    cov = gramian(rows_c.select(scaled.alias("y")), "y") / n if n else np.zeros((0, 0))
    values, vectors = np.linalg.eigh((cov + cov.T) / 2) if n else (np.zeros(0), np.zeros((0, 0)))
    k = min(components, d)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0) if k else vectors
    live = values > NOISE * max(values[0], 0.0) if k else np.zeros(0, dtype=bool)
    weights = spark.sparkContext.broadcast(np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), np.nan))  # d * k numbers

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = np.array(b.y.tolist(), dtype=float).reshape(len(b), d)
            yield pd.DataFrame({"id": b.id, "whitened": list(y @ weights.value), "deviation": b.deviation})

    squares = F.aggregate("c", F.lit(0).cast("long"), lambda a, v: a + v * v)
    done = cut(rows_c.select("id", scaled.alias("y"), squares.alias("deviation")).mapInPandas(project, out))
    error = identity_error(done, [i for i in range(k) if live[i]], n)
    trace = float(np.trace(cov))
    shares = F.lit([float(v) / trace if trace > 0 else None for v in values]).cast("array<double>")
    each = done.select("id", "deviation", F.posexplode("whitened").alias("at", "w"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(done: DataFrame, live: list[int], n: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows less the identity, over components with variance."""
    if not live:
        return None
    entry = [F.get("whitened", F.lit(i)) for i in live]
    means = done.agg(*[F.avg(e).alias(f"m{j}") for j, e in enumerate(entry)]).first()
    moved = done.select(F.array(*[e - F.lit(means[j]) for j, e in enumerate(entry)]).alias("y"))
    return float(np.abs(gramian(moved, "y") / n - np.eye(len(live))).max())
